"""Column expressions for the scalar checks; each is built from JVM functions only.

A check column is true or false, never null: null input fails it.
"""

from pyspark.sql import Column, functions as F

# File signatures in the order they are tried, and value formats.
SIGNATURES = (
    (b"%PDF-", "application/pdf"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"PK\x03\x04", "application/zip"),
    (b"PK\x05\x06", "application/zip"),
    (b"PK\x07\x08", "application/zip"),
    (b"\x1f\x8b", "application/gzip"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage"),
    (b"MZ", "application/vnd.microsoft.portable-executable"),
)
PREFIX_BYTES = 8192
DECIMAL_TEXT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?\z"
AMOUNT_CNY = r"^(0|[1-9][0-9]{0,14})\.[0-9]{2}\z"
SUBJECT_KEY = r"^[A-Z][A-Z0-9_-]{2,127}\z"
IDENTIFIER = r"^[A-Z][A-Z0-9_-]{2,63}\z"


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_sha256(c: Column) -> Column:
    """64 hexadecimal digits in either case."""
    return _sure(F.lower(c).rlike(r"^[0-9a-f]{64}\z"))


def is_decimal_text(c: Column) -> Column:
    """A plain decimal of at most 100 characters; a cast alone would also take 1e3 or blanks."""
    return _sure(c.rlike(DECIMAL_TEXT) & (F.length(c) <= 100))


def is_amount_cny(c: Column) -> Column:
    return _sure(c.rlike(AMOUNT_CNY))


def is_identifier(c: Column) -> Column:
    return _sure(c.rlike(IDENTIFIER))


def is_canonical_value(kind: Column, value: Column, role: Column) -> Column:
    """Whether a structured value is in the one form its semantic kind allows; only dates may carry a timeline role."""
    from factloom.functions.ids import real_date

    date = real_date(value).isNotNull() & role.isin("NONE", "EMPLOYMENT_START", "EMPLOYMENT_END", "TERMINATION")
    return _sure(
        F.when(kind == "DATE", date)
        .when(kind == "AMOUNT_CNY", value.rlike(AMOUNT_CNY) & (role == "NONE"))
        .when(kind == "SUBJECT_KEY", value.rlike(SUBJECT_KEY) & (role == "NONE"))
    )


def utc_timestamp(c: Column) -> Column:
    """The time of an RFC 3339 string that ends in Z, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z\z"), c.try_cast("timestamp"))


def add_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + hours.cast("long") * 3_600_000_000)


def is_safe_relative_path(c: Column) -> Column:
    """Not empty, not absolute, no backslash, no parent step, not the folder itself."""
    return _sure((F.length(c) > 0) & ~c.contains("\\") & ~c.startswith("/") & (c != ".") & ~F.array_contains(F.split(c, "/"), ".."))


def is_portable_path(c: Column) -> Column:
    """Safe, and without NUL characters; an inner dot step is only dropped by normalisation and allowed."""
    return _sure(is_safe_relative_path(c) & ~c.contains("\0") & ~c.rlike(r"^[./]*\z"))


def raw_id(path: Column, sha256: Column) -> Column:
    """RAW- and the hash of the path's bytes, a zero byte and the content hash's 32 bytes; null where the hash is none."""
    digest = F.unhex(F.when(is_sha256(sha256), sha256))
    return F.concat(F.lit("RAW-"), F.sha2(F.concat(F.encode(path, "UTF-8"), F.lit(b"\0"), digest), 256))


def object_path(sha256: Column) -> Column:
    """Where a store keeps a content: by the first two digits of its hash; null where the hash is none."""
    sha = F.lower(F.when(is_sha256(sha256), sha256))
    return F.concat(F.lit("objects/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(".bin"))


def filesystem_identity(device: Column, inode: Column) -> Column:
    return F.sha2(F.concat_ws(":", device.cast("string"), inode.cast("string")), 256)


def media_type(content: Column) -> Column:
    """By the first bytes; else plain text where the first 8192 bytes are UTF-8 without a zero byte, a character cut at
    their end included as not UTF-8. Empty content is plain text."""
    prefix = F.substring(content, 1, PREFIX_BYTES)
    found = None
    for signature, kind in SIGNATURES:
        hit = F.startswith(prefix, F.lit(signature))
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    text = ~F.contains(prefix, F.lit(b"\0")) & F.is_valid_utf8(prefix.cast("string"))
    return found.when(text, "text/plain").otherwise("application/octet-stream")


def url_host(url: Column) -> Column:
    """The lower-case host of a URL that may be fetched: https, no credentials, no fragment, port 443 or none, at most 2048
    characters; else null."""
    host = F.regexp_extract(url, r"^(?i:https)://([^/?#@:\s]+)(?::443)?(?:[/?][^#]*)?\z", 1)
    return F.when((F.length(url) <= 2048) & (F.length(host) > 0), F.lower(host))


def freshness(unavailable: Column, baseline_hash: Column, observed_hash: Column, age_hours: Column, max_age_hours: Column) -> Column:
    """The first that holds: unavailable, changed, stale (older than the limit), unchanged."""
    return (
        F.when(unavailable, "UNAVAILABLE_DRAFT_ONLY")
        .when(~observed_hash.eqNullSafe(baseline_hash), "CHANGE_DETECTED_REVIEW_REQUIRED")
        .when(age_hours > max_age_hours, "STALE_DRAFT_ONLY")
        .otherwise("UNCHANGED_RESPONSE_BODY_CANDIDATE")
    )


def candidate_status(count: Column) -> Column:
    return F.when(count == 0, "NO_CANDIDATE").when(count == 1, "UNIQUE_CANDIDATE").otherwise("MULTIPLE_CANDIDATES")


def text_lines(c: Column) -> Column:
    """Lines of a text as Python's splitlines gives them: all its separators, no empty line at the end."""
    parts = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_sorted(array: Column, *, unique: bool = False) -> Column:
    """Whether an array is in ascending order, and without repetition if ``unique``; a null array is."""
    want = F.array_sort(F.array_distinct(array) if unique else array)
    return array.eqNullSafe(want)
