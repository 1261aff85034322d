"""Canonical JSON (RFC 8785), snapshot hashes, and strict reading of JSON objects."""

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_INTEGER, MAX_NESTING = 2**53 - 1, 100


def _number(x: float) -> str:
    """A double as ECMAScript prints it: shortest digits, exponent outside [1e-6, 1e21)."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    mantissa, exponent = f"{abs(x):.17e}".split("e")
    mantissa, exponent = repr(abs(x)).partition("e")[::2] if "e" in repr(abs(x)) else (repr(abs(x)), "0")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        e = point - 1
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * (x < 0) + out


def canonical(value) -> str:
    """Keys in order of their UTF-16 code units, no spaces, no escapes beyond those JSON demands. Integers beyond 2**53 - 1
    and lone surrogates are refused."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        value.encode("utf-8")
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > MAX_INTEGER:
            raise ValueError("integer out of range")
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    raise ValueError(f"{type(value).__name__} has no JSON form")


class _Refused(ValueError):
    pass


def _unique(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Refused("DUPLICATE_KEY")
    return out


def _constant(name):
    raise _Refused("INVALID_CONSTANT")


#: A string, closed or not, or one bracket.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[\[\]{}]', re.S)


def nesting(text: str) -> int:
    """The depth of containers, brackets within strings aside."""
    depth = most = 0
    for token in _TOKEN.findall(text):
        if token in ("[", "{"):
            depth += 1
            most = max(most, depth)
        elif token in ("]", "}"):
            depth = max(0, depth - 1)
    return most


def strict_value(text: str | None, max_bytes: int | None = None):
    """(value, None) or (None, code): UNREADABLE, TOO_LARGE, TOO_DEEPLY_NESTED, DUPLICATE_KEY, INVALID_CONSTANT or INVALID_JSON,
    whichever is met first."""
    if text is None:
        return None, "UNREADABLE"
    if max_bytes is not None and len(text.encode("utf-8", "surrogatepass")) > max_bytes:
        return None, "TOO_LARGE"
    if nesting(text) > MAX_NESTING:
        return None, "TOO_DEEPLY_NESTED"
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_constant=_constant), None
    except _Refused as e:
        return None, str(e)
    except json.JSONDecodeError:
        return None, "INVALID_JSON"


def strict_object(text: str | None, max_bytes: int) -> tuple[dict | None, str | None]:
    """(object, None), or (None, code): those of ``strict_value``, or ROOT_NOT_OBJECT."""
    value, code = strict_value(text, max_bytes)
    return (None, code) if code else (value, None) if isinstance(value, dict) else (None, "ROOT_NOT_OBJECT")


@F.pandas_udf(StringType())
def jcs(texts: pd.Series) -> pd.Series:
    """The canonical form of a JSON text; null for null, invalid or refused input."""

    def one(t):
        try:
            return canonical(json.loads(t, object_pairs_hook=_unique, parse_constant=_constant))
        except (TypeError, ValueError, UnicodeEncodeError):
            return None

    return texts.map(one)


def json_snapshot(text):
    """The SHA-256 of a JSON text's canonical form; null where it has none."""
    return F.sha2(F.encode(jcs(text), "UTF-8"), 256)


def snapshot_matches(declared, text):
    """Whether a declared hash is that of the text; text without a canonical form matches nothing."""
    return F.coalesce(F.lower(declared) == json_snapshot(text), F.lit(False))


def strict_json_code(max_bytes: int = 10 * 1024 * 1024):
    """A column function: the code of the first rule a JSON object text breaks, '' where it breaks none."""

    @F.pandas_udf(StringType())
    def code(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: strict_object(t, max_bytes)[1] or "")

    return code


def path_exists(value, path: str) -> bool:
    """Whether a path such as $.subject.items[0] leads to something, null included."""
    if not path.startswith("$"):
        return False
    at, i = value, 1
    while i < len(path):
        if path[i] == ".":
            j = i + 1
            while j < len(path) and path[j] not in ".[":
                j += 1
            name = path[i + 1 : j]
            if not isinstance(at, dict) or name not in at:
                return False
            at, i = at[name], j
        elif path[i] == "[" and (j := path.find("]", i)) > 0 and path[i + 1 : j].isdecimal():
            n = int(path[i + 1 : j])
            if not isinstance(at, list) or n >= len(at):
                return False
            at, i = at[n], j + 1
        else:
            return False
    return True


def snapshot(**fields):
    """The snapshot hash of chosen fields, as a Column: their canonical JSON object, hashed. Null fields stay as null."""
    return json_snapshot(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}))


def _quoted(text):
    """A text column as a canonical JSON string, by JVM functions; null as null. What differs from the JVM's own JSON is the case
    of hexadecimal digits in escapes of control characters."""
    whole = F.to_json(F.struct(text.alias("v")))
    quoted = F.substring(whole, 6, F.length(whole) - 6)
    for digit in "ABCDEF":
        quoted = F.regexp_replace(quoted, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    quoted = F.when(text.rlike(r"[\x00-\x1f]"), quoted).otherwise(F.substring(whole, 6, F.length(whole) - 6))
    return F.when(text.isNull(), "null").otherwise(quoted)


def text_snapshot(**fields):
    """``snapshot`` of text columns, without leaving the JVM."""
    pairs = [F.concat(F.lit(f"{json.dumps(n)}:"), _quoted(c)) for n, c in sorted(fields.items())]
    return F.sha2(F.encode(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), "UTF-8"), 256)


def identifier(prefix: str, **fields):
    """A derived identifier of text columns, as a Column: the prefix and the first 24 upper-case digits of their snapshot hash."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(text_snapshot(**fields), 1, 24)))


def snapshot_id(prefix: str, fields: dict) -> str:
    """An identifier: the prefix and the first 24 upper-case hex digits of the canonical form's hash."""
    return f"{prefix}-{hashlib.sha256(canonical(fields).encode()).hexdigest()[:24].upper()}"
