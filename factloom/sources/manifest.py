"""File trees as manifests, and content-addressed stores."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions.scalars import media_type, raw_id


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, content, size_bytes, modified_at) of all files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.substring_index("path", folder.rstrip("/") + "/", -1).alias("relative_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


# What a file's extension promises; others promise nothing.
EXTENSIONS = {
    ".gif": "image/gif",
    ".gz": "application/gzip",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".txt": "text/plain",
    ".zip": "application/zip",
}


def extension_mismatch(extension: Column, media: Column) -> Column:
    """Whether a file's extension promises another media type than was found; one without a promise never disagrees."""
    promised = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.lower(extension)]
    return F.coalesce(promised != media, F.lit(False))


def manifest(found: DataFrame, path: Column, content: Column, *, modified_at: Column | None = None, identity: Column | None = None) -> DataFrame:
    """One row per file: ids, hashes, extension, media type by content, and whether the extension says otherwise.

    A null content is an unreadable file and has neither hash nor id. modified_at: a timestamp, kept as text in nanoseconds;
    identity: what the file system tells files apart by, see ``filesystem_identity``. Both null where not given.
    """
    sha = F.sha2(content, 256)
    extension = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))
    kind = media_type(content)
    nothing = F.lit(None).cast("string")
    return found.select(
        raw_id(path, sha).alias("raw_id"),
        path.alias("relative_path"),
        F.sha2(F.encode(path, "UTF-8"), 256).alias("path_sha256"),
        extension.alias("extension"),
        kind.alias("detected_media_type"),
        extension_mismatch(extension, kind).alias("extension_media_type_mismatch"),
        F.octet_length(content).cast("long").alias("size_bytes"),
        sha.alias("content_sha256"),
        (nothing if modified_at is None else (F.unix_micros(modified_at) * 1000).cast("string")).alias("modified_at_ns"),
        (nothing if identity is None else identity).alias("filesystem_identity_sha256"),
    )


def relationships(rows: DataFrame) -> DataFrame:
    """(relationship_type, identity_sha256, raw_id) of files with equal content (DUPLICATE_CONTENT) and of names of one file
    (HARDLINK_CANDIDATE); a row per member, so a group of any size is never one value. Null identities have no relation."""
    parts = []
    for kind, column in (("DUPLICATE_CONTENT", "content_sha256"), ("HARDLINK_CANDIDATE", "filesystem_identity_sha256")):
        named = rows.where(F.col(column).isNotNull()).select(F.lit(kind).alias("relationship_type"), F.col(column).alias("identity_sha256"), "raw_id")
        several = named.groupBy("identity_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        parts.append(named.join(several, "identity_sha256").select("relationship_type", "identity_sha256", "raw_id"))
    return parts[0].unionByName(parts[1])


def summary(rows: DataFrame) -> DataFrame:
    """(file_count, total_bytes) of a manifest."""
    return rows.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def limit_findings(rows: DataFrame, *, max_files: int = 10_000, max_file_bytes: int = 100 << 20, max_total_bytes: int = 1 << 30, max_depth: int = 20) -> DataFrame:
    """(code): the limits a manifest breaks. A broken limit refuses the whole listing; nothing is ever cut to fit."""
    depth = F.size(F.split("relative_path", "/"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("size_bytes").alias("most"), F.sum("size_bytes").alias("total"), F.max(depth).alias("depth"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("n") > max_files, "FILE_COUNT_EXCEEDED"),
            F.when(F.col("most") > max_file_bytes, "FILE_TOO_LARGE"),
            F.when(F.col("total") > max_total_bytes, "TOTAL_SIZE_EXCEEDED"),
            F.when(F.col("depth") > max_depth, "TREE_TOO_DEEP"),
        )
    )
    return facts.select(F.explode(codes).alias("code"))


def store_objects(rows: DataFrame, target: str) -> None:
    """Appends each content once to a store partitioned by the first two digits of its hash. rows(content_sha256, content).

    Contents already stored are not written again, so a repeated call changes nothing. A content whose hash is another is
    not stored; ``store_differences`` then tells that it is missing.
    """
    spark = rows.sparkSession
    fresh = rows.where(F.col("content_sha256") == F.sha2("content", 256)).dropDuplicates(["content_sha256"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.parquet(target).select("content_sha256"), "content_sha256", "left_anti")
    fresh.select("content_sha256", "content", F.substring("content_sha256", 1, 2).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(target)


def freeze(records: DataFrame, target: str, key: str = "fetch_id") -> None:
    """Appends records to a table once each by their key, so a repeated call changes nothing; of several with one key the least
    is kept. Records without a key are not kept."""
    spark = records.sparkSession
    once = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*records.columns)).alias("_row"))
    fresh = once.select("_row.*")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(target)


def store_differences(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(content_sha256, code): contents listed but not stored, stored but not listed, or stored with another hash."""
    listed = rows.select("content_sha256", F.lit(True).alias("listed")).where(F.col("content_sha256").isNotNull()).distinct()
    kept = stored.select("content_sha256", F.sha2("content", 256).alias("actual"))
    both = listed.join(kept, "content_sha256", "full_outer")
    code = F.when(F.col("actual").isNull(), "OBJECT_MISSING").when(F.col("listed").isNull(), "OBJECT_UNKNOWN").when(F.col("actual") != F.col("content_sha256"), "OBJECT_HASH_MISMATCH")
    return both.select("content_sha256", code.alias("code")).where(F.col("code").isNotNull())
