"""Registering data sets as one operation: describe, number, link and store, so that a repeated call changes nothing.

A store is a folder with two Parquet tables, ``versions`` and ``links``, partitioned by a hash bucket of the name, and the
registered tables below ``tables``. A call reads and rewrites only the buckets that its names fall in. One writer at a time
is assumed, as for any folder of Parquet files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators.keyed import latest_per_key
from glossmill.operators.registry import VERSION_COLUMNS, assign_versions, resolve_refs, zero_to_null
from glossmill.operators.sampling import bucket_of
from glossmill.session import cut
from glossmill.sources.readers import read_any, read_table_csv
from glossmill.sources.tables import save_table

BUCKETS = 64
VERSIONS = (
    "id string, name string, version bigint, source_type string, source_path string, parent_version_id string, etl_pipeline string, "
    "table_path string, created_at string, row_count bigint, size_bytes bigint, checksum string, metadata string"
)
LINKS = "name string, dataset_version_id string, run_id string, link_type string, created_at string"
LINK_KEYS = ["dataset_version_id", "run_id", "link_type"]
OPTIONAL = ["source_type", "source_path", "etl_pipeline", "table_path", "created_at", "metadata", "parent", "run_id", "link_type"]


def row_text(columns: list[str]) -> Column:
    """A row as one text that no other row has: every value with its length in front, NULL as a dash."""
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def describe(data: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, bytes and checksum of a table, or of each group of it, whatever the order of the rows.

    The checksum is the MD5 of the row count, the XOR and the sum of two parts of the MD5 of every row; repeated rows
    count. One pass; a row per group and task is shuffled, so a group may be of any size. ``size_bytes`` is the size of
    the row texts, which does not depend on a file format.
    """
    by = by or []
    digest = F.md5(F.col("_row"))
    parts = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 17)]
    rows = data.select(*[f"`{c}`" for c in by], row_text([c for c in data.columns if c not in by]).alias("_row"))
    hashed = rows.select(*[f"`{c}`" for c in by], F.octet_length("_row").alias("_size"), parts[0].alias("_a"), parts[1].alias("_b"))
    sums = hashed.groupBy(*[f"`{c}`" for c in by]).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("_size"), F.lit(0)).alias("size_bytes"),
        F.coalesce(F.bit_xor("_a"), F.lit(0)).alias("_xor"),
        F.coalesce(F.sum(F.col("_b").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("_sum"),
    )
    text = F.concat_ws("|", F.col("row_count").cast("string"), F.col("_xor").cast("string"), "_sum")
    return sums.select(*[f"`{c}`" for c in by], "row_count", "size_bytes", F.md5(text).alias("checksum"))


def version_id(name: Column, version: Column, checksum: Column) -> Column:
    """The id of a version follows from what it is, so that a repeated call makes the same one."""
    return F.sha2(F.concat_ws(":", name, version.cast("string"), checksum), 256)


def plan_versions(new: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """What registering ``new`` would do, one row per (name, checksum, source_path): its version row and ``outcome``.

    ``known`` (already registered with this content from this source), ``new`` (numbered after the highest version of
    the name, in the given order) or a reason for refusal: ``no_name``, ``parent_not_found``. A ``parent`` is written
    ``name[:version]`` and looked up among the known versions. Columns of ``new`` besides name, checksum, row_count and
    size_bytes are optional.
    """
    absent = [c for c in OPTIONAL if c not in new.columns]
    given = new.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else new
    identity = ["name", "checksum", "source_path"]
    once = latest_per_key(given, identity, [F.col(c).asc_nulls_first() for c in order])
    renamed = known.select(*[F.col(c).alias(f"_known_{c}") for c in identity], F.col("id").alias("_id"), F.col("version").alias("_version"))
    first = latest_per_key(renamed, [f"_known_{c}" for c in identity], [F.col("_version").asc()])
    same = [F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in identity]
    seen = once.join(first, same, "left").drop(*[f"_known_{c}" for c in identity])
    refs = seen.where(F.col("parent").isNotNull()).select(F.col("parent").alias("ref")).distinct()
    parents = resolve_refs(refs, known.select("name", "version", "id")).select(F.col("ref").alias("parent"), F.col("id").alias("parent_version_id"))
    judged = seen.join(parents, "parent", "left").withColumn(
        "outcome",
        F.when(F.col("name").isNull(), "no_name").when(F.col("_id").isNotNull(), "known")
        .when(F.col("parent").isNotNull() & F.col("parent_version_id").isNull(), "parent_not_found").otherwise("new"),
    )
    numbered = assign_versions(judged.where("outcome = 'new'").drop("_id", "_version"), known, order)
    fresh = numbered.withColumn("id", version_id(F.col("name"), F.col("version"), F.col("checksum")))
    rest = judged.where("outcome <> 'new'").withColumnsRenamed({"_id": "id", "_version": "version"})
    both = fresh.unionByName(rest.select(*fresh.columns))
    fields = [f.strip().split(" ") for f in VERSIONS.split(",")]
    typed = [F.col(name).cast(kind).alias(name) for name, kind in fields]
    return zero_to_null(both.select(*typed, "run_id", "link_type", "outcome"))


def _stored(spark: SparkSession, path: str, schema: str, buckets: list[int]) -> DataFrame:
    """The rows of a table in the given buckets; none if the table does not exist yet."""
    try:
        table = spark.read.schema(f"{schema}, bucket int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return table.where(F.col("bucket").isin(buckets)).drop("bucket")


def _bucket() -> Column:
    return bucket_of(["name"], BUCKETS, 0).cast("int")


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replaces the buckets that the rows fall in; the others stay."""
    dealt = rows.withColumn("bucket", _bucket()).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def register(new: DataFrame, store: str, order: list[str]) -> DataFrame:
    """Registers described data sets (see ``plan_versions``) and links them to their ``run_id``, if any.

    Returns a row per data set with its version and outcome. New versions and links are stored together with what their
    buckets hold; if there are none, nothing is written. A version that is known already can still gain a link.
    """
    spark = new.sparkSession
    candidates = cut(new)  # described once, read for the buckets and the plan
    buckets = [r.bucket for r in candidates.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
    parents = [] if "parent" not in new.columns else [
        r.bucket for r in candidates.where("parent is not null").select(F.split("parent", ":")[0].alias("name")).select(_bucket().alias("bucket")).distinct().collect()
    ]
    known = _stored(spark, f"{store}/versions", VERSIONS, sorted({*buckets, *parents}))
    plan = cut(plan_versions(candidates, known, order))
    fresh = plan.where("outcome = 'new'").select(*VERSION_COLUMNS)
    if not fresh.isEmpty():
        touched = _stored(spark, f"{store}/versions", VERSIONS, buckets)
        _overwrite(touched.unionByName(fresh), f"{store}/versions")
    wanted = plan.where("outcome in ('new', 'known') and run_id is not null").select(
        "name", F.col("id").alias("dataset_version_id"), "run_id", F.coalesce("link_type", F.lit("training")).alias("link_type"), "created_at"
    )
    linked = _stored(spark, f"{store}/links", LINKS, buckets)
    added = cut(wanted.dropDuplicates(LINK_KEYS).join(linked, LINK_KEYS, "left_anti"))
    if not added.isEmpty():
        _overwrite(linked.unionByName(added), f"{store}/links")
    return plan


def registered(spark: SparkSession, store: str) -> DataFrame:
    """All versions of a store."""
    return _stored(spark, f"{store}/versions", VERSIONS, list(range(BUCKETS)))


def registered_links(spark: SparkSession, store: str) -> DataFrame:
    """All links of a store from a version to a run."""
    return _stored(spark, f"{store}/links", LINKS, list(range(BUCKETS)))


def register_file(
    spark: SparkSession,
    path: str,
    store: str,
    name: str,
    created_at: str,
    source_type: str = "original",
    parent: str | None = None,
    pipeline: str | None = None,
    notes: str | None = None,
    run_id: str | None = None,
    link_type: str | None = None,
) -> DataFrame:
    """A file or folder from reading to link: typed table, counts, checksum, stored copy, version, parent, run.

    The copy lies below ``tables`` under its checksum, so that content that is known is not written again. CSV columns
    are typed from all rows. A parent that does not exist is refused before anything is written.
    """
    table = read_table_csv(spark, path, typed=True) if path.endswith(".csv") else read_any(spark, path)
    if parent is not None:
        ref = spark.createDataFrame([(parent,)], "ref string")
        if resolve_refs(ref, registered(spark, store).select("name", "version", "id")).isEmpty():
            raise LookupError(f"parent {parent} is not registered in {store}")
    facts = describe(table).first()
    target = f"{store}/tables/{name}/{facts.checksum}"
    row = (name, source_type, path, target, created_at, facts.row_count, facts.size_bytes, facts.checksum, parent, pipeline, run_id, link_type, notes)
    schema = (
        "name string, source_type string, source_path string, table_path string, created_at string, row_count long, size_bytes long, checksum string, "
        "parent string, etl_pipeline string, run_id string, link_type string, notes string"
    )
    new = spark.createDataFrame([row], schema)
    details = F.to_json(F.struct(F.col("notes"), F.col("etl_pipeline").alias("pipeline"), F.col("source_path").alias("originalPath")))
    if not _complete(spark, target):
        save_table(table, target, path, created_at, mode="overwrite")
    return register(new.withColumn("metadata", details).drop("notes"), store, ["created_at"])


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end, its metadata included."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_metadata/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
