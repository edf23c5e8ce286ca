"""Versioned datasets: registration, lookup, links to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.functions.names import format_ref, parse_ref
from glossmill.operators.keyed import PAGE_SIZE, collect_paged, latest_per_key, lookup, sequence_per_key

VERSION_COLUMNS = [
    "id", "name", "version", "source_type", "source_path", "parent_version_id", "etl_pipeline",
    "table_path", "created_at", "row_count", "size_bytes", "checksum", "metadata",
]


def zero_to_null(df: DataFrame, columns: list[str] = ["row_count", "size_bytes"]) -> DataFrame:
    """A registered size of 0 counts as unknown."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def list_versions(df: DataFrame, name: str | None = None, source_type: str | None = None) -> DataFrame:
    """Versions by name, newest first; both filters reach the scan."""
    if name is not None:
        df = df.where(F.col("name") == name)
    if source_type is not None:
        df = df.where(F.col("source_type") == source_type)
    return df.orderBy("name", F.col("version").desc())


def latest_versions(df: DataFrame) -> DataFrame:
    return latest_per_key(df, ["name"], [F.col("version").desc()])


def distinct_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct().orderBy("name")


def assign_versions(new: DataFrame, existing: DataFrame | None, order: list[str]) -> DataFrame:
    """Version numbers for new rows: after the highest existing one of the same name, else from 1."""
    numbered = sequence_per_key(new, ["name"], order, "version")
    if existing is None:
        return numbered
    highest = existing.groupBy("name").agg(F.max("version").alias("_highest"))
    joined = lookup(numbered, highest, ["name"])
    return joined.withColumn("version", F.col("version") + F.coalesce("_highest", F.lit(0))).drop("_highest")


def resolve_refs(refs: DataFrame, versions: DataFrame, column: str = "ref") -> DataFrame:
    """The version each ``name[:version]`` means; no number means the latest. Unknown ones are dropped.

    Only one row per name and version is needed, so the lookup table is cut to keys before the join.
    """
    wanted = refs.withColumn("_ref", parse_ref(column)).select("*", "_ref.name", F.col("_ref.version").alias("_wanted")).drop("_ref")
    keys = versions.select("name", "version", "id")
    fixed = wanted.where(F.col("_wanted").isNotNull()).join(
        keys.withColumnRenamed("version", "_wanted"), ["name", "_wanted"]
    )
    newest = latest_versions(keys)
    open_refs = wanted.where(F.col("_wanted").isNull()).drop("_wanted").join(newest, "name")
    named = fixed.withColumnRenamed("_wanted", "version").select(*open_refs.columns[:-2], "version", "id")
    return named.unionByName(open_refs)


def datasets_for_runs(versions: DataFrame, links: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Dataset versions with the runs that used them, one row per link."""
    if runs is not None:
        links = links.where(F.col("run_id").isin(runs))
    link = links.select(F.col("dataset_version_id").alias("id"), "run_id", "link_type")
    return versions.join(link, "id")


def with_links(versions: DataFrame, links: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Every dataset version with its linked runs (run_id, link_type), sorted, in pages, and their number ``n_runs``.

    There is one row per (version, page); a version without links has page 0 with an empty list.
    """
    used = links.select(F.col("dataset_version_id").alias("id"), "run_id", "link_type").where(F.col("id").isNotNull())
    lists = collect_paged(used, ["id"], F.struct("run_id", "link_type"), ["run_id", "link_type"], "runs", page_size)
    totals = used.groupBy("id").agg(F.count(F.lit(1)).alias("n_runs"))
    empty = F.array().cast(lists.schema["runs"].dataType)
    joined = versions.join(totals, "id", "left").join(lists, "id", "left")
    return joined.withColumns({"n_runs": F.coalesce("n_runs", F.lit(0)), "page": F.coalesce("page", F.lit(0)), "runs": F.coalesce("runs", empty)})


def replace_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-replace: the last row written per key survives."""
    return latest_per_key(df, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """New rows over old ones; a value that the new row lacks keeps its old value, or its default."""
    defaults = defaults or {}
    values = [c for c in old.columns if c not in keys]
    present = [c for c in values if c in new.columns]
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in present])
    both = old.join(fresh, keys, "full_outer")

    def merged(name: str) -> Column:
        options = [F.col(f"_new_{name}")] if name in present else []
        options.append(F.col(name))
        if name in defaults:
            options.append(as_column(defaults[name]))
        return F.coalesce(*options).alias(name)

    return both.select(*keys, *[merged(c) for c in values])


def ensure_keys(known: DataFrame, names: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """The known rows plus one row for each name that is new. The new id is the hash of the name."""
    unknown = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti")
    fresh = unknown.select(F.sha2(F.col(name).cast("string"), 256).alias(key), name)
    return known.select(key, name).unionByName(fresh)


def missing_refs(refs: DataFrame, attached: DataFrame, on: list[str]) -> DataFrame:
    """References without an attachment. References are made distinct before the join."""
    return refs.distinct().join(attached.select(*on).distinct(), on, "left_anti")


def schema_violations(
    used: DataFrame, schema: DataFrame, always_allowed: list[str] | None = None
) -> DataFrame:
    """Columns used with a dataset that it does not have: rows (dataset, column_name).

    ``used`` and ``schema`` have those two columns. Datasets without a known schema are not judged.
    """
    allowed = ALWAYS_ALLOWED if always_allowed is None else always_allowed
    candidates = used.select("dataset", "column_name").distinct().where(~F.col("column_name").isin(allowed))
    known = schema.select("dataset").distinct()
    judged = candidates.join(known, "dataset", "left_semi")
    return judged.join(schema.select("dataset", "column_name").distinct(), ["dataset", "column_name"], "left_anti")


# Derived columns that are fine with any dataset.
ALWAYS_ALLOWED = ["id", "source", "target", "text", "label", "input", "output"]


def ref_text(name: Column | str, version: Column | str) -> Column:
    return format_ref(name, version)
