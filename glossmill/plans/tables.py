"""Queries over typing, profiling, pairs and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators import pairs, profile, sampling
from glossmill.plans import query
from glossmill.plans.inputs import table
from glossmill.sources import readers, schema, sinks, tables

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("infer_types_orders", """
SELECT * FROM (VALUES ('o_orderkey', 'INTEGER'), ('o_custkey', 'INTEGER'), ('o_orderstatus', 'TEXT'), ('o_totalprice', 'REAL'),
  ('o_orderdate', 'TEXT'), ('o_orderpriority', 'TEXT')) t(column_name, type)
WHERE (SELECT bool_and(regexp_matches(CAST(o_orderkey AS VARCHAR), '^-?[0-9]+$') AND TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NOT NULL) FROM orders)
""")
def infer_types_orders(spark, folder):
    orders = table(spark, folder, "orders")
    texts = orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])
    return schema.type_report(texts).select("column_name", "type")


@query("prefix_numbers", r"""
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(o_orderpriority, '^[0-9]+', 0), '') AS DOUBLE) AS priority,
  CAST(year(o_orderdate) AS BIGINT) AS order_year, TRY_CAST(nullif(regexp_extract(o_orderstatus, '^[0-9]+', 0), '') AS DOUBLE) AS status
FROM orders
""")
def prefix_numbers(spark, folder):
    from glossmill.functions.numbers import parse_prefix_integer, parse_prefix_number

    return table(spark, folder, "orders").select(
        "o_orderkey",
        parse_prefix_number("o_orderpriority").alias("priority"),
        parse_prefix_integer(F.col("o_orderdate").cast("string")).alias("order_year"),
        parse_prefix_number("o_orderstatus").alias("status"),
    )


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES))
def table_counts(spark, folder):
    return tables.table_counts({name: table(spark, folder, name) for name in NAMES})


@query("table_fingerprint")
def table_fingerprint(spark, folder):
    prints = [
        tables.table_fingerprint(table(spark, folder, name)).withColumn("table_name", F.lit(name)) for name in ("lineitem", "orders", "documents")
    ]
    return reduce(DataFrame.unionByName, prints)


@query("merge_tables", """
SELECT 'people' AS table_name, count(*) AS row_count, count(segment) AS with_segment FROM (
  SELECT c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL FROM supplier)
""")
def merge_tables(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"))
    merged = tables.merge_tables([{"people": customers, "_internal": customers}, {"people": suppliers}])
    return merged["people"].agg(F.count(F.lit(1)).alias("row_count"), F.count("segment").alias("with_segment")).withColumn("table_name", F.lit("people"))


@query("props_to_params", """
SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events
""")
def props_to_params(spark, folder):
    events = table(spark, folder, "events").select("event_id", "props")
    return readers.explode_json_map(events, "props")[0]


@query("detect_pair_columns", "SELECT item_id, text AS source, '> ' || text AS target FROM benchmark")
def detect_pair_columns(spark, folder):
    renamed = table(spark, folder, "benchmark").select(
        "item_id", F.lit("note").alias("comment"), F.lower("text").alias("old_source"), F.col("text").alias("Src_Text"), F.concat(F.lit("> "), "text").alias("English")
    )
    return pairs.to_pairs(renamed, keep=["item_id"])


@query("map_columns", "SELECT p_partkey AS id, p_name AS source, p_type AS target FROM part")
def map_columns(spark, folder):
    renamed = pairs.map_columns(table(spark, folder, "part"), {"p_partkey": "id", "p_name": "source", "p_type": "target", "absent": "x"})
    return renamed.select("id", "source", "target")


SQL_TURNS = """
turns AS (SELECT a.conv_id, a.turn, a.text AS source, CASE WHEN a.turn % 3 < 2 THEN b.text END AS target
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
"""


def turn_pairs(spark, folder):
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_next"))
    joined = turns.join(following, ["conv_id", "turn"], "left")
    target = F.when(F.col("turn") % 3 < 2, F.col("_next"))
    return joined.select("conv_id", "turn", F.col("text").alias("source"), target.alias("target"))


@query("clean_pairs", f"WITH {SQL_TURNS} SELECT * FROM turns WHERE source IS NOT NULL AND target IS NOT NULL")
def clean_pairs(spark, folder):
    return pairs.clean_pairs(turn_pairs(spark, folder))


@query("pair_quality", f"""
WITH {SQL_TURNS}
SELECT count(*) AS pairs, count(*) FILTER (source IS NULL) AS null_sources, count(*) FILTER (target IS NULL) AS null_targets,
  round(avg(length(source)), 6) AS mean_source_chars, round(avg(length(target)), 6) AS mean_target_chars,
  count(*) FILTER (source IS NOT NULL AND target IS NOT NULL) AS clean_pairs FROM turns
""")
def pair_quality(spark, folder):
    quality = profile.pair_quality(turn_pairs(spark, folder))
    return quality.withColumns({c: F.round(c, 6) for c in ("mean_source_chars", "mean_target_chars")})


@query("select_limit", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey LIMIT 100")
def select_limit(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"]
    return pairs.select_limit(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], 100, order)


@query("adhoc_sql", """
SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def adhoc_sql(spark, folder):
    given = {name: table(spark, folder, name) for name in ("customer", "nation")}
    return pairs.run_sql(given, """
        SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""")  # fmt: skip


@query("preview_documents", "SELECT doc_id, substr(text, 1, 80) AS text FROM documents ORDER BY doc_id LIMIT 5")
def preview_documents(spark, folder):
    return pairs.preview(table(spark, folder, "documents").select("doc_id", "text"), ["text"], 5, 80, ["doc_id"])


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_lineitem", " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, "
     f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in NUMBERS]
    + [f"SELECT '{c}', count({c}), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL FROM lineitem" for c in OTHERS]
))
def profile_lineitem(spark, folder):
    return profile.profile(table(spark, folder, "lineitem")).drop("position", "type")


@query("profile_lineitem_approx", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, true AS near FROM lineitem" for c in NUMBERS + OTHERS
))
def profile_lineitem_approx(spark, folder):
    """Whether each sketched distinct count is within 8 % of the exact one."""
    lines = table(spark, folder, "lineitem")
    sketched = profile.profile(lines, approx=True).select("column_name", "non_null", F.col("distinct_values").alias("sketch"))
    exact = profile.profile(lines).select("column_name", "distinct_values")
    near = F.abs(F.col("sketch") - F.col("distinct_values")) <= 0.08 * F.col("distinct_values")
    return sketched.join(exact, "column_name").select("column_name", "non_null", near.alias("near"))


@query("avg_record_size", """
SELECT count(*) AS records, round(avg(length('{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderpriority":"' || o_orderpriority || '"}')), 6) AS mean_chars
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)
""")
def avg_record_size(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return profile.avg_record_size(orders, 1000, ["o_orderkey"]).withColumn("mean_chars", F.round("mean_chars", 6))


@query("submission_table", r"""
SELECT doc_id, trim(regexp_replace('translate source to target: ' || text, '\s+', ' ', 'g')) AS translation FROM documents
WHERE NOT regexp_matches(text, '\(')
UNION ALL
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('translate source to target: ' || text, '\s*\(\s*s\s*\)\s*', 's ', 'g'),
  '\s*\(\s*(or|and)\s*\)\s*', ' \1 ', 'g'), '\s*\(\s*(ki|d|m|f|lu|munus)\s*\)\s*', ' ', 'g'), '\s+', ' ', 'g')) FROM documents
WHERE regexp_matches(text, '\(')
""")
def submission_table(spark, folder):
    from glossmill.functions.text import with_prefix

    predicted = table(spark, folder, "documents").select("doc_id", with_prefix("text", "translate source to target: ").alias("translation"))
    return sinks.submission_table(predicted, "doc_id", "translation", clean="light")


def sql_bucket(keys: str, buckets: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', {keys})), 1, 12) AS BIGINT) % {buckets}"


@query("split_counts", f"""
SELECT doc_id, CASE WHEN {sql_bucket('doc_id', 1_000_000)} < 100000 THEN 'validation' ELSE 'train' END AS part FROM documents
""")
def split_counts(spark, folder):
    return sampling.split_by_hash(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 0.1, 42)


@query("assign_folds", f"SELECT doc_id, CAST({sql_bucket('doc_id', 5)} AS INTEGER) AS fold FROM documents")
def assign_folds(spark, folder):
    return sampling.assign_folds(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 5)


@query("shard_counts", f"SELECT l_orderkey, l_linenumber, CAST({sql_bucket('l_orderkey, l_linenumber', 8)} AS INTEGER) AS shard FROM lineitem")
def shard_counts(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.with_shard(lines, ["l_orderkey", "l_linenumber"], 8)


@query("shuffled", "SELECT doc_id, lang FROM documents")
def shuffled(spark, folder):
    return sampling.shuffled(table(spark, folder, "documents").select("doc_id", "lang"), ["doc_id"])
