"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, folder) and returns a DataFrame that is written and
read again as the next one's ``docs``. All but the last return the columns of documents. Rows are dropped only by a
stage's verdict: by the quality rules, when line dedup leaves nothing of a document, when an earlier document of its
group stays, and when it holds a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.decontamination import contaminated
from glossmill.llm.line_dedup import remove_repeated
from glossmill.llm.line_frequency import judge
from glossmill.llm.near_duplicates import near_duplicates
from glossmill.llm.packing import pack
from glossmill.llm.tables import only, stored, table, unused

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None  # minwise trees, tiles and bins are not SQL; tests/llm compares every stage with brute force


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by lines frequent at their source.

    Rows with equal id, source and text share a verdict; null ids and sources are values like others.
    """
    values = [F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.xxhash64("text")]
    own = {unused(docs.columns, name): value for name, value in zip(("__id", "__host", "__mark"), values)}
    marked = docs.withColumns(own).select(F.struct(*own).alias("key"), "source", "text")
    rejected = only(spark, "rejected", lambda: judge(marked, "key").where("not kept").select("key.*").distinct())
    # Rejected rows grow with the documents, so the join is never a broadcast.
    return docs.withColumns(own).join(rejected.hint("merge"), list(own), "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without repeated passages; one that loses all its words goes."""
    cut = remove_repeated(docs)
    left = cut.where(~((F.col("__n_removed") > 0) & (F.col("__n_removed") >= F.col("__n_lines"))))
    return left.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group; rows that share an id are one document."""
    verdict = only(spark, "near-verdict", lambda: near_duplicates(docs))
    gone = verdict.where("not kept").select("doc_id").distinct()
    left = docs.join(stored(gone, "near-gone").hint("merge"), "doc_id", "left_anti")
    twice = stored(verdict.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = only(spark, "contaminated", lambda: contaminated(docs, table(spark, folder, "benchmark")).select("doc_id").distinct())
    return docs.join(hits.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
