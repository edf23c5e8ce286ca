"""The registered queries of the training-data operators: each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm.tables import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and shard of every document, by its id."""
    from glossmill.llm.sharding import place

    return place(table(spark, folder, "documents").select("doc_id"), ["doc_id"], SHARDS)


@query("op7_line_frequency")
def op7_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures and verdict of every document; the source is the host."""
    from glossmill.llm.line_frequency import judge

    return judge(table(spark, folder, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    from glossmill.llm.packing import pack

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Set size, group and verdict of every document."""
    from glossmill.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that repeat an earlier one, with its lines before and the lines removed."""
    from glossmill.llm.line_dedup import remove_repeated

    cut = remove_repeated(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds most of a benchmark item, with the item."""
    from glossmill.llm.decontamination import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("tiles")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    from glossmill.llm.language_id import fit, identify

    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 3) == 1
    found = identify(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels."""
    from glossmill.llm.toxicity import fit, score

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = remainder("doc_id", 5) == 0
    found = score(docs, fit(docs, labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "matches")


@query("op5_language_model")
def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram baseline and trigram score of every document, learned from four fifths of them."""
    from pyspark.sql import functions as F

    from glossmill.llm.language_model import score, train

    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 5) == 1
    model = train(docs.where(~held_out), order=3)
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page; pages whose url names a stored document are the labelled ones."""
    from glossmill.llm.html_extraction import extract, fit, known_texts

    pages = table(spark, folder, "pages")
    model = fit(known_texts(pages, table(spark, folder, "documents")))
    return extract(pages, model).select("page_id", "url", "text", "n_chars", "n_blocks", "kept_blocks")


def _crc32(text: str) -> str:
    """DuckDB SQL: the CRC-32 of a text of ASCII characters."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, w: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295)"


@query(
    "op13_conversation_trie",
    f"""
    WITH numbered AS (
        SELECT conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS id,
            len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS words, turn
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
        SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY turn NULLS FIRST, id) AS turns FROM numbered GROUP BY conv_id
    ), sized AS (
        SELECT *, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM own
    ), rebuilt AS (
        SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
        FROM sized c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
    ), paths AS (
        SELECT conv_id, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth,
            array_to_string(list_transform(turns, lambda t: t.id), '') AS whole, list_transform(turns, lambda t: t.words) AS words
        FROM rebuilt
    ), rows AS (
        SELECT conv_id, depth, size, left(whole, 32 * depth::INT) AS prefix, CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words FROM paths
    ), nodes AS (
        SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
        FROM rows GROUP BY prefix
    ), sizes AS (
        SELECT left(prefix, (32 * (depth - 1))::INT) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
    ), counted AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN sizes USING (prefix)
    ), spread AS (
        SELECT left(prefix, 32 * unnest(range(depth + 1))::INT) AS prefix, saved, (n_children = 0)::INT AS leaf FROM counted
    ), subtrees AS (
        SELECT prefix, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM spread GROUP BY prefix
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM counted n JOIN subtrees s USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, (32 * (n.depth - 1))::INT)
    """,
)
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, each begun with the first turns of the conversation at its head of twenty."""
    from pyspark.sql import functions as F

    from glossmill.llm.conversation_trie import marked, prefix_trie, with_heads_of
    from glossmill.llm.tables import stored

    turns = stored(marked(table(spark, folder, "conversations")), "conversation-turns")
    head = F.col("conv_id") - F.col("conv_id") % 20
    return prefix_trie(*with_heads_of(turns, head, remainder("conv_id", 4), 3))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, its longest one, and digests of all runs and of the text without repeats."""
    from pyspark.sql import functions as F

    from glossmill.llm.periodic_runs import folded, periodic_runs

    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = table(spark, folder, "documents").select("doc_id", folded(F.col("text"), mark).alias("text"))
    found = periodic_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    best = found.withColumns({"top": top, "listed": listed})
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.least")).alias("period"),
        F.expr("(1000 * top.length) div -top.least").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices in every document; the score is the largest share of a phrase or notice that it holds."""
    from pyspark.sql import functions as F

    from glossmill.llm.license_scan import license_scan

    found = license_scan(table(spark, folder, "documents"))
    said = F.transform("places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    shares = F.array_max(F.transform("spans", lambda s: s["share"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"), joined(said).alias("base_labels"),
        joined(F.concat(said, F.transform("spans", lambda s: s["label"]))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(shares, F.lit(0.0))).alias("score"),
    )
