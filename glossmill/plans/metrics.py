"""Queries over translation metrics, inference and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import bleu, chrf, evaluation, inference, ter
from glossmill.operators.pairs import align
from glossmill.plans import query
from glossmill.plans.inputs import SQL_DOCUMENT_PAIRS, document_pairs, line_pairs, table, texts


def sql_tokens(text: str) -> str:
    """The 13a tokenizer in SQL, rule by rule as published."""
    steps = [
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ]
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        text = f"replace({text}, '{old}', '{new}')"
    text = f"' ' || {text} || ' '"
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return rf"list_filter(string_split(regexp_replace({text}, '\s+', ' ', 'g'), ' '), lambda w: w <> '')"


def sql_bleu(by: str, pairs: str = SQL_DOCUMENT_PAIRS, key: str = "doc_id") -> str:
    """BLEU statistics and score per group in SQL. ``by`` is an expression over the pairs."""
    return rf"""
{pairs}, tok AS MATERIALIZED (SELECT {key} AS id, {by} AS grp, {sql_tokens("hypothesis")} AS h, {sql_tokens("reference")} AS r FROM pairs),
words AS (
  SELECT id, 0 AS side, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM tok
  UNION ALL
  SELECT id, 1, unnest(r), generate_subscripts(r, 1) FROM tok),
following AS (
  SELECT id, side, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4 FROM words
  WINDOW z AS (PARTITION BY id, side ORDER BY i)),
grams AS (
  SELECT id, side, 1 AS n, w1 AS g FROM following
  UNION ALL SELECT id, side, 2, w1 || chr(1) || w2 FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT id, side, 3, w1 || chr(1) || w2 || chr(1) || w3 FROM following WHERE w3 IS NOT NULL
  UNION ALL SELECT id, side, 4, w1 || chr(1) || w2 || chr(1) || w3 || chr(1) || w4 FROM following WHERE w4 IS NOT NULL),
counted AS (SELECT id, n, g, count(*) FILTER (side = 0) AS ch, count(*) FILTER (side = 1) AS cr FROM grams GROUP BY id, n, g),
matched AS (SELECT id, n, sum(least(ch, cr)) AS m, sum(ch) AS t FROM counted GROUP BY id, n),
per_order AS (SELECT grp, n, CAST(sum(m) AS DOUBLE) AS m, CAST(sum(t) AS DOUBLE) AS t FROM matched JOIN tok USING (id) GROUP BY grp, n),
sizes AS (SELECT grp, sum(len(h)) AS sys_len, sum(len(r)) AS ref_len FROM tok GROUP BY grp),
stats AS (SELECT grp, sys_len, ref_len, coalesce(max(m) FILTER (n = 1), 0) AS m1, coalesce(max(m) FILTER (n = 2), 0) AS m2,
  coalesce(max(m) FILTER (n = 3), 0) AS m3, coalesce(max(m) FILTER (n = 4), 0) AS m4, coalesce(max(t) FILTER (n = 1), 0) AS t1,
  coalesce(max(t) FILTER (n = 2), 0) AS t2, coalesce(max(t) FILTER (n = 3), 0) AS t3, coalesce(max(t) FILTER (n = 4), 0) AS t4
  FROM sizes LEFT JOIN per_order USING (grp) GROUP BY grp, sys_len, ref_len),
scored AS (SELECT grp, CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len,
  CASE WHEN t1 = 0 THEN 0 WHEN m1 = 0 THEN 50 / t1 ELSE 100 * m1 / t1 END AS p1,
  CASE WHEN t2 = 0 THEN 0 WHEN m2 = 0 THEN 100 / (power(2, 1 + CAST(m1 = 0 AS INT)) * t2) ELSE 100 * m2 / t2 END AS p2,
  CASE WHEN t3 = 0 THEN 0 WHEN m3 = 0 THEN 100 / (power(2, 1 + CAST(m1 = 0 AS INT) + CAST(m2 = 0 AS INT)) * t3) ELSE 100 * m3 / t3 END AS p3,
  CASE WHEN t4 = 0 THEN 0 WHEN m4 = 0 THEN 100 / (power(2, 1 + CAST(m1 = 0 AS INT) + CAST(m2 = 0 AS INT) + CAST(m3 = 0 AS INT)) * t4) ELSE 100 * m4 / t4 END AS p4,
  CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / CAST(sys_len AS DOUBLE)) ELSE 0.0 END AS bp,
  m1 + m2 + m3 + m4 > 0 AND t4 > 0 AS usable FROM stats),
bleus AS (SELECT grp, sys_len, ref_len, p1, p2, p3, p4, bp, CASE WHEN usable AND least(p1, p2, p3, p4) > 0 THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0 END AS bleu FROM scored)
"""


BLEU_COLUMNS = ["bleu", "precision_1", "precision_2", "precision_3", "precision_4", "brevity_penalty"]
SQL_BLEU_COLUMNS = """round(bleu, 6) AS bleu, round(p1, 6) AS precision_1, round(p2, 6) AS precision_2, round(p3, 6) AS precision_3,
  round(p4, 6) AS precision_4, round(bp, 6) AS brevity_penalty, sys_len, ref_len"""


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("corpus_bleu", f"WITH {sql_bleu('1')} SELECT {SQL_BLEU_COLUMNS}, 'nrefs:1|case:mixed|eff:no|tok:13a|smooth:exp' AS signature FROM bleus")
def corpus_bleu(spark, folder):
    return rounded(bleu.corpus_bleu(document_pairs(spark, folder)), BLEU_COLUMNS)


@query("corpus_bleu_by_lang", f"WITH {sql_bleu('lang')} SELECT grp AS lang, {SQL_BLEU_COLUMNS} FROM bleus")
def corpus_bleu_by_lang(spark, folder):
    pairs = document_pairs(spark, folder)
    aligned = align(pairs.select("doc_id", "hypothesis"), pairs.select("doc_id", "lang", "reference"), ["doc_id"])
    return rounded(bleu.corpus_bleu(aligned, ["lang"]), BLEU_COLUMNS).drop("signature")


@query("kfold_bleu", f"""
WITH {sql_bleu('doc_id % 5')}, folds AS (SELECT count(*) AS folds, avg(bleu) AS mean_bleu, stddev_pop(bleu) AS std_bleu FROM bleus)
SELECT folds, round(mean_bleu, 6) AS mean_bleu, round(std_bleu, 6) AS std_bleu,
  (SELECT round(bleu, 6) FROM (WITH {sql_bleu('1')} SELECT bleu FROM bleus)) AS overall_bleu FROM folds
""")
def kfold_bleu(spark, folder):
    folds = document_pairs(spark, folder).withColumn("fold", F.col("doc_id") % 5)
    return rounded(bleu.kfold_bleu(folds), ["mean_bleu", "std_bleu", "overall_bleu"])


@query("sentence_bleu", f"WITH {sql_bleu('doc_id')} SELECT grp AS doc_id, round(bleu, 6) AS bleu FROM bleus")
def sentence_bleu(spark, folder):
    return rounded(bleu.sentence_bleu(document_pairs(spark, folder)), ["bleu"]).select("doc_id", "bleu")


@query("worst_best_sentences", f"""
WITH {sql_bleu('doc_id')}, s AS (SELECT grp AS doc_id, round(bleu, 6) AS bleu FROM bleus)
, ends AS (SELECT * FROM (SELECT doc_id, bleu, 'worst' AS side FROM s ORDER BY bleu, doc_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT doc_id, bleu, 'best' FROM s ORDER BY bleu DESC, doc_id DESC LIMIT 10))
SELECT e.doc_id, e.bleu, e.side, p.hypothesis, p.reference FROM ends e JOIN pairs p ON e.doc_id = p.doc_id
""")
def worst_best_sentences(spark, folder):
    scored = rounded(bleu.sentence_bleu(document_pairs(spark, folder)), ["bleu"])
    return bleu.worst_and_best(scored.select("doc_id", "bleu", "hypothesis", "reference"), 10, "doc_id")


SQL_MODEL_PAIRS = """
pairs AS (SELECT conv_id * 100 + turn + m * 10000000 AS doc_id, m, text AS reference,
  CASE m WHEN 0 THEN text WHEN 1 THEN lower(text) ELSE regexp_replace(text, '^[^ ]* ', '') END AS hypothesis FROM conversations, range(3) t(m))
"""


@query("compare_models", f"""
WITH {sql_bleu('m', SQL_MODEL_PAIRS)}
SELECT CASE grp WHEN 0 THEN 'copy' WHEN 1 THEN 'lower' ELSE 'drop' END AS model, round(1.0 / 3, 6) AS weight, round(bleu, 6) AS bleu, sys_len, ref_len FROM bleus
""")
def compare_models(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("reference"))
    text = F.col("reference")
    models = {"copy": text, "lower": F.lower(text), "drop": F.regexp_replace(text, "^[^ ]* ", "")}
    compared = rounded(inference.compare_models(turns, models), ["bleu", "weight"])
    return compared.select("model", "weight", "bleu", "sys_len", "ref_len")


def sql_chrf() -> str:
    chars = r"regexp_extract_all(regexp_replace({}, '\s+', '', 'g'), '(?s).')"
    leads = ", ".join(f"lead(w, {n}) OVER z AS w{n + 1}" for n in range(1, 6))
    orders = " UNION ALL ".join(
        f"SELECT id, side, {n} AS n, {' || '.join(f'w{k}' for k in range(1, n + 1))} AS g FROM following WHERE w{n} IS NOT NULL" for n in range(1, 7)
    )
    return rf"""
{SQL_DOCUMENT_PAIRS}, c AS MATERIALIZED (SELECT doc_id AS id, lang, {chars.format("hypothesis")} AS hyp, {chars.format("reference")} AS ref FROM pairs),
letters AS (
  SELECT id, 0 AS side, unnest(hyp) AS w, generate_subscripts(hyp, 1) AS i FROM c
  UNION ALL
  SELECT id, 1, unnest(ref), generate_subscripts(ref, 1) FROM c),
following AS (SELECT id, side, w AS w1, {leads} FROM letters WINDOW z AS (PARTITION BY id, side ORDER BY i)),
grams AS ({orders}),
counted AS (SELECT id, n, g, count(*) FILTER (side = 0) AS ch, count(*) FILTER (side = 1) AS cr FROM grams GROUP BY id, n, g),
matched AS (SELECT id, n, sum(least(ch, cr)) AS m, sum(ch) AS h, sum(cr) AS r FROM counted GROUP BY id, n),
per_order AS (SELECT lang, n, sum(m) AS m, CAST(sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS DOUBLE) AS h, CAST(sum(r) AS DOUBLE) AS r FROM matched JOIN c USING (id) GROUP BY lang, n),
means AS (SELECT lang, avg(m / h) AS p, avg(m / r) AS q FROM per_order WHERE h > 0 AND r > 0 GROUP BY lang)
"""


@query("corpus_chrf", f"WITH {sql_chrf()} SELECT lang, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM means")
def corpus_chrf(spark, folder):
    return rounded(chrf.corpus_chrf(document_pairs(spark, folder), ["lang"]), ["chrf"]).select("lang", "chrf")


@query("evaluate_by_lang", f"""
SELECT b.*, c.chrf, e.exact, e.pairs
FROM (WITH {sql_bleu('lang')} SELECT grp AS lang, {SQL_BLEU_COLUMNS} FROM bleus) b
JOIN (WITH {sql_chrf()} SELECT lang, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf FROM means) c ON b.lang = c.lang
JOIN (WITH {SQL_DOCUMENT_PAIRS} SELECT lang, round(100.0 * sum(CASE WHEN hypothesis = reference THEN 1 ELSE 0 END) / count(*), 6) AS exact, count(*) AS pairs
  FROM pairs GROUP BY lang) e ON b.lang = e.lang
""")
def evaluate_by_lang(spark, folder):
    scores = evaluation.evaluate(document_pairs(spark, folder), ["bleu", "chrf", "exact"], ["lang"])
    return rounded(scores, [*BLEU_COLUMNS, "chrf", "exact"]).drop("signatures")


def sql_chrf_words() -> str:
    """The character orders of ``sql_chrf`` and two word orders; a mark at the end of a word, else one at its start, stands alone."""
    mark = r"'^[!-/:-@\[-`{-~]$'"
    cut = f"""CASE WHEN length(w) > 1 AND regexp_matches(right(w, 1), {mark}) THEN [left(w, -1), right(w, 1)]
      WHEN length(w) > 1 AND regexp_matches(left(w, 1), {mark}) THEN [left(w, 1), right(w, -1)] ELSE [w] END"""
    return rf"""
{sql_chrf()}, sides AS (SELECT doc_id AS id, 0 AS side, hypothesis AS t FROM pairs UNION ALL SELECT doc_id, 1, reference FROM pairs),
cut_words AS (SELECT id, side, flatten(list_transform(list_filter(string_split(regexp_replace(t, '\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: {cut})) AS ws FROM sides),
placed AS (SELECT id, side, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut_words),
next_words AS (SELECT id, side, w, lead(w) OVER (PARTITION BY id, side ORDER BY i) AS v FROM placed),
word_grams AS (SELECT id, side, 7 AS n, w AS g FROM next_words UNION ALL SELECT id, side, 8, w || ' ' || v FROM next_words WHERE v IS NOT NULL),
word_counts AS (SELECT id, n, g, count(*) FILTER (side = 0) AS ch, count(*) FILTER (side = 1) AS cr FROM word_grams GROUP BY id, n, g),
word_matches AS (SELECT id, n, sum(least(ch, cr)) AS m, sum(ch) AS h, sum(cr) AS r FROM word_counts GROUP BY id, n),
all_orders AS (
  SELECT lang, n, m, h, r FROM per_order
  UNION ALL
  SELECT lang, n, sum(m), CAST(sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS DOUBLE), CAST(sum(r) AS DOUBLE) FROM word_matches JOIN c USING (id) GROUP BY lang, n),
word_means AS (SELECT lang, avg(m / h) AS p, avg(m / r) AS q FROM all_orders WHERE h > 0 AND r > 0 GROUP BY lang)
"""


@query("corpus_chrf_words", f"""
WITH {sql_chrf_words()}
SELECT lang, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0 END, 6) AS chrf, 'nrefs:1|case:mixed|eff:yes|nc:6|nw:2|space:no' AS signature FROM word_means
""")
def corpus_chrf_words(spark, folder):
    return rounded(chrf.corpus_chrf(document_pairs(spark, folder), ["lang"], word_order=2), ["chrf"])


@query("corpus_ter")
def corpus_ter(spark, folder):
    return ter.corpus_ter(line_pairs(spark, folder), ["lang"])


@query("batch_infer_dummy", """
SELECT doc_id, trim(regexp_replace(replace('to english: ' || text, ' the ', ' le '), '\\s+', ' ', 'g')) AS prediction
FROM documents WHERE NOT contains(text, '(')
UNION ALL
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace('to english: ' || text, ' the ', ' le '), '\\s*\\(\\s*s\\s*\\)\\s*', 's ', 'g'),
  '\\s*\\(\\s*(or|and)\\s*\\)\\s*', ' \\1 ', 'g'), '\\s*\\(\\s*(ki|d|m|f|lu|munus)\\s*\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g'))
FROM documents WHERE contains(text, '(')
""")
def batch_infer_dummy(spark, folder):
    documents = texts(spark, folder, "doc_id", "text")

    def make_predict():
        return lambda texts: [t.replace(" the ", " le ") for t in texts]

    predicted = inference.batch_infer(documents, make_predict, "text", prefix="to english: ", clean="light")
    return predicted.select("doc_id", "prediction")
