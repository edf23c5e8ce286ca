"""Queries over the text and name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.functions import names, numbers, scores, status, text
from glossmill.plans import query
from glossmill.plans.inputs import SQL_STATUS, run_status, table, texts


@query("slugify_parts", r"""
SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  regexp_replace(lower(p_name || ' ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g') AS raw_slug
FROM part
""")
def slugify_parts(spark, folder):
    name = F.concat_ws("", "p_name", F.lit(" "), "p_brand", F.lit("!"))
    return table(spark, folder, "part").select("p_partkey", names.slugify(name).alias("slug"), names.slugify(name, trim=False).alias("raw_slug"))


STRATEGIES = "CASE p_partkey % 4 WHEN 0 THEN 'semver' WHEN 1 THEN 'experiment' WHEN 2 THEN 'timestamp' ELSE 'overwrite' END"


@query("versioned_slug", rf"""
WITH p AS (SELECT *, {STRATEGIES} AS strategy,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.1' ELSE CAST(p_size AS VARCHAR) END AS version,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey * 61) AS moment FROM part)
SELECT p_partkey, CASE strategy WHEN 'semver' THEN base || '-v' || replace(version, '.', '-')
  WHEN 'experiment' THEN base || '-exp-' || CASE WHEN length(version) < 2 THEN '0' || version ELSE version END
  WHEN 'timestamp' THEN base || '-' || strftime(moment, '%Y%m%d-%H%M%S') ELSE base END AS slug
FROM p
""")
def versioned_slug(spark, folder):
    size = F.col("p_size").cast("string")
    dotted = F.concat(size, F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".1"))
    version = F.when(F.col("p_partkey") % 4 == 0, dotted).otherwise(size)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 61)
    slug = names.versioned_slug("p_name", version, F.expr(STRATEGIES), at)
    return table(spark, folder, "part").select("p_partkey", slug.alias("slug"))


@query("bump_version", """
WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 9 AS b, p_partkey % 3 AS n FROM part)
SELECT p_partkey,
  CASE n WHEN 0 THEN CAST(a AS VARCHAR) || '.0.1' WHEN 1 THEN CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || '.1'
    ELSE CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || '.3' END AS patched,
  CASE n WHEN 0 THEN CAST(a AS VARCHAR) || '.1.0' ELSE CAST(a AS VARCHAR) || '.' || CAST(b + 1 AS VARCHAR) || '.0' END AS minor,
  CAST(a + 1 AS VARCHAR) || '.0.0' AS major, CAST(a + 1 AS VARCHAR) AS counted
FROM p
""")
def bump_version(spark, folder):
    a, b = F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")
    kind = F.col("p_partkey") % 3
    version = F.when(kind == 0, a).when(kind == 1, F.concat_ws(".", a, b)).otherwise(F.concat_ws(".", a, b, F.lit("2")))
    semver = F.lit("semver")
    return table(spark, folder, "part").select(
        "p_partkey",
        names.bump_version(version, semver).alias("patched"),
        names.bump_version(version, semver, "minor").alias("minor"),
        names.bump_version(version, semver, "major").alias("major"),
        names.bump_version(version, F.lit("experiment")).alias("counted"),
    )


@query("parse_refs", """
SELECT o_orderkey, 'set-' || CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 11 END AS version,
  'set-' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 11 > 0 THEN ':' || CAST(o_orderkey % 11 AS VARCHAR) ELSE '' END AS formatted
FROM orders
""")
def parse_refs(spark, folder):
    suffix = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(":"), (F.col("o_orderkey") % 11).cast("string"))).otherwise("")
    ref = F.concat(F.lit("set-"), F.col("o_custkey").cast("string"), suffix)
    parsed = table(spark, folder, "orders").select("o_orderkey", names.parse_ref(ref).alias("r"))
    return parsed.select("o_orderkey", "r.name", "r.version", names.format_ref("r.name", "r.version").alias("formatted"))


HANDLES = """CASE p_partkey % 3 WHEN 0 THEN p_brand || '/' || p_name WHEN 1 THEN p_brand || '/' || p_name || '/jax/' || p_type
  ELSE p_brand || '/' || p_name || '/jax/' || p_type || '/' || CAST(p_size AS STRING) END"""


@query("parse_handles", f"""
WITH h AS (SELECT p_partkey, {HANDLES} AS handle FROM part), s AS (SELECT *, string_split(handle, '/') AS parts FROM h)
SELECT p_partkey, CASE WHEN len(parts) BETWEEN 4 AND 5 THEN parts[1] END AS owner,
  CASE WHEN len(parts) = 5 THEN parts[5] END AS version, parts[2] AS model,
  CASE WHEN len(parts) >= 4 THEN parts[3] ELSE 'transformers' END AS framework,
  CASE WHEN len(parts) >= 4 THEN handle ELSE handle || '/transformers/default' END AS full_handle
FROM s
""")
def parse_handles(spark, folder):
    handles = table(spark, folder, "part").select("p_partkey", F.expr(HANDLES).alias("handle"))
    both = handles.select("p_partkey", names.parse_handle("handle").alias("s"), names.parse_handle("handle", lenient=True).alias("l"))
    return both.select("p_partkey", "s.owner", "s.version", "l.model", "l.framework", "l.full_handle")


@query("extract_version", r"""
WITH v AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '-v' || CAST(p_size AS VARCHAR) || '-0-' || CAST(p_partkey AS VARCHAR) ELSE '' END AS name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(regexp_extract(name, 'v([0-9]+-[0-9]+-[0-9]+)', 1), '-', '.') ELSE '1.0.0' END AS version FROM v
""")
def extract_version(spark, folder):
    suffix = F.concat(F.lit("-v"), F.col("p_size").cast("string"), F.lit("-0-"), F.col("p_partkey").cast("string"))
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, suffix).otherwise(""))
    return table(spark, folder, "part").select("p_partkey", names.extract_version(name).alias("version"))


@query("detect_family", """
WITH n AS (SELECT p_partkey, p_type || '-' || CASE p_partkey % 7 WHEN 0 THEN 'ByT5-small' WHEN 1 THEN 'mt5' WHEN 2 THEN 'NLLB-200'
  WHEN 3 THEN 'qwen-consonant' WHEN 4 THEN 'gemma-enriched' WHEN 5 THEN 'flan-lexicon' ELSE 'other' END AS name FROM part)
SELECT p_partkey,
  CASE WHEN contains(lower(name), 'byt5') OR contains(lower(name), 'byte') THEN 'byt5'
    WHEN contains(lower(name), 't5') OR contains(lower(name), 'flan') THEN 't5' WHEN contains(lower(name), 'nllb') THEN 'nllb'
    WHEN contains(lower(name), 'qwen') THEN 'qwen' WHEN contains(lower(name), 'gemma') THEN 'gemma' END AS family,
  CASE WHEN contains(lower(name), 'skeleton') OR contains(lower(name), 'consonant') THEN 'consonantal'
    WHEN contains(lower(name), 'annotated') OR contains(lower(name), 'enriched') THEN 'annotated'
    WHEN contains(lower(name), 'lex') THEN 'lexicon' END AS preprocessing,
  contains(lower(name), 't5') AS task_prefix
FROM n
""")
def detect_family(spark, folder):
    kinds = ["ByT5-small", "mt5", "NLLB-200", "qwen-consonant", "gemma-enriched", "flan-lexicon", "other"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 7).cast("int"))
    name = F.concat("p_type", F.lit("-"), kind)
    return table(spark, folder, "part").select(
        "p_partkey",
        names.detect_by_rules(name, names.FAMILY_RULES).alias("family"),
        names.detect_by_rules(name, names.PREPROCESSING_RULES).alias("preprocessing"),
        names.needs_task_prefix(name).alias("task_prefix"),
    )


@query("url_parts", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages)
SELECT page_id, scheme, lower(host) AS host, path, len(list_filter(string_split(path, '/'), lambda p: p <> '')) AS depth,
  nullif(q, '') AS query, nullif(f, '') AS fragment FROM u
""")
def url_parts(spark, folder):
    parts = table(spark, folder, "pages").select("page_id", names.url_parts("url").alias("u"))
    return parts.select(
        "page_id", "u.scheme", "u.host", "u.path", F.size("u.parts").cast("bigint").alias("depth"), "u.query", F.col("u.fragment").alias("fragment")
    )


@query("code_urls", r"""
WITH c AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#.]*)', 1)) AS owner, CAST(page_id AS VARCHAR) AS n FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE owner || '/kernel-' || n END AS slug,
  CASE page_id % 4 WHEN 0 THEN n END AS version_id FROM c
""")
def code_urls(spark, folder):
    owner = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#.]*)", 1))
    number, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    slug = F.concat(owner, F.lit("/kernel-"), number)
    text_ = (
        F.when(kind == 0, F.concat(F.lit("https://www.kaggle.com/code/"), slug, F.lit("?scriptVersionId="), number))
        .when(kind == 1, F.concat(F.lit("kaggle.com/code/"), slug)).when(kind == 2, slug).otherwise(F.concat(F.lit("no slug "), number))
    )
    parsed = table(spark, folder, "pages").select("page_id", names.parse_code_url(text_).alias("p"))
    return parsed.select("page_id", "p.slug", "p.version_id")


@query("classify_sources", """
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '-') AS n, CASE p_partkey % 3 WHEN 0 THEN 'owner/' WHEN 1 THEN '' ELSE '/data/sets/' END || replace(p_name, ' ', '-') AS source FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'competition' ELSE 'local' END AS kind,
  CASE p_partkey % 3 WHEN 2 THEN n ELSE source END AS name,
  CASE p_partkey % 3 WHEN 2 THEN source ELSE '/kaggle/input/' || n || '/*.csv' END AS path FROM s
""")
def classify_sources(spark, folder):
    prefix = F.get(F.array(F.lit("owner/"), F.lit(""), F.lit("/data/sets/")), (F.col("p_partkey") % 3).cast("int"))
    source = F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("-")))
    parsed = table(spark, folder, "part").select("p_partkey", names.classify_source(source).alias("s"))
    return parsed.select("p_partkey", "s.kind", "s.name", "s.path")


@query("status_normalise", """
SELECT event_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelled' WHEN 'purchase' THEN 'complete' ELSE 'error' END AS kernel,
  CASE event_type WHEN 'purchase' THEN 'FINISHED' WHEN 'click' THEN 'FAILED' ELSE 'FAILED' END AS tracking,
  CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'pending' ELSE 'error' END AS submission,
  upper(event_type) AS job
FROM events
""")
def status_normalise(spark, folder):
    event = F.col("event_type")
    raw = (
        F.when(event == "view", "RUNNING").when(event == "click", "cancelAcknowledged").when(event == "purchase", "Complete")
        .when(event == "signup", "SubmissionStatus.PENDING").otherwise(event)
    )
    message = F.concat(F.lit('a/b has status "KernelWorkerStatus.'), raw, F.lit('"'))
    return table(spark, folder, "events").select(
        "event_id",
        status.status_from_message(message).alias("kernel"),
        status.normalise_status(raw, "tracking").alias("tracking"),
        status.normalise_status(raw, "submission").alias("submission"),
        status.normalise_status(F.concat(F.lit("JOB_STATE_"), F.upper("event_type")), "job").alias("job"),
    )


@query("infer_phase", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'evaluating' WHEN user_id % 3 = 0 THEN 'completed' WHEN value > 50 THEN 'training' ELSE 'not_started' END AS phase
FROM events
""")
def infer_phase(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        status.infer_phase(
            F.when(F.col("event_type") == "signup", "evaluating"), F.col("user_id") % 3 == 0, F.when(F.col("value") > 50, "checkpoint-1")
        ).alias("phase"),
    )


@query("human_bytes", """
WITH b AS (SELECT o_orderkey, floor(o_totalprice * power(o_orderkey % 5 + 1, 9)) AS n FROM orders),
u AS (SELECT *, CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM b),
v AS (SELECT *, floor(n / power(1024.0, k) * 10 + 0.5) AS tenths FROM u)
SELECT o_orderkey, CAST(CAST(floor(tenths / 10) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(tenths % 10 AS BIGINT) AS VARCHAR) || ' ' ||
  CASE k WHEN 3 THEN 'GB' WHEN 2 THEN 'MB' WHEN 1 THEN 'KB' ELSE 'B' END AS size
FROM v
""")
def human_bytes(spark, folder):
    size = F.floor(F.col("o_totalprice") * F.pow(F.col("o_orderkey") % 5 + 1, F.lit(9)))
    return table(spark, folder, "orders").select("o_orderkey", numbers.human_bytes(size).alias("size"))


MARKED = "replace(replace(replace(replace(text, '. ', ' ( s ) . '), ', ', ' (ki) , '), ' the ', ' ( or the ) '), ' and ', ' ( and ) ')"


@query("clean_translation_full", rf"""
WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*s\s*\)', 's', 'g') AS t FROM m),
b AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*(or|and)\s+([^)]+)\s*\)\s*', ' \1 \2 ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*(or|and|i\.e\.|etc\.)\s*\)\s*', ' \1 ', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '(?i)\s*\(\s*(ki|m|f|d|pl|sg|lú|giš|kur|uru)\s*\)', '', 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*[a-z]{{1,3}}\s*\)', '', 'g') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g') AS t FROM e)
SELECT doc_id, trim(regexp_replace(t, '([.,;:!?])([A-Za-z])', '\1 \2', 'g')) AS cleaned FROM f
""")
def clean_translation_full(spark, folder):
    documents = texts(spark, folder, "doc_id", "text").select("doc_id", F.expr(MARKED).alias("t"))
    return documents.select("doc_id", text.clean_translation("t", "full").alias("cleaned"))


@query("clean_translation_light", rf"""
WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*s\s*\)\s*', 's ', 'g') AS t FROM m),
b AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*(or|and)\s*\)\s*', ' \1 ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '\s*\(\s*(ki|d|m|f|lu|munus)\s*\)\s*', ' ', 'g') AS t FROM b)
SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS cleaned FROM c
""")
def clean_translation_light(spark, folder):
    documents = texts(spark, folder, "doc_id", "text").select("doc_id", F.expr(MARKED).alias("t"))
    return documents.select("doc_id", text.clean_translation("t", "light").alias("cleaned"))


@query("consonant_skeleton", r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace('(d)' || text || ' LUGAL ₂. 3,5', '\s+', ' ', 'g')), ' ') AS words FROM documents),
s AS (SELECT doc_id, list_transform(words, lambda x:
  CASE WHEN regexp_matches(translate(x, '.₀₁₂₃₄₅₆₇₈₉ₓ', ''), '\p{Lu}') AND NOT regexp_matches(translate(x, '.₀₁₂₃₄₅₆₇₈₉ₓ', ''), '\p{Ll}') THEN x
    WHEN regexp_full_match(replace(x, ',', '.'), '[\d.,/]+|[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?(?i:inf|infinity|nan)') THEN x
    ELSE coalesce(nullif(regexp_replace(translate(regexp_replace(x, '^\([a-zA-Z]{1,3}\)', ''), '₀₁₂₃₄₅₆₇₈₉ₓ', ''), '(?i)[aeiuāēīūâêîûàèìùáéíú]|-', '', 'g'), ''), '_') END) AS words FROM w)
SELECT doc_id, array_to_string(words, ' ') AS skeleton FROM s
""")
def consonant_skeleton(spark, folder):
    marked = F.concat(F.lit("(d)"), F.col("text"), F.lit(" LUGAL ₂. 3,5"))
    documents = texts(spark, folder, "doc_id", "text")
    return documents.select("doc_id", text.consonant_skeleton(marked).alias("skeleton"))


@query("extract_settings", r"""
WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, event_type || '-' || CAST(user_id AS VARCHAR) AS model_name, CASE WHEN user_id % 2 = 0 THEN CAST(k AS VARCHAR) END AS batch_size,
  CAST(user_id AS VARCHAR) AS num_epochs, CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END AS fp16, CAST(NULL AS VARCHAR) AS max_src_len
FROM e
""")
def extract_settings(spark, folder):
    k, user = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    code = F.concat(
        F.lit('CONFIG = {"model_name": "'), F.col("event_type"), F.lit("-"), user, F.lit('", '),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('"batch_size": '), k, F.lit(", "))).otherwise(""),
        F.lit("}\nnum_epochs="), user, F.when(F.col("event_type") == "view", F.lit("\nfp16=True")).otherwise(""),
    )
    found = table(spark, folder, "events").select("event_id", text.extract_settings(code).alias("s"))
    wanted = ["model_name", "batch_size", "num_epochs", "fp16", "max_src_len"]
    return found.select("event_id", *[F.try_element_at("s", F.lit(name)).alias(name) for name in wanted])


@query("combined_score", f"""
WITH {SQL_STATUS}
SELECT run, round(sqrt(nullif(bleu, 0) * nullif(chrf, 0)), 6) AS combined, coalesce(round(sqrt(nullif(bleu, 0) * nullif(chrf, 0)), 6), 0) AS combined_or_zero FROM status
""")
def combined_score(spark, folder):
    bleu, chrf = F.try_element_at("metrics", F.lit("bleu")), scores.first_nonzero("metrics", scores.CHRF_NAMES[:2])
    return run_status(spark, folder).select(
        "run",
        F.round(scores.combined_score(bleu, chrf), 6).alias("combined"),
        F.round(scores.combined_score(bleu, chrf, "zero"), 6).alias("combined_or_zero"),
    )


@query("score_bands", """
SELECT event_id,
  CASE WHEN value < 10 THEN 'very_low' WHEN value < 15 THEN 'below_baseline' WHEN value < 20 THEN 'near_baseline' WHEN value < 25 THEN 'competitive' ELSE 'strong' END AS bleu_band,
  CASE WHEN value / 10 > 2 THEN 'high' WHEN value / 10 > 1 THEN 'moderate' WHEN value / 10 < 0.5 THEN 'low' ELSE 'normal' END AS loss_band,
  value / (user_id + 1) > 1 AS slow,
  CASE WHEN value < 20 THEN 'tune_hyperparameters,augment_data,try_larger_model' ELSE 'submit_for_official_score,try_ensemble,optimise_inference' END ||
  CASE WHEN value / 10 > 2 THEN ',underfitting' WHEN value / 10 < 0.5 THEN ',check_overfitting' ELSE '' END ||
  CASE WHEN value / (user_id + 1) > 1 THEN ',speed_up_training' ELSE '' END || ',analyse_worst_predictions,compare_with_baselines' AS advice
FROM events
""")
def score_bands(spark, folder):
    value, loss, epochs = F.col("value"), F.col("value") / 10, F.col("user_id") + 1
    return table(spark, folder, "events").select(
        "event_id",
        scores.bleu_band(value).alias("bleu_band"),
        scores.loss_band(loss).alias("loss_band"),
        scores.slow_epochs(value, epochs).alias("slow"),
        F.array_join(scores.advice(value, loss, value, epochs), ",").alias("advice"),
    )


@query("metrics_text", f"""
WITH {SQL_STATUS}
SELECT run, array_to_string(list_filter([CASE WHEN bleu IS NOT NULL THEN 'bleu=' || printf('%.4f', bleu) END,
  CASE WHEN chrf IS NOT NULL THEN 'chrf_pp=' || printf('%.4f', chrf) END], lambda x: x IS NOT NULL), ', ') AS metrics FROM status
""")
def metrics_text(spark, folder):
    return run_status(spark, folder).select("run", scores.metrics_text("metrics").alias("metrics"))
