"""Queries of the rule packs over a corpus of scripts: each script is put together from lines by the key of a part.

The SQL renders the same text and matches the patterns on it, so that every rule is seen to fire and not to fire.
"""

from __future__ import annotations

from dataclasses import replace

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.operators import rulepacks, rules
from glossmill.plans import query
from glossmill.plans.inputs import table

# (modulus, remainder, line): a script has the line if its key has the remainder.
LINES = [
    (2, 0, "data = open('/kaggle/input/corpus/a.csv')"),
    (3, 0, "requests.get(url)"),
    (9, 3, "# kaggle internet on"),
    (5, 0, "base = '/content/drive/x'"),
    (10, 5, "drive.mount('/content/drive')"),
    (7, 0, "bucket = 'gs://b/x'"),
    (11, 0, "# --- INJECTION POINT: a"),
    (22, 11, "x = 1\ny = 2\n# --- END INJECTION POINT"),
    (4, 1, "import sacrebleu"),
    (8, 5, "!pip install -q sacrebleu"),
    (6, 1, "cfg = LoraConfig(r=8)"),
    (12, 7, "!pip install peft"),
    (13, 2, "acc = Accelerator()"),
    (13, 3, "m = ORTModel.load(p)"),
    (13, 4, "ds = load(streaming = True)"),
    (13, 5, "study = create_study()"),
    (3, 1, "trainer = Seq2SeqTrainer(model=m, tokenizer=tokenizer)"),
    (6, 4, "trainer = Seq2SeqTrainer(model=m, processing_class=tokenizer)"),
    (7, 1, "args = dict(evaluation_strategy='epoch')"),
    (7, 2, "with tok.as_target_tokenizer(): pass"),
    (7, 3, "m = AutoModel.from_pretrained('a', use_auth_token=True)"),
    (7, 4, "def lambda(x): pass"),
    (7, 5, "print 'old'"),
    (7, 6, "\t  z = 1"),
    (5, 1, "sub.to_csv('out/submission.csv', index=False)"),
    (5, 2, "sub.to_csv('submission.csv')"),
    (3, 2, "sub = pd.DataFrame({'id': i, 'translation': t})"),
    (4, 3, "args['metric_for_best_model'] = 'x'\nmetric_for_best_model = 'chrF'"),
    (8, 3, "def compute_metrics(p): return {}"),
    (16, 3, "t = Trainer(model=m, compute_metrics=compute_metrics)"),
    (9, 1, "metric_for_best_model = 'eval_loss'"),
    (11, 1, "trainer.save_model('m')"),
    (11, 2, "torch.save(m, p)\nkagglehub.model_upload(handle='a/b/c/d')"),
    (11, 3, "p = kagglehub.model_download('a/b/c')"),
    (11, 4, "p = kagglehub.model_download('a/b/c/d')"),
    (10, 3, "frame = read('own-set')\nrow['source']"),
    (20, 3, "row['src'], row['tgt'], row['target']"),
    (30, 3, "frame = frame.rename(columns=names)"),
]


def script() -> Column:
    parts = [F.when(F.col("p_partkey") % m == r, F.lit(line + "\n")).otherwise("") for m, r, line in LINES]
    return reduce(lambda a, b: F.concat(a, b), parts)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


SCRIPTS = "s AS (SELECT p_partkey, " + " || ".join(f"CASE WHEN p_partkey % {m} = {r} THEN {_text(line)} || chr(10) ELSE '' END" for m, r, line in LINES) + " AS code FROM part)"


def corpus(spark, folder):
    return table(spark, folder, "part").select("p_partkey", script().alias("code"))


def has(*patterns: str) -> str:
    """Whether any pattern is found, in SQL."""
    return "(" + " OR ".join(f"regexp_matches(code, '{p.replace("'", "''")}')" for p in patterns) + ")"


def _condition(rule: rules.Rule) -> str:
    parts = [has(*rule.any_of)] if rule.any_of else []
    parts += [has(p) for p in rule.all_of]
    parts += [f"NOT {has(*rule.none_of)}"] if rule.none_of else []
    return " AND ".join(parts)


def _rule_sql(pack: list[rules.Rule]) -> str:
    rows = [f"SELECT p_partkey, '{r.category}' AS category, '{r.code}' AS code, '{r.severity}' AS severity, '{r.message.replace("'", "''")}' AS message FROM s WHERE {_condition(r)}" for r in pack]
    return f"WITH {SCRIPTS} " + " UNION ALL ".join(rows)


PLATFORMS = [r for pack in rulepacks.PLATFORM.values() for r in pack] + rulepacks.INJECTION_POINTS
# Two rules look ahead from a line's end for a sign on the same line. None can follow there, so SQL, whose pattern engine
# cannot look ahead, checks them without it.
SQL_SYNTAX = [replace(r, any_of=[p.split("(?!")[0] for p in r.any_of]) for r in rulepacks.SYNTAX]


def _scan(spark, folder, pack):
    found = rules.rule_scan(corpus(spark, folder), ["p_partkey"], "code", pack)
    return found.select("p_partkey", "category", "code", "severity", "message")


@query("platform_rules", _rule_sql(PLATFORMS))
def platform_rules(spark, folder):
    return _scan(spark, folder, PLATFORMS)


@query("deprecation_rules", _rule_sql(rulepacks.DEPRECATIONS))
def deprecation_rules(spark, folder):
    return _scan(spark, folder, rulepacks.DEPRECATIONS)


@query("syntax_rules", _rule_sql(SQL_SYNTAX))
def syntax_rules(spark, folder):
    return _scan(spark, folder, rulepacks.SYNTAX)


@query("tool_dependencies", _rule_sql(rulepacks.TOOL_DEPENDENCIES))
def tool_dependencies(spark, folder):
    return _scan(spark, folder, rulepacks.TOOL_DEPENDENCIES)


EXPECTED = ["sacrebleu", "qlora", "accelerate", "onnx", "streaming", "hpo"]


@query("expected_tools", f"WITH {SCRIPTS} " + " UNION ALL ".join(
    f"SELECT p_partkey, 'MISSING_TOOL' AS code, 'expected tool {tool} not found' AS message FROM s WHERE NOT {has(rulepacks.TOOLS[tool])}" for tool in EXPECTED))
def expected_tools(spark, folder):
    found = rules.explode_findings(corpus(spark, folder), ["p_partkey"], rulepacks.expected_tools("code", EXPECTED))
    return found.select("p_partkey", "code", "message")


def _pack_sql(rows: list[tuple[str, str, str]]) -> str:
    return f"WITH {SCRIPTS} " + " UNION ALL ".join(f"SELECT p_partkey, '{code}' AS code, '{severity}' AS severity FROM s WHERE {where}" for code, severity, where in rows)


def _pack(spark, folder, pack: Column):
    return rules.explode_findings(corpus(spark, folder), ["p_partkey"], pack).select("p_partkey", "code", "severity")


WRITES = r"""(?i)\.to_csv\s*\(\s*["'].*submission\.csv["']|open\s*\(\s*["'].*submission\.csv["']|submission.*\.to_csv|pd\.DataFrame.*\.to_csv.*submission"""
ID, TRANSLATION = r"""["']id["']|\bid\b\s*[=:]""", r"""["']translation["']|translation\s*[=:]"""


@query("submission_pack", _pack_sql([
    ("SUBMISSION_OUTPUT", "error", f"NOT {has(WRITES)}"),
    ("SUBMISSION_FORMAT", "warning", f"{has(WRITES)} AND NOT ({has(ID)} AND {has(TRANSLATION)})"),
    ("SUBMISSION_OUTPUT", "pass", f"{has(WRITES)} AND {has(ID)} AND {has(TRANSLATION)}"),
    ("CSV_INDEX", "warning", f"{has(WRITES)} AND NOT {has(r'(?i)index\s*=\s*False')}"),
]))
def submission_pack(spark, folder):
    return _pack(spark, folder, rulepacks.submission_findings("code"))


SAVES = r"(?i)\.save_model\s*\(|model\.save_pretrained\s*\(|torch\.save\s*\("
UPLOADS, DOWNLOADS = r"(?i)model_upload\s*\(\s*handle\s*=|kagglehub\.model_upload\s*\(", r"(?i)kagglehub\.model_download\s*\("


@query("model_pack", _pack_sql([
    ("MODEL_SAVE", "error", f"NOT {has(SAVES)}"),
    ("MODEL_REGISTRY", "warning", f"{has(SAVES)} AND NOT {has(UPLOADS)}"),
    ("MODEL_REGISTRY", "pass", f"{has(SAVES)} AND {has(UPLOADS)}"),
    ("MODEL_SOURCE", "pass", has(DOWNLOADS)),
    ("MODEL_HANDLE", "warning", f"{has(DOWNLOADS)} AND len(string_split(regexp_extract(code, 'model_download\\(''([^'']+)''', 1), '/')) < 4"),
]))
def model_pack(spark, folder):
    return _pack(spark, folder, rulepacks.model_findings("code"))


METRIC = """lower(regexp_extract(code, 'metric_for_best_model["'']?\\s*[=:]\\s*["'']([^"'']+)["'']', 1))"""
CUSTOM = f"({METRIC} NOT IN ('', 'loss', 'eval_loss') AND regexp_matches({METRIC}, 'chrf|bleu|rouge|meteor|accuracy|f1'))"
DEFINED, PASSED = has(r"def\s+compute_metrics\s*\("), has(r"Trainer\s*\([\s\S]*?compute_metrics\s*=")


@query("metrics_pack", _pack_sql([
    ("COMPUTE_METRICS", "error", f"{CUSTOM} AND NOT {DEFINED}"),
    ("COMPUTE_METRICS", "error", f"{CUSTOM} AND {DEFINED} AND NOT {PASSED}"),
    ("COMPUTE_METRICS", "pass", f"{CUSTOM} AND {DEFINED} AND {PASSED}"),
]))
def metrics_pack(spark, folder):
    return _pack(spark, folder, rulepacks.compute_metrics_findings("code"))


USES, RENAMES = "contains(code, 'own-set')", has(r"\.rename\s*\(\s*columns\s*=|column_mapping\s*=")
READS = {name: has(rf"""\[["']{name}["']\]""") for name in ("source", "src", "tgt")}


@query("pair_columns_pack", _pack_sql([
    ("PAIR_COLUMNS", "error", f"{USES} AND {READS['source']} AND NOT {RENAMES} AND NOT {READS['src']}"),
    ("PAIR_COLUMNS", "pass", f"{USES} AND {RENAMES}"),
    ("PAIR_COLUMNS", "pass", f"{USES} AND {READS['src']} AND {READS['tgt']}"),
]))
def pair_columns_pack(spark, folder):
    return _pack(spark, folder, rulepacks.pair_column_findings("code", "own-set", "src", "tgt"))


KIND = "CASE p_partkey % 4 WHEN 0 THEN 'inference' WHEN 1 THEN 'training' WHEN 2 THEN 'mixed' END"


@query("preflight_kinds", f"""
WITH {SCRIPTS}, k AS (SELECT *, {KIND} AS kind FROM s)
SELECT p_partkey, 'SUBMISSION_OUTPUT' AS code FROM k WHERE kind IN ('inference', 'mixed') AND NOT {has(WRITES)}
UNION ALL SELECT p_partkey, 'MODEL_SAVE' FROM k WHERE kind IN ('training', 'mixed') AND NOT {has(SAVES)}
UNION ALL SELECT p_partkey, 'EVALUATION_STRATEGY' FROM k WHERE {has('evaluation_strategy *=')}
UNION ALL SELECT p_partkey, 'PAIR_COLUMNS' FROM k WHERE {USES} AND {READS['source']} AND NOT {RENAMES} AND NOT {READS['src']}
""")
def preflight_kinds(spark, folder):
    """Errors of the packs that depend on a script's kind, of one that always runs, and of the column pack."""
    code = corpus(spark, folder)
    metadata = code.select("p_partkey", F.expr(KIND).alias("kind"), F.lit(True).alias("enable_internet"), F.array(F.lit("me/corpus")).alias("attached"))
    found = rulepacks.preflight(code, metadata, "p_partkey", "code", pair_columns=[("own-set", "src", "tgt")])
    codes = ["SUBMISSION_OUTPUT", "MODEL_SAVE", "EVALUATION_STRATEGY", "PAIR_COLUMNS"]
    return found.where(F.col("code").isin(codes) & (F.col("severity") == "error")).select("p_partkey", "code")
