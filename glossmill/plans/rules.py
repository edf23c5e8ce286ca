"""Queries over rule scans: documents and pages with planted findings, and rendered scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import rulepacks, rules
from glossmill.plans import query
from glossmill.plans.inputs import table, texts

GITHUB, AWS = "ghp_" + "a1" * 18, "AKIA" + "Z9" * 8
PLANTED = f"""text || CASE WHEN doc_id % 50 = 0 THEN '\n token {GITHUB}' WHEN doc_id % 50 = 1 THEN '\n{AWS}'
  WHEN doc_id % 50 = 2 THEN '\nos.system(x + y)' WHEN doc_id % 50 = 3 THEN '\nsubprocess.call(a, shell = True)' ELSE '' END"""

SECRET_RULES = [
    ("HARDCODED_SECRET", "error", r"""(?i)["''][A-Za-z0-9_-]{20,}["''].*(?:key|token|secret|password|api)"""),
    ("HARDCODED_SECRET", "error", "AIza[A-Za-z0-9_-]{35}"),
    ("HARDCODED_SECRET", "error", "ghp_[A-Za-z0-9]{36}"),
    ("HARDCODED_SECRET", "error", "sk-[A-Za-z0-9]{48}"),
    ("HARDCODED_SECRET", "error", "AKIA[A-Z0-9]{16}"),
    ("SECURITY_RISK", "warning", r"subprocess\.call.*shell\s*=\s*True"),
    ("SECURITY_RISK", "warning", r"eval\s*\([^)]*input"),
    ("SECURITY_RISK", "warning", r"exec\s*\([^)]*input"),
    ("SECURITY_RISK", "warning", r"os\.system\s*\([^)]*\+"),
]
SQL_FOUND = "WITH d AS (SELECT doc_id, " + PLANTED + " AS t FROM documents), found AS (" + " UNION ALL ".join(
    f"SELECT doc_id, 'security' AS category, '{code}' AS code, '{severity}' AS severity, {number} AS rule FROM d WHERE regexp_matches(t, '{pattern}')"
    for number, (code, severity, pattern) in enumerate(SECRET_RULES)
) + ")"


def planted_findings(spark, folder):
    documents = texts(spark, folder, "doc_id", "text")
    documents = documents.select("doc_id", F.expr(PLANTED.replace("\\", "\\\\")).alias("t"))
    return rules.rule_scan(documents, ["doc_id"], "t", rulepacks.SECURITY)


@query("scan_secrets", SQL_FOUND + " SELECT doc_id, category, code, severity, count(*) AS findings FROM found GROUP BY ALL")
def scan_secrets(spark, folder):
    found = planted_findings(spark, folder)
    return found.groupBy("doc_id", "category", "code", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("readiness", SQL_FOUND + """, s AS (
  SELECT d.doc_id, count(f.rule) FILTER (f.severity = 'error') AS errors, count(f.rule) FILTER (f.severity = 'warning') AS warnings
  FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(CASE WHEN errors > 0 THEN 2 ELSE 3 END AS BIGINT) AS passed, errors, warnings,
  CAST(floor(100.0 * (CASE WHEN errors > 0 THEN 2 ELSE 3 END) / (CASE WHEN errors > 0 THEN 2 + errors ELSE 3 END) + 0.5) AS INTEGER) AS score,
  errors + warnings = 0 AS ready FROM s
""")
def readiness(spark, folder):
    documents = table(spark, folder, "documents")
    return rules.readiness(documents, planted_findings(spark, folder), "doc_id", ["config", "syntax", "security"], strict=True)


@query("worst_status", SQL_FOUND + """
SELECT doc_id, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'fail' ELSE 'warn' END AS status FROM found GROUP BY doc_id
""")
def worst_status(spark, folder):
    return rules.worst_status(planted_findings(spark, folder), ["doc_id"])


@query("finding_counts", SQL_FOUND + """
SELECT doc_id, category, CAST(0 AS BIGINT) AS passes, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors FROM found GROUP BY doc_id, category
""")
def finding_counts(spark, folder):
    return rules.category_counts(planted_findings(spark, folder), "doc_id")


@query("scan_template_vars", r"""
WITH d AS (SELECT doc_id, replace(replace(text, ' de ', ' {{de}} '), ' the ', ' {{the_word}} ') AS t FROM documents)
SELECT doc_id, 'undefined variable ' || v AS message FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\{\{(\w+)\}\}', 1)) AS v FROM d)
""")
def scan_template_vars(spark, folder):
    text = F.replace(F.replace("text", F.lit(" de "), F.lit(" {{de}} ")), F.lit(" the "), F.lit(" {{the_word}} "))
    found = rules.explode_findings(table(spark, folder, "documents"), ["doc_id"], rulepacks.template_variables(text))
    return found.select("doc_id", "message")


SCRIPTS = """'CONFIG = {' || CASE WHEN p_partkey % 2 = 0 THEN '"batch_size": 4, ' ELSE '' END || '"model_name": "' || p_name || '"}\n' ||
  CASE p_partkey % 5 WHEN 0 THEN 'import torch\n' WHEN 1 THEN 'from transformers import AutoModel\n!pip install "transformers>=4.0"\n'
    WHEN 2 THEN 'import optuna\nimport torch\n!pip install -q "pytorch"\n' WHEN 3 THEN 'from peft import LoraConfig\n' ELSE '' END ||
  CASE p_partkey % 3 WHEN 0 THEN 'BUCKET = "your-bucket"\n' WHEN 1 THEN 'X = "todo"\noutput_dir = 1\n' ELSE 'ID = "REPLACE_ME"' END"""


def scripts(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.expr(SCRIPTS).alias("code"))


SQL_SCRIPTS = "s AS (SELECT p_partkey, " + SCRIPTS.replace("\\n", "' || chr(10) || '") + " AS code FROM part)"


@query("scan_placeholders", f"""
WITH {SQL_SCRIPTS}
SELECT p_partkey, 'PLACEHOLDER_VALUE' AS code, CASE p_partkey % 3 WHEN 0 THEN 'GCS bucket' WHEN 1 THEN 'TODO placeholder' ELSE 'REPLACE_ME placeholder' END AS what FROM s
UNION ALL
SELECT p_partkey, 'MISSING_REQUIRED_VAR', 'batch_size' FROM s WHERE NOT regexp_matches(code, 'batch_size|BATCH_SIZE')
UNION ALL
SELECT p_partkey, 'MISSING_REQUIRED_VAR', 'output path' FROM s WHERE NOT regexp_matches(code, 'OUTPUT_PATH|output_path|output_dir')
""")
def scan_placeholders(spark, folder):
    found = rules.rule_scan(scripts(spark, folder), ["p_partkey"], "code", rulepacks.CONFIG + rulepacks.PLACEHOLDERS)
    return found.select("p_partkey", "code", F.regexp_extract("message", "(?:for|variable:) (.*)$", 1).alias("what"))


@query("missing_installs", r"""
SELECT p_partkey, 'import ' || CASE p_partkey % 5 WHEN 0 THEN 'torch' WHEN 2 THEN 'optuna' ELSE 'peft' END || ' without pip install' AS message FROM part WHERE p_partkey % 5 IN (0, 2, 3)
""")
def missing_installs(spark, folder):
    found = scripts(spark, folder).select("p_partkey", rulepacks.missing_installs("code").alias("f"))
    return rules.explode_findings(found, ["p_partkey"], F.col("f")).select("p_partkey", "message")


@query("extract_refs", r"""
SELECT DISTINCT page_id, ref FROM (
  SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), regexp_extract_all(html, 'src="([^"]*)"', 1))) AS ref FROM pages)
""")
def extract_refs(spark, folder):
    return rules.extract_refs(table(spark, folder, "pages"), ["page_id"], "html", ['href="([^"]*)"', 'src="([^"]*)"'])


@query("dataset_refs", r"""
SELECT page_id, 'set-' || CAST(page_id % 7 AS VARCHAR) AS ref FROM pages
UNION SELECT page_id, 'base-corpus' FROM pages WHERE page_id % 2 = 0
""")
def dataset_refs(spark, folder):
    number = (F.col("page_id") % 7).cast("string")
    extra = F.when(F.col("page_id") % 2 == 0, F.lit('\nPath("/kaggle/input/base-corpus/x.csv")\nKAGGLE_INPUT / "base-corpus"')).otherwise("")
    code = F.concat(F.lit('d = "/kaggle/input/set-'), number, F.lit('/train.csv"'), extra)
    return rules.extract_refs(table(spark, folder, "pages").withColumn("code", code), ["page_id"], "code", rulepacks.DATASET_PATHS)


@query("used_columns", r"""
SELECT p_partkey, c AS column_name FROM part, unnest(['source', 'target', replace(p_name, ' ', '_')]) t(c)
UNION SELECT p_partkey, 'note' FROM part WHERE p_partkey % 2 = 0
""")
def used_columns(spark, folder):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    note = F.when(F.col("p_partkey") % 2 == 0, F.lit("train_df.note.str.len()\ndf['iloc']\n")).otherwise("")
    code = F.concat(F.lit("df = df.dropna(subset=['source', 'target'])\n"), note, F.lit('x = df["'), name, F.lit('"]\n'))
    return table(spark, folder, "part").select("p_partkey", F.explode(rulepacks.used_columns(code)).alias("column_name"))


def notebooks(spark, folder):
    """Scripts wrapped as notebooks: one text cell and the script, split over two code cells."""
    def cell(kind, source):
        return F.struct(F.lit(kind).alias("cell_type"), F.array(source).alias("source"), F.array().cast("array<string>").alias("outputs"))

    document = F.struct(
        F.when(F.col("p_partkey") % 10 == 0, 3).otherwise(4).alias("nbformat"),
        F.array(cell("markdown", F.lit("# Title")), cell("code", F.col("code")), cell("code", F.lit("print(1)"))).alias("cells"),
        F.struct(F.struct(F.lit("python3").alias("name")).alias("kernelspec")).alias("metadata"),
    )
    return scripts(spark, folder).select("p_partkey", F.to_json(document).alias("notebook"))


@query("notebook_readiness", """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 = 0 THEN 5 ELSE 6 END AS BIGINT) AS passed, CAST(CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS errors,
  CASE WHEN p_partkey % 10 = 0 THEN 83 ELSE 100 END AS score, p_partkey % 10 <> 0 AS ready FROM part
""")
def notebook_readiness(spark, folder):
    return rulepacks.notebook_readiness(notebooks(spark, folder), "p_partkey", "notebook").drop("warnings")


@query("internet_rules", """
WITH c AS (SELECT p_partkey, p_partkey % 3 AS setting, p_partkey % 2 = 0 AS installs FROM part)
SELECT p_partkey, 'SUBMISSION_INTERNET' AS code, CASE setting WHEN 0 THEN 'warning' WHEN 1 THEN 'error' ELSE 'pass' END AS severity FROM c
UNION ALL SELECT p_partkey, CASE setting WHEN 0 THEN 'PIP_INSTALL' ELSE 'PIP_INSTALL_BLOCKED' END, CASE setting WHEN 0 THEN 'warning' ELSE 'error' END
  FROM c WHERE installs AND setting <> 1
""")
def internet_rules(spark, folder):
    setting = F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("p_partkey") % 3 == 1)
    code = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, F.lit("!pip install -q sacrebleu\n")).otherwise(""), F.lit("submission.to_csv('submission.csv')")
    )
    checked = table(spark, folder, "part").select("p_partkey", rulepacks.internet_findings(code, setting).alias("f"))
    return rules.explode_findings(checked, ["p_partkey"], F.col("f")).select("p_partkey", "code", "severity")


@query("dataset_sources", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'pass' ELSE 'error' END AS severity,
  CASE WHEN p_partkey % 2 = 0 THEN 'all data sets are attached' ELSE 'not attached: set-' || CAST(p_partkey % 7 AS VARCHAR) END AS message
FROM part
""")
def dataset_sources(spark, folder):
    name = F.concat(F.lit("set-"), (F.col("p_partkey") % 7).cast("string"))
    code = F.concat(F.lit('df = read("/kaggle/input/'), name, F.lit('/train.csv")\nx = read("/kaggle/input/base/x.csv")'))
    attached = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("me/"), name), F.lit("base"))).otherwise(F.array(F.lit("me/base")))
    checked = table(spark, folder, "part").select("p_partkey", rulepacks.dataset_findings(code, attached).alias("f"))
    return rules.explode_findings(checked, ["p_partkey"], F.col("f")).select("p_partkey", "severity", "message")


@query("preflight_status", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'fail' ELSE 'warn' END AS status FROM part
""")
def preflight_status(spark, folder):
    base = F.lit("df['id'] = 1; df['translation'] = 2; df.to_csv('submission.csv', index=False)\ntrainer.save_model(d)\n")
    code = F.concat(base, F.when(F.col("p_partkey") % 3 == 0, F.lit("evaluation_strategy='no'")).otherwise(""))
    parts = table(spark, folder, "part")
    scripts = parts.select("p_partkey", code.alias("code"))
    metadata = parts.where("p_partkey % 2 = 0").select("p_partkey", F.lit(False).alias("enable_internet"), F.array(F.lit("a/b")).alias("attached"))
    return rules.worst_status(rulepacks.preflight(scripts, metadata, "p_partkey", "code"), ["p_partkey"])
