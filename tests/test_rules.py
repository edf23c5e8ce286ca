import json

import pytest
from pyspark.sql import functions as F

from glossmill.operators import rulepacks, rules


def notebook(*cells, **changes):
    body = {
        "nbformat": 4,
        "cells": [{"cell_type": kind, "source": [source], **({"outputs": []} if kind == "code" else {})} for kind, source in cells],
        "metadata": {"kernelspec": {"name": "python3"}},
    }
    body.update(changes)
    return json.dumps({key: value for key, value in body.items() if value is not None})


@pytest.fixture
def codes(spark):
    """Codes of the findings that an array expression gives for one text."""

    def run(build, text):
        df = spark.createDataFrame([(text,)], "t string")
        return [r.code for r in df.select(F.inline(build("t"))).collect()]

    return run


@pytest.fixture
def notebook_codes(spark):
    def run(text, platform=None, tools=None):
        df = spark.createDataFrame([(1, text)], "id int, t string")
        return [r.code for r in rulepacks.validate_notebooks(df, "id", "t", platform, tools).collect()]

    return run


def test_structure(notebook_codes):
    assert "INVALID_NBFORMAT" not in notebook_codes(notebook(("markdown", "# T"), ("code", "print('x')")))
    assert "INVALID_NBFORMAT" in notebook_codes(notebook(("code", "x = 1"), nbformat=3))
    assert "EMPTY_NOTEBOOK" in notebook_codes(notebook())
    assert "EMPTY_CODE_CELL" in notebook_codes(notebook(("code", ""), ("code", "x = 1")))
    assert "MISSING_KERNELSPEC" in notebook_codes(notebook(("code", "x"), metadata={}))
    assert "MISSING_CELLS" in notebook_codes(notebook(cells=None))
    odd = {"cells": [{"cell_type": "odd", "source": "x"}, {"cell_type": "code", "source": 5}]}
    assert {"INVALID_CELL_TYPE", "INVALID_CELL_SOURCE", "MISSING_OUTPUTS"} <= set(notebook_codes(notebook(**odd)))
    text_source = {"cells": [{"cell_type": "code", "source": 'print "x"', "outputs": []}]}
    assert "PYTHON2_PRINT" in notebook_codes(notebook(**text_source))
    assert notebook_codes("no json")[:2] == ["INVALID_NBFORMAT", "MISSING_CELLS"]


def test_syntax(notebook_codes):
    found = notebook_codes(notebook(("code", 'def hello():\n    print("world")')))
    assert not {"UNDEFINED_TEMPLATE_VAR", "PYTHON2_PRINT", "RESERVED_KEYWORD"} & set(found)
    assert "UNDEFINED_TEMPLATE_VAR" in notebook_codes(notebook(("code", 'model = "{{model_name}}"')))
    assert "PYTHON2_PRINT" in notebook_codes(notebook(("code", 'print "hello"')))
    assert "MIXED_INDENTATION" in notebook_codes(notebook(("code", "\t  x = 1")))
    assert "RESERVED_KEYWORD" in notebook_codes(notebook(("code", "def class(x): pass")))
    assert "PYTHON2_PRINT" not in notebook_codes(notebook(("markdown", 'print "hello"')))


def test_config(notebook_codes):
    good = 'CONFIG = {\n "model_name": "m",\n "batch_size": 4,\n}\nOUTPUT_PATH = "/output"\n'
    assert not {"MISSING_CONFIG", "MISSING_REQUIRED_VAR"} & set(notebook_codes(notebook(("code", good))))
    assert "PLACEHOLDER_VALUE" in notebook_codes(notebook(("code", 'BUCKET = "your-bucket"')))
    assert "PLACEHOLDER_VALUE" in notebook_codes(notebook(("code", "MODEL = 'todo'")))


def test_dependencies(notebook_codes, codes):
    installed = notebook(("code", '!pip install "transformers>=4.0.0"'), ("code", "from transformers import AutoModel"))
    assert "MISSING_INSTALL" not in notebook_codes(installed)
    assert "MISSING_INSTALL" in notebook_codes(notebook(("code", "from peft import LoraConfig")))
    late = notebook(*[("code", "x = 1")] * 5, ("code", '!pip install "peft"'))
    assert "LATE_INSTALL" in notebook_codes(late) and "LATE_INSTALL" not in notebook_codes(installed)
    assert codes(rulepacks.no_deps_findings, "!pip install --no-deps x") == ["PIP_NO_DEPS"]
    assert codes(rulepacks.no_deps_findings, 'subprocess.run(["pip", "install", "x"])') == []


@pytest.mark.parametrize(
    "platform, code, expected",
    [
        ("kaggle-p100", 'P = "/kaggle/input/c"', []),
        ("kaggle-p100", 'P = "/data"', ["MISSING_KAGGLE_PATHS"]),
        ("kaggle-p100", '"/kaggle/" requests.get(u)', ["KAGGLE_NETWORK_ACCESS"]),
        ("kaggle-p100", '"/kaggle/" requests.get(u) # kaggle needs internet', []),
        ("colab-pro", 'P = "/content/data"', []),
        ("colab-pro", 'D = "/content/drive/MyDrive"', ["MISSING_DRIVE_MOUNT"]),
        ("vertex-a100", "x", ["MISSING_GCS_PATHS"]),
        ("runpod", "# --- INJECTION POINT: X ---", ["EMPTY_INJECTION_POINT"]),
        ("runpod", "# --- INJECTION POINT: X ---\nx\n# --- END INJECTION POINT ---", []),
    ],
)
def test_platform(codes, platform, code, expected):
    assert codes(lambda c: rules.findings(c, rulepacks.platform_rules(platform)), code) == expected


def test_tools(codes, notebook_codes):
    assert codes(lambda c: rulepacks.expected_tools(c, ["sacrebleu", "hpo"]), "from sacrebleu.metrics import BLEU") == ["MISSING_TOOL"]
    assert "MISSING_TOOL" in notebook_codes(notebook(("code", "print(1)")), tools=["qlora"])
    assert codes(lambda c: rules.findings(c, rulepacks.TOOL_DEPENDENCIES), "import optuna") == ["MISSING_TOOL_DEPENDENCY"]
    assert codes(lambda c: rules.findings(c, rulepacks.TOOL_DEPENDENCIES), "pip install optuna\nimport optuna") == []


def test_security(codes):
    secret = 'API_KEY = "sk-1234567890123456789012345678901234567890123456789"'
    scan = lambda c: rules.findings(c, rulepacks.SECURITY)
    assert "HARDCODED_SECRET" in codes(scan, secret)
    assert codes(scan, "subprocess.call(cmd, shell=True)") == ["SECURITY_RISK"]
    assert codes(scan, 'import os\npath = os.getenv("PATH")') == []


def test_deprecations(codes):
    scan = lambda c: rules.findings(c, rulepacks.DEPRECATIONS)
    old = "t = Seq2SeqTrainer(\n model=m,\n tokenizer=tokenizer,\n evaluation_strategy='no')"
    assert codes(scan, old) == ["TRAINER_TOKENIZER", "EVALUATION_STRATEGY"]
    assert codes(scan, "t = Seq2SeqTrainer(processing_class=tokenizer, tokenizer=tokenizer)") == []


def test_submission(codes):
    good = "df = pd.DataFrame({'id': a, 'translation': b})\ndf.to_csv('submission.csv', index=False)"
    assert codes(rulepacks.submission_findings, good) == ["SUBMISSION_OUTPUT"]
    assert codes(rulepacks.submission_findings, "df.to_csv('submission.csv')") == ["SUBMISSION_FORMAT", "CSV_INDEX"]
    assert codes(rulepacks.submission_findings, "x = 1") == ["SUBMISSION_OUTPUT"]


def test_internet(spark):
    submit, download = "df.to_csv('submission.csv')", "AutoModel.from_pretrained('org/model')"
    data = [(1, submit, None), (2, submit, True), (3, submit, False), (4, "!pip install x", False), (5, "!pip install x", True), (6, download, False),
            (7, 'CONFIG = {"model_name": "org/m"}\nfrom_pretrained(CONFIG["model_name"])', False), (8, 'evaluate.load("chrf")', None),
            (9, "AutoModel.from_pretrained('./local/x')", False)]
    df = spark.createDataFrame(data, "id int, t string, internet boolean")
    found = df.select("id", F.inline(rulepacks.internet_findings("t", "internet"))).collect()
    assert sorted((r.id, r.code, r.severity) for r in found) == [
        (1, "SUBMISSION_INTERNET", "warning"), (2, "SUBMISSION_INTERNET", "error"), (3, "SUBMISSION_INTERNET", "pass"), (4, "PIP_INSTALL_BLOCKED", "error"),
        (6, "MODEL_DOWNLOAD", "error"), (7, "MODEL_DOWNLOAD", "error"), (8, "METRIC_DOWNLOAD", "warning"),
    ]


def test_models_and_metrics(codes):
    assert codes(rulepacks.model_findings, "x") == ["MODEL_SAVE"]
    assert codes(rulepacks.model_findings, "trainer.save_model(d)\nkagglehub.model_upload(h)") == ["MODEL_REGISTRY"]
    assert codes(rulepacks.model_findings, "torch.save(m)\nkagglehub.model_download('a/b')") == ["MODEL_REGISTRY", "MODEL_SOURCE", "MODEL_HANDLE"]
    custom = 'metric_for_best_model="chrf"'
    assert codes(rulepacks.compute_metrics_findings, custom) == ["COMPUTE_METRICS"]
    assert codes(rulepacks.compute_metrics_findings, 'metric_for_best_model="eval_loss"') == []
    passed = custom + "\ndef compute_metrics(p): pass\nt = Trainer(\n compute_metrics=compute_metrics)"
    assert codes(lambda c: F.filter(rulepacks.compute_metrics_findings(c), lambda f: f["severity"] == "pass"), passed) == ["COMPUTE_METRICS"]


def test_progress_bars(spark):
    off = 'os.environ["TQDM_DISABLE"] = "1"\nos.environ["HF_HUB_DISABLE_PROGRESS_BARS"] = "1"\n'
    texts = [off, off + "TrainingArguments(x)", off + 'TrainingArguments(report_to="none")', "for i in tqdm(x):"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    found = df.select("id", F.inline(rulepacks.progress_bar_findings("t"))).collect()
    assert [r.severity for r in sorted(found, key=lambda r: r.id)] == ["pass", "warning", "pass", "warning"]


def test_columns(codes, spark):
    code = "df['a']; train_df.b.str.len(); df.dropna(subset=['c', \"d\"]); df[['e','f']]; df['iloc']"
    df = spark.createDataFrame([(code,)], "t string")
    assert sorted(df.select(F.explode(rulepacks.used_columns("t"))).toPandas()["col"]) == ["a", "b", "c", "d", "e", "f"]
    check = lambda c: rulepacks.pair_column_findings(c, "my-corpus", "old", "new", "/in/x/*.csv")
    assert codes(check, "my-corpus df['source']") == ["PAIR_COLUMNS"]
    assert codes(check, "my-corpus df['source'] df.rename(columns=m)") == ["PAIR_COLUMNS"]
    assert codes(check, "/in/x/*.csv df['target']") == ["WILDCARD_SOURCE"]
    assert codes(check, "df['source']") == []


def test_rollups(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    data = [(1, "config", "A", "warning", ""), (2, "security", "B", "error", ""), (2, "security", "B", "error", ""), (2, "config", "C", "pass", "")]
    found = spark.createDataFrame(data, "id int, category string, code string, severity string, message string")
    ready = {r.id: tuple(r)[1:] for r in rules.readiness(docs, found, "id", ["config", "security", "syntax"]).collect()}
    assert ready == {1: (3, 0, 1, 100, True), 2: (2, 2, 0, 50, False), 3: (3, 0, 0, 100, True)}
    strict = {r.id: r.ready for r in rules.readiness(docs, found, "id", ["config", "security", "syntax"], strict=True).collect()}
    assert strict == {1: False, 2: False, 3: True}
    assert {r.id: r.status for r in rules.worst_status(found, ["id"]).collect()} == {1: "warn", 2: "fail"}


def test_whole_notebooks(spark):
    complete = notebook(
        ("markdown", "# Training"),
        ("code", '!pip install "transformers>=4.35.0" "datasets>=2.14.0"\nCONFIG = {"model_name": "m", "batch_size": 4}\nOUTPUT_PATH = "/kaggle/working"\n'),
        ("code", "from transformers import AutoModel\nimport torch\n"),
    )
    broken = notebook(("code", 'model = "{{undefined}}"'))
    df = spark.createDataFrame([(1, complete), (2, broken)], "id int, t string")
    found = {r.id: (r.score, r.ready) for r in rulepacks.notebook_readiness(df, "id", "t", "kaggle-p100").collect()}
    assert found[1] == (100, True) and found[2][1] is False


def test_preflight(spark):
    scripts = spark.createDataFrame([(1, 'x = "/kaggle/input/my-set/a.csv"'), (2, "df.to_csv('submission.csv')")], "id int, t string")
    metadata = spark.createDataFrame([(1, True, ["me/other"])], "id int, enable_internet boolean, attached array<string>")
    found = {(r.id, r.code, r.severity) for r in rulepacks.preflight(scripts, metadata, "id", "t", submission=True, training=True).collect()}
    assert {(1, "DATASET_SOURCES", "error"), (1, "MODEL_SAVE", "error"), (2, "SUBMISSION_INTERNET", "warning"), (2, "CSV_INDEX", "warning")} <= found
    assert (2, "DATASET_SOURCES", "error") not in found
