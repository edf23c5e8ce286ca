"""Ready-made rules for notebooks and training scripts.

The patterns, codes, names and word lists below are fixed values: they decide what counts as a finding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column
from glossmill.functions.text import SETTING_PATTERNS, extract_first
from glossmill.operators.rules import (
    FINDING, Rule, capture_findings, explode_findings, finding, findings, matches, readiness,
)

CATEGORIES = ["structure", "syntax", "config", "dependencies", "platform", "tools", "security"]

SECRETS = [
    Rule("security", "HARDCODED_SECRET", "error", f"possible {name} in the text", any_of=[pattern])
    for name, pattern in [
        ("API key or secret", r"""(?i)["'][A-Za-z0-9_-]{20,}["'].*(?:key|token|secret|password|api)"""),
        ("Google API key", r"AIza[A-Za-z0-9_-]{35}"),
        ("GitHub personal access token", r"ghp_[A-Za-z0-9]{36}"),
        ("OpenAI API key", r"sk-[A-Za-z0-9]{48}"),
        ("AWS access key", r"AKIA[A-Z0-9]{16}"),
    ]
]
DANGEROUS_CALLS = [
    Rule("security", "SECURITY_RISK", "warning", f"security risk: {name}", any_of=[pattern])
    for name, pattern in [
        ("shell injection", r"subprocess\.call.*shell\s*=\s*True"),
        ("eval with user input", r"eval\s*\([^)]*input"),
        ("exec with user input", r"exec\s*\([^)]*input"),
        ("command injection", r"os\.system\s*\([^)]*\+"),
    ]
]
SECURITY = SECRETS + DANGEROUS_CALLS

SYNTAX = [
    Rule("syntax", "UNCLOSED_STRING", "warning", "possible unclosed string", any_of=[r"""(?m)['"][^'"]*$(?!.*['"])"""]),
    Rule("syntax", "UNBALANCED_PARENS", "warning", "possible unbalanced parentheses", any_of=[r"(?m)\([^)]*$(?!.*\))"]),
    Rule("syntax", "UNCLOSED_DOCSTRING", "warning", "possible unclosed docstring", any_of=[r'(?m)"""[^"]*$']),
    Rule("syntax", "RESERVED_KEYWORD", "error", "reserved word as a function name",
         any_of=[r"\bdef\s+(?:class|def|import|from|return|yield|lambda)\s*\("]),
    Rule("syntax", "PYTHON2_PRINT", "error", "print statement of Python 2", any_of=[r"(?m)^\s*print\s+[^(].*$"]),
    Rule("syntax", "MIXED_INDENTATION", "warning", "tabs and blanks mixed in indentation", any_of=[r"(?m)^\t+ +"]),
]
TEMPLATE_VARIABLE = r"\{\{(\w+)\}\}"

CONFIG = [
    Rule("config", "MISSING_CONFIG", "warning", "no CONFIG dictionary", none_of=[r"CONFIG\s*=\s*\{"]),
    *[
        Rule("config", "MISSING_REQUIRED_VAR", "warning", f"missing variable: {name}", none_of=[pattern])
        for name, pattern in [
            ("model_name", "model_name|MODEL_NAME"),
            ("batch_size", "batch_size|BATCH_SIZE"),
            ("output path", "OUTPUT_PATH|output_path|output_dir"),
        ]
    ],
]
PLACEHOLDERS = [
    Rule("config", "PLACEHOLDER_VALUE", "warning", f"placeholder for {name}", any_of=[pattern])
    for name, pattern in [
        ("GCS bucket", """["']your-bucket["']"""),
        ("GCS project", """["']your-project["']"""),
        ("competition name", """["']competition-name["']"""),
        ("TODO placeholder", """(?i)["']TODO["']"""),
        ("REPLACE_ME placeholder", """(?i)["']REPLACE_ME["']"""),
    ]
]

IMPORTS = [r"(?m)^from\s+(\w+)", r"(?m)^import\s+(\w+)"]
INSTALLS = r"""pip\s+install[^"'\n]*["']([^"']+)["']"""
INSTALL_NAMES = {
    "transformers": ["transformers"],
    "datasets": ["datasets"],
    "accelerate": ["accelerate"],
    "peft": ["peft"],
    "bitsandbytes": ["bitsandbytes"],
    "sacrebleu": ["sacrebleu"],
    "optuna": ["optuna"],
    "mlflow": ["mlflow"],
    "torch": ["torch", "pytorch"],
}

PLATFORM = {
    "kaggle": [
        Rule("platform", "MISSING_KAGGLE_PATHS", "warning", "no /kaggle/ path", none_of=["/kaggle/"]),
        Rule("platform", "KAGGLE_NETWORK_ACCESS", "warning", "network access needs internet",
             any_of=[r"requests\.get|urllib|httpx"], none_of=["(?i)kaggle.*internet"]),
    ],
    "colab": [
        Rule("platform", "MISSING_COLAB_PATHS", "warning", "no /content/ path", none_of=[r"google\.colab|/content/"]),
        Rule("platform", "MISSING_DRIVE_MOUNT", "error", "drive path without drive.mount()",
             any_of=["/content/drive"], none_of=[r"drive\.mount"]),
    ],
    "vertex": [Rule("platform", "MISSING_GCS_PATHS", "warning", "no gs:// path", none_of=["gs://"])],
}
INJECTION_POINTS = [
    Rule("platform", "EMPTY_INJECTION_POINT", "warning", "empty injection point",
         any_of=[r"---\s*INJECTION POINT:"], none_of=[r"INJECTION POINT.*\n.*\n.*---\s*END INJECTION POINT"]),
]

TOOLS = {
    "sacrebleu": "from sacrebleu|import sacrebleu|BLEU.*CHRF|evaluate_translations",
    "qlora": "BitsAndBytesConfig|load_in_4bit|LoraConfig|get_peft_model",
    "accelerate": r"from accelerate|Accelerator|accelerator\.prepare",
    "onnx": r"optimum\.onnxruntime|ORTModel|export_to_onnx",
    "streaming": r"streaming\s*=\s*True|IterableDataset|create_streaming_dataloader",
    "hpo": "optuna|create_study|hyperparameter_search|MLflowCallback",
}
TOOL_INSTALLS = {
    "sacrebleu": r"pip.*install.*sacrebleu",
    "qlora": r"pip.*install.*(?:bitsandbytes|peft)",
    "accelerate": r"pip.*install.*accelerate",
    "onnx": r"pip.*install.*optimum",
    "hpo": r"pip.*install.*optuna",
}
TOOL_DEPENDENCIES = [
    Rule("tools", "MISSING_TOOL_DEPENDENCY", "warning", f"{tool} may not be installed",
         any_of=[TOOLS[tool]], none_of=[install])
    for tool, install in TOOL_INSTALLS.items()
]

DEPRECATIONS = [
    Rule("deprecation", "TRAINER_TOKENIZER", "warning", "tokenizer= of the trainer is deprecated",
         all_of=[r"=\s*Seq2SeqTrainer\s*\(", r"Seq2SeqTrainer\s*\([\s\S]*?\btokenizer\s*=\s*tokenizer"],
         none_of=[r"Seq2SeqTrainer\s*\([\s\S]*?processing_class\s*="]),
    Rule("deprecation", "EVALUATION_STRATEGY", "error", "evaluation_strategy is deprecated", any_of=[r"evaluation_strategy\s*="]),
    Rule("deprecation", "AS_TARGET_TOKENIZER", "warning", "as_target_tokenizer() is deprecated", any_of=[r"\.as_target_tokenizer\s*\("]),
    Rule("deprecation", "USE_AUTH_TOKEN", "warning", "use_auth_token is deprecated", any_of=[r"from_pretrained\([^)]*use_auth_token\s*="]),
]

SUBMISSION_WRITES = [
    r"""(?i)\.to_csv\s*\(\s*["'].*submission\.csv["']""",
    r"""(?i)open\s*\(\s*["'].*submission\.csv["']""",
    r"(?i)submission.*\.to_csv",
    r"(?i)pd\.DataFrame.*\.to_csv.*submission",
]
SUBMISSION_OUTPUTS = [SUBMISSION_WRITES[0], SUBMISSION_WRITES[2]]
ID_COLUMN = r"""["']id["']|\bid\b\s*[=:]"""
TRANSLATION_COLUMN = r"""["']translation["']|translation\s*[=:]"""
WITHOUT_INDEX = r"(?i)index\s*=\s*False"

MODEL_SAVES = [r"(?i)trainer\.save_model\s*\(", r"(?i)model\.save_pretrained\s*\(", r"(?i)\.save_model\s*\(", r"(?i)torch\.save\s*\("]
MODEL_UPLOADS = [r"(?i)kagglehub\.model_upload\s*\(", r"(?i)model_upload\s*\(\s*handle\s*="]
MODEL_DOWNLOADS = [r"(?i)kagglehub\.model_download\s*\(", r"""(?i)model_download\s*\(\s*["']"""]
MODEL_HANDLE = r"""(?i)model_download\s*\(\s*["']([^"']+)["']"""
PIP_COMMANDS = [r"!pip\s+install\s+[^\n]+", r"subprocess\.run\s*\([^)]*pip[^)]*install[^)]*\)"]
METRIC_DOWNLOAD = r"""evaluate\.load\s*\(\s*["']([^"']+)["']"""
PRETRAINED = r"""from_pretrained\s*\(\s*["']([^"']+)["']"""
NO_DEPS = [
    r"!pip\s+install[^\n]*--no-deps[^\n]*",
    r"""pip[",\s]+install[^)\]]*--no-deps[^)\]]*""",
    r"""["']--no-deps["'][,\s]*\][^\n]*pip""",
    r"""subprocess\.run\s*\([^)]*["']--no-deps["']""",
    r"pip.*install.*--no-deps|--no-deps.*pip.*install",
]
TQDM_OFF = [
    r"""os\.environ\s*\[\s*["']TQDM_DISABLE["']\s*\]\s*=\s*["']1["']""",
    r"partialmethod\s*\(\s*tqdm.*__init__.*disable\s*=\s*True\s*\)",
]
HUB_BARS_OFF = r"""os\.environ\s*\[\s*["']HF_HUB_DISABLE_PROGRESS_BARS["']\s*\]\s*=\s*["']1["']"""
TRAINER_BARS_OFF = [r"""report_to\s*=\s*["']none["']""", r"disable_tqdm\s*=\s*True"]
TRAINING_SCRIPT = r"Seq2SeqTrainer|Trainer\s*\(|TrainingArguments"
TQDM_LOOP = r"(for\s+\w+\s+in\s+tqdm\s*\([^)]+\))"

BEST_METRIC = r"""["']?metric_for_best_model["']?\s*[=:]\s*["']([^"']+)["']"""
BUILT_IN_METRICS = ["loss", "eval_loss"]
CUSTOM_METRICS = ["chrf", "bleu", "sacrebleu", "rouge", "meteor", "accuracy", "f1"]
METRICS_FUNCTION = r"def\s+compute_metrics\s*\("
METRICS_PASSED = r"Trainer\s*\([\s\S]*?compute_metrics\s*="

COLUMN_RENAME = r"\.rename\s*\(\s*columns\s*=|column_mapping\s*="
FRAME_NAMES = r"(?:df|train_df|val_df|test_df|data|dataset|examples|sample|batch)\b"
COLUMN_USES = [rf"""{FRAME_NAMES}\s*\[\s*["'](\w+)["']\s*\]""", rf"{FRAME_NAMES}\.(\w+)\.(?:str|isna|fillna)"]
COLUMN_LISTS = [
    r"\.(?:dropna|fillna)\s*\(\s*subset\s*=\s*\[([^\]]+)\]",
    rf"{FRAME_NAMES}\s*\[\s*\[([^\]]+)\]\s*\]",
    r"Dataset\.from_pandas\s*\([^)]*\[\s*\[([^\]]+)\]",
]
FRAME_ATTRIBUTES = ["iloc", "loc", "values", "index", "columns", "head", "tail", "shape"]

DATASET_PATHS = [
    r"""(?i)["']/kaggle/input/([a-z0-9-]+)(?:/[^"']*)?["']""",
    r"""(?i)KAGGLE_INPUT\s*/\s*["']([a-z0-9-]+)(?:/[^"']*)?["']""",
    r"""(?i)Path\s*\(\s*["']/kaggle/input/([a-z0-9-]+)""",
]


def template_variables(c: Column | str) -> Column:
    """A finding for each ``{{name}}`` that was not filled in."""
    return capture_findings(c, TEMPLATE_VARIABLE, "syntax", "UNDEFINED_TEMPLATE_VAR", "error", "undefined variable {}")


def missing_installs(c: Column | str) -> Column:
    """A finding for each known package that is imported but not installed."""
    text = as_column(c)
    imports = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IMPORTS]))
    requirements = F.regexp_extract_all(text, F.lit(INSTALLS), F.lit(1))
    installed = F.transform(requirements, lambda r: F.lower(F.regexp_extract(r, r"^([^<>=\[\]]*)", 1)))
    found = []
    for name, packages in INSTALL_NAMES.items():
        lacks = F.array_contains(imports, name) & ~F.arrays_overlap(installed, F.array(*[F.lit(p) for p in packages]))
        found.append(F.when(lacks, finding("dependencies", "MISSING_INSTALL", "warning", f"import {name} without pip install")))
    return F.array_compact(F.array(*found))


def expected_tools(c: Column | str, tools: list[str]) -> Column:
    """A finding for each expected tool that the text does not use."""
    rules = [
        Rule("tools", "MISSING_TOOL", "error", f"expected tool {tool} not found", none_of=[TOOLS[tool]])
        for tool in tools if tool in TOOLS
    ]
    return findings(c, rules)


def platform_rules(platform: str) -> list[Rule]:
    """Rules of a platform; profiles such as ``kaggle-p100`` share those of their family."""
    family = next((rules for name, rules in PLATFORM.items() if platform.startswith(name)), [])
    return family + INJECTION_POINTS


def submission_findings(c: Column | str) -> Column:
    """Whether a script writes a submission, with the right columns and without an index."""
    text = as_column(c)
    writes = matches(text, SUBMISSION_WRITES)
    columns = text.rlike(ID_COLUMN) & text.rlike(TRANSLATION_COLUMN)
    found = [
        F.when(~writes, finding("submission", "SUBMISSION_OUTPUT", "error", "no submission.csv is written")),
        F.when(writes & ~columns, finding("submission", "SUBMISSION_FORMAT", "warning", "columns id and translation not seen")),
        F.when(writes & columns, finding("submission", "SUBMISSION_OUTPUT", "pass", "submission.csv with its columns")),
        F.when(writes & ~text.rlike(WITHOUT_INDEX), finding("submission", "CSV_INDEX", "warning", "to_csv() may add an index column")),
    ]
    return F.array_compact(F.array(*found))


def compute_metrics_findings(c: Column | str) -> Column:
    """Whether a custom best-model metric comes with a ``compute_metrics`` that is passed on."""
    text = as_column(c)
    metric = F.lower(F.regexp_extract(text, BEST_METRIC, 1))
    custom = F.lit(False)
    for name in CUSTOM_METRICS:
        custom = custom | metric.contains(name)
    asked = (metric != "") & ~metric.isin(BUILT_IN_METRICS) & custom
    defined, passed = text.rlike(METRICS_FUNCTION), text.rlike(METRICS_PASSED)
    found = [
        F.when(asked & ~defined, finding("metrics", "COMPUTE_METRICS", "error", F.concat(metric, F.lit(" needs compute_metrics")))),
        F.when(asked & defined & ~passed, finding("metrics", "COMPUTE_METRICS", "error", "compute_metrics is not passed to the trainer")),
        F.when(asked & defined & passed, finding("metrics", "COMPUTE_METRICS", "pass", F.concat(F.lit("compute_metrics serves "), metric))),
    ]
    return F.array_compact(F.array(*found))


def model_findings(c: Column | str) -> Column:
    """Whether a trained model is saved and uploaded, and where a model is taken from."""
    text = as_column(c)
    saves, uploads, downloads = (matches(text, forms) for forms in (MODEL_SAVES, MODEL_UPLOADS, MODEL_DOWNLOADS))
    handle = extract_first(text, [MODEL_HANDLE])
    found = [
        F.when(~saves, finding("model", "MODEL_SAVE", "error", "no model is saved")),
        F.when(saves & ~uploads, finding("model", "MODEL_REGISTRY", "warning", "the model is saved but not uploaded")),
        F.when(saves & uploads, finding("model", "MODEL_REGISTRY", "pass", "the model is uploaded")),
        F.when(downloads, finding("model", "MODEL_SOURCE", "pass", "the model comes from the registry")),
        F.when(downloads & (F.size(F.split(handle, "/")) < 4), finding("model", "MODEL_HANDLE", "warning", F.concat(F.lit("short handle "), handle))),
    ]
    return F.array_compact(F.array(*found))


def progress_bar_findings(c: Column | str) -> Column:
    """Whether progress bars are switched off everywhere."""
    text = as_column(c)
    tqdm_off, hub_off = matches(text, TQDM_OFF), text.rlike(HUB_BARS_OFF)
    trainer_bars = text.rlike(TRAINING_SCRIPT) & ~matches(text, TRAINER_BARS_OFF)
    loops = F.filter(F.regexp_extract_all(text, F.lit(TQDM_LOOP), F.lit(1)), lambda loop: ~loop.rlike("disable ?="))
    open_loops = (F.size(loops) > 0) & ~tqdm_off
    missing = ~tqdm_off | ~hub_off
    clean = ~missing & ~trainer_bars & ~open_loops
    state = F.when(clean, finding("progress", "PROGRESS_BARS", "pass", "progress bars are off"))
    state = state.when(missing, finding("progress", "PROGRESS_BARS", "warning", "progress bars are not fully off"))
    return F.array(state.otherwise(finding("progress", "PROGRESS_BARS", "warning", "some progress bars remain")))


def no_deps_findings(c: Column | str) -> Column:
    return findings(c, [Rule("dependencies", "PIP_NO_DEPS", "error", "--no-deps skips needed packages", any_of=NO_DEPS)])


def internet_findings(c: Column | str, internet: Column | str) -> Column:
    """Text against the ``enable_internet`` setting (NULL: no metadata): submissions and downloads."""
    text, setting = as_column(c), as_column(internet)
    submits = matches(text, SUBMISSION_OUTPUTS)
    offline, unknown = F.coalesce(~setting, F.lit(False)), setting.isNull()
    installs, loads = matches(text, PIP_COMMANDS), text.rlike(METRIC_DOWNLOAD)
    models = F.regexp_extract_all(text, F.lit(PRETRAINED), F.lit(1))
    hub = F.filter(
        models,
        lambda m: m.contains("/") & ~m.rlike(r"^(\./|/|~)") & ~m.contains("/kaggle/") & ~m.rlike("model_path|MODEL_PATH"),
    )
    named = extract_first(text, SETTING_PATTERNS["model_name"][:1])
    from_config = matches(
        text,
        all_of=[r"from_pretrained\s*\(\s*CONFIG\s*\["],
        none_of=[r"kagglehub\.model_download", r"""model_path\s*=\s*["']\.?/"""],
    ) & F.coalesce(named.contains("/") & ~named.startswith("/"), F.lit(False))
    found = [
        F.when(submits & unknown, finding("internet", "SUBMISSION_INTERNET", "warning", "internet setting of the submission unknown")),
        F.when(submits & setting, finding("internet", "SUBMISSION_INTERNET", "error", "a submission must run without internet")),
        F.when(submits & offline, finding("internet", "SUBMISSION_INTERNET", "pass", "the submission runs without internet")),
        F.when(installs & offline, finding("internet", "PIP_INSTALL_BLOCKED", "error", "pip install needs internet")),
        F.when(installs & unknown, finding("internet", "PIP_INSTALL", "warning", "pip install fails in a submission")),
        F.when(loads & offline, finding("internet", "METRIC_DOWNLOAD", "error", "evaluate.load() needs internet")),
        F.when(loads & unknown, finding("internet", "METRIC_DOWNLOAD", "warning", "evaluate.load() fails in a submission")),
        F.when(offline & (F.size(hub) > 0), finding("internet", "MODEL_DOWNLOAD", "error", "a model download needs internet")),
        F.when(offline & from_config, finding("internet", "MODEL_DOWNLOAD", "error", F.concat(named, F.lit(" needs internet")))),
    ]
    return F.array_compact(F.array(*found))


def used_columns(c: Column | str) -> Column:
    """Names of the data-frame columns that a script reads."""
    text = as_column(c)
    single = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in COLUMN_USES]))
    lists = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in COLUMN_LISTS]))
    listed = F.flatten(F.transform(lists, lambda t: F.regexp_extract_all(t, F.lit(r"""["'](\w+)["']"""), F.lit(1))))
    names = F.array_distinct(F.concat(F.filter(single, lambda n: ~n.isin(FRAME_ATTRIBUTES)), listed))
    return names


def pair_column_findings(
    c: Column | str, dataset: str, source: str, target: str, wildcard: str | None = None
) -> Column:
    """Whether a script that uses a dataset with other column names maps them to source and target."""
    text = as_column(c)
    uses, renames = text.contains(dataset), text.rlike(COLUMN_RENAME)

    def reads(name: str) -> Column:
        return text.rlike(rf"""\[["']{name}["']\]""")

    bad = uses & reads("source") & ~renames & ~reads(source)
    found = [
        F.when(bad, finding("columns", "PAIR_COLUMNS", "error", f"expects source and target, {dataset} has {source} and {target}")),
        F.when(uses & renames, finding("columns", "PAIR_COLUMNS", "pass", "columns are mapped")),
        F.when(uses & reads(source) & reads(target), finding("columns", "PAIR_COLUMNS", "pass", "columns are those of the dataset")),
    ]
    if wildcard:
        risky = text.contains(wildcard) & (reads("source") | reads("target"))
        found.insert(1, F.when(risky, finding("columns", "WILDCARD_SOURCE", "warning", f"{wildcard} may match other files")))
    return F.array_compact(F.array(*found))


def dataset_findings(c: Column | str, attached: Column | str) -> Column:
    """Data sets that a script reads but that are not among the attached ones (``owner/name`` or ``name``)."""
    text = as_column(c)
    read = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DATASET_PATHS])))
    known = F.transform(F.coalesce(as_column(attached), F.array().cast("array<string>")), lambda name: F.element_at(F.split(name, "/"), -1))
    missing = F.array_except(read, known)
    found = [
        F.when(F.size(missing) > 0, finding("datasets", "DATASET_SOURCES", "error", F.concat(F.lit("not attached: "), F.array_join(missing, ", ")))),
        F.when((F.size(read) > 0) & (F.size(missing) == 0), finding("datasets", "DATASET_SOURCES", "pass", "all data sets are attached")),
    ]
    return F.array_compact(F.array(*found))


def preflight(
    scripts: DataFrame,
    metadata: DataFrame,
    key: str,
    text: str,
    submission: bool = False,
    training: bool = False,
    pair_columns: Sequence[tuple[str, str, str]] = (),
) -> DataFrame:
    """All findings of a corpus of scripts against their metadata, one row each.

    ``metadata`` has the key, ``enable_internet`` and ``attached`` (an array of data sets); scripts without
    metadata are judged on their text. The packs for submissions and for trained models are asked for: by
    ``kind`` in the metadata (``inference``, ``training`` or ``mixed``) or, where that is missing, by
    ``submission`` and ``training``. ``pair_columns`` lists (data set, source column, target column) of data
    sets with column names of their own. Feed the result to ``worst_status`` for one verdict per script.
    """
    kind = F.col("kind") if "kind" in metadata.columns else F.lit(None).cast("string")
    known = metadata.select(key, "enable_internet", "attached", kind.alias("_kind"))
    joined = scripts.select(key, text).join(known, key, "left")
    nothing = F.array().cast(FINDING)

    def asked(kinds: list[str], default: bool, pack: Column) -> Column:
        return F.when(F.coalesce(F.col("_kind").isin(kinds), F.lit(default)), pack).otherwise(nothing)

    packs = [
        findings(text, DEPRECATIONS),
        asked(["inference", "mixed"], submission, submission_findings(text)),
        internet_findings(text, "enable_internet"),
        asked(["training", "mixed"], training, model_findings(text)),
        *[pair_column_findings(text, dataset, source, target) for dataset, source, target in pair_columns],
        progress_bar_findings(text),
        no_deps_findings(text),
        compute_metrics_findings(text),
        dataset_findings(text, "attached"),
    ]
    return explode_findings(joined, [key], F.concat(*packs))


def notebook_cells(c: Column | str) -> Column:
    """Cells of a notebook (JSON text) as structs; NULL where there is no cell array."""
    cells = F.try_variant_get(F.try_parse_json(as_column(c)), "$.cells", "array<variant>")

    def cell(v: Column) -> Column:
        lines = F.try_variant_get(v, "$.source", "array<string>")
        kind = F.schema_of_variant(F.try_variant_get(v, "$.source", "variant"))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$.source", "string"))
        return F.struct(
            F.try_variant_get(v, "$.cell_type", "string").alias("cell_type"),
            F.coalesce(F.array_join(lines, ""), text).alias("source"),
            F.try_variant_get(v, "$.outputs", "array<variant>").isNotNull().alias("has_outputs"),
        )

    return F.transform(cells, cell)


def code_of(cells: Column) -> Column:
    """All code cells of a notebook as one text."""
    code = F.filter(cells, lambda v: v["cell_type"] == "code")
    return F.array_join(F.transform(code, lambda v: F.coalesce(v["source"], F.lit(""))), "\n")


def structure_findings(c: Column | str, cells: Column) -> Column:
    """Format version, cells, cell types and sources, empty cells, outputs and kernel of a notebook."""
    document = F.try_parse_json(as_column(c))
    version = F.try_variant_get(document, "$.nbformat", "int")
    kernel = F.try_variant_get(document, "$.metadata.kernelspec", "variant")

    def of_cell(v: Column, i: Column) -> Column:
        name = F.concat(F.lit("cell "), i.cast("string"))
        code = v["cell_type"] == "code"
        known = F.coalesce(v["cell_type"].isin("code", "markdown", "raw"), F.lit(False))
        return F.array_compact(
            F.array(
                F.when(~known, finding("structure", "INVALID_CELL_TYPE", "error", F.concat(name, F.lit(": unknown type")))),
                F.when(v["source"].isNull(), finding("structure", "INVALID_CELL_SOURCE", "error", F.concat(name, F.lit(": no source")))),
                F.when(code & (F.trim(v["source"]) == ""), finding("structure", "EMPTY_CODE_CELL", "warning", F.concat(name, F.lit(": empty")))),
                F.when(code & ~v["has_outputs"], finding("structure", "MISSING_OUTPUTS", "warning", F.concat(name, F.lit(": no outputs")))),
            )
        )

    whole = F.array_compact(
        F.array(
            F.when(~version.eqNullSafe(F.lit(4)), finding("structure", "INVALID_NBFORMAT", "error", "not notebook format 4")),
            F.when(cells.isNull(), finding("structure", "MISSING_CELLS", "error", "no cells array")),
            F.when(F.size(cells) == 0, finding("structure", "EMPTY_NOTEBOOK", "error", "no cells")),
            F.when(cells.isNotNull() & kernel.isNull(), finding("structure", "MISSING_KERNELSPEC", "warning", "no kernelspec")),
        )
    )
    per_cell = F.flatten(F.transform(F.coalesce(cells, F.array().cast("array<struct<cell_type:string,source:string,has_outputs:boolean>>")), of_cell))
    return F.concat(whole, per_cell)


def late_install_findings(cells: Column) -> Column:
    """Packages installed only after the first five cells."""
    def installs(v: Column) -> Column:
        return (v["cell_type"] == "code") & F.coalesce(v["source"].rlike(r"pip\s+install|install_packages"), F.lit(False))

    early = F.exists(F.slice(cells, 1, 5), installs)
    named = code_of(cells).rlike(INSTALLS)
    return F.array_compact(F.array(F.when(named & ~early, finding("dependencies", "LATE_INSTALL", "warning", "packages are installed late"))))


def validate_notebooks(
    df: DataFrame, key: str, text: str, platform: str | None = None, tools: list[str] | None = None
) -> DataFrame:
    """All findings of a corpus of notebooks (JSON text), one row each. Row-local, no shuffle."""
    parsed = df.select(key, text, notebook_cells(text).alias("_cells"))
    ready = parsed.withColumn("_code", code_of(F.col("_cells")))
    code = F.col("_code")
    per_cell = F.flatten(
        F.transform(
            F.filter("_cells", lambda v: (v["cell_type"] == "code") & (F.trim(v["source"]) != "")),
            lambda v: F.concat(findings(v["source"], SYNTAX), template_variables(v["source"])),
        )
    )
    packs = [
        structure_findings(text, F.col("_cells")),
        per_cell,
        findings(code, CONFIG + PLACEHOLDERS),
        missing_installs(code),
        late_install_findings(F.col("_cells")),
        findings(code, platform_rules(platform) if platform else []),
        expected_tools(code, tools or []),
        findings(code, TOOL_DEPENDENCIES),
        findings(code, SECURITY),
    ]
    empty = F.array().cast(FINDING)
    return explode_findings(ready, [key], F.concat(*[F.coalesce(pack, empty) for pack in packs]))


def notebook_readiness(df: DataFrame, key: str, text: str, platform: str | None = None, strict: bool = False) -> DataFrame:
    """Score and verdict per notebook over the categories that are checked."""
    checked = [c for c in CATEGORIES if c != "platform" or platform]
    return readiness(df, validate_notebooks(df, key, text, platform), key, checked, strict)
