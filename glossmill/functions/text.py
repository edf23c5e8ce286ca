"""Cleaners and normalisers for translation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import SPACE, as_column

# The substitutions of the two cleaners, in the order they apply.
FULL_STEPS = [
    (rf"(?U){SPACE}*\({SPACE}*s{SPACE}*\)", "s"),
    (rf"(?U){SPACE}*\({SPACE}*(or|and){SPACE}+([^)]+){SPACE}*\){SPACE}*", " $1 $2 "),
    (rf"(?U){SPACE}*\({SPACE}*(or|and|i\.e\.|etc\.){SPACE}*\){SPACE}*", " $1 "),
    (rf"(?iuU){SPACE}*\({SPACE}*(ki|m|f|d|pl|sg|lú|giš|kur|uru){SPACE}*\)", ""),
    (rf"(?U){SPACE}*\({SPACE}*[a-z]{{1,3}}{SPACE}*\)", ""),
    (rf"(?U){SPACE}+", " "),
    (rf"(?U){SPACE}+([.,;:!?])", "$1"),
    (r"([.,;:!?])(?=[A-Za-z])", "$1 "),
]
LIGHT_STEPS = [
    (rf"(?U){SPACE}*\({SPACE}*s{SPACE}*\){SPACE}*", "s "),
    (rf"(?U){SPACE}*\({SPACE}*(or|and){SPACE}*\){SPACE}*", " $1 "),
    (rf"(?U){SPACE}*\({SPACE}*(ki|d|m|f|lu|munus){SPACE}*\){SPACE}*", " "),
    (rf"(?U){SPACE}+", " "),
]


def clean_translation(c: Column | str, level: str = "full") -> Column:
    """Take the editorial marks out of a translation: ``(s)``, ``( or x )``, ``(ki)`` and the like."""
    text = as_column(c)
    for pattern, replacement in {"full": FULL_STEPS, "light": LIGHT_STEPS}[level]:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def squeeze(c: Column | str) -> Column:
    """Strip, and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(as_column(c), f"(?U){SPACE}+", " "))


def with_prefix(c: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), as_column(c))


# Fixed values of the skeleton: vowels, subscript signs, determinatives, and the numbers that are kept.
VOWELS = "aeiuāēīūâêîûàèìùáéíú"
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉ₓ"
DETERMINATIVE = r"^\([a-zA-Z]{1,3}\)"
DIGITS = r"\d+(?:_\d+)*"
KEPT_NUMBER = (
    rf"(?U)^(?:[\d.,/]+|[+-]?(?:{DIGITS}(?:[.,](?:{DIGITS})?)?|[.,]{DIGITS})(?:[eE][+-]?{DIGITS})?"
    r"|[+-]?(?i:inf|infinity|nan))$"
)
LOWER = r"[\p{IsLowercase}\p{Lt}&&[^ₓ]]"
UPPER = r"\p{IsUppercase}"
DROPPED = f"(?iu){DETERMINATIVE}|[{VOWELS}{SUBSCRIPTS}-]"


def consonant_skeleton(c: Column | str) -> Column:
    """Per word: keep logograms and numbers; else drop determinative, subscripts, vowels and dashes."""
    words = F.split(squeeze(F.coalesce(as_column(c), F.lit(""))), " ")

    def skeleton(word: Column) -> Column:
        rest = F.regexp_replace(word, DROPPED, "")
        shortened = F.coalesce(F.nullif(rest, F.lit("")), F.lit("_"))
        kept = word.rlike(KEPT_NUMBER) | (~word.rlike(LOWER) & word.rlike(UPPER)) | (word == "")
        return F.when(kept, word).otherwise(shortened)

    return F.array_join(F.transform(words, skeleton), " ")


def dual_input(c: Column | str) -> Column:
    """``[SKL:skeleton] text``; empty for empty text."""
    text = F.coalesce(as_column(c), F.lit(""))
    tagged = F.concat(F.lit("[SKL:"), consonant_skeleton(text), F.lit("] "), text)
    return F.when(text == "", text).otherwise(tagged)


def extract_first(c: Column | str, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, in the order given; NULL where none does."""
    text = as_column(c)
    hits = [F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)) for pattern in patterns]
    return F.coalesce(*hits)


# How the settings of a training script are written.
SETTING_PATTERNS = {
    "model_name": [
        r"""["']model_name["']\s*:\s*["']([^"']+)["']""",
        r"""MODEL_NAME\s*=\s*["']([^"']+)["']""",
        r"""from_pretrained\s*\(\s*["']([^"']+)["']""",
    ],
    "batch_size": [r"""["']?batch_size["']?\s*[=:]\s*(\d+)"""],
    "gradient_accumulation_steps": [r"""["']?gradient_accumulation_steps["']?\s*[=:]\s*(\d+)"""],
    "max_src_len": [r"""["']?max_src_len["']?\s*[=:]\s*(\d+)"""],
    "max_tgt_len": [r"""["']?max_tgt_len["']?\s*[=:]\s*(\d+)"""],
    "num_epochs": [r"""["']?num_epochs["']?\s*[=:]\s*(\d+)"""],
    "save_total_limit": [r"""["']?save_total_limit["']?\s*[=:]\s*(\d+)"""],
    "dataloader_num_workers": [r"dataloader_num_workers\s*=\s*(\d+)"],
}
SETTING_FLAGS = {
    "fp16": r"""(?i)["']?fp16["']?\s*[=:]\s*True""",
    "save_only_model": r"""(?i)["']?save_only_model["']?\s*[=:]\s*True""",
    "clear_hf_cache": r"""(?i)["']?clear_hf_cache["']?\s*[=:]\s*True""",
}


def extract_settings(
    c: Column | str,
    patterns: dict[str, list[str]] | None = None,
    flags: dict[str, str] | None = None,
) -> Column:
    """Settings named in a script, as a map of texts; names that do not occur are left out.

    Flags are always present, as ``true`` or ``false``.
    """
    text = as_column(c)
    patterns = SETTING_PATTERNS if patterns is None else patterns
    flags = SETTING_FLAGS if flags is None else flags
    entries: list[Column] = []
    for name, forms in patterns.items():
        entries += [F.lit(name), extract_first(text, forms)]
    for name, form in flags.items():
        entries += [F.lit(name), text.rlike(form).cast("string")]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())
