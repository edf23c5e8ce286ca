"""Rule scans over text corpora, and the roll-ups of their findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import as_column

SEVERITIES = ["pass", "warning", "error"]
FINDING = "array<struct<category:string,code:string,severity:string,message:string>>"


@dataclass(frozen=True)
class Rule:
    """A finding for every text that matches one of ``any_of`` (if given), all of ``all_of``, none of ``none_of``."""

    category: str
    code: str
    severity: str
    message: str
    any_of: list[str] = field(default_factory=list)
    all_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)

    def applies(self, text: Column) -> Column:
        return matches(text, self.any_of, self.all_of, self.none_of)


def matches(
    text: Column, any_of: list[str] | None = None, all_of: list[str] | None = None, none_of: list[str] | None = None
) -> Column:
    condition = F.lit(True)
    if any_of:
        hit = F.lit(False)
        for pattern in any_of:
            hit = hit | text.rlike(pattern)
        condition = condition & hit
    for pattern in all_of or []:
        condition = condition & text.rlike(pattern)
    for pattern in none_of or []:
        condition = condition & ~text.rlike(pattern)
    return condition


def finding(category: str, code: str, severity: str, message: Column | str) -> Column:
    """One finding as a struct. Its message may be a Column."""
    words = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(category).alias("category"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), words.alias("message")
    )


def findings(c: Column | str, rules: list[Rule]) -> Column:
    """All findings of one text as an array, in rule order. One projection serves all rules."""
    text = as_column(c)
    found = [F.when(rule.applies(text), finding(rule.category, rule.code, rule.severity, rule.message)) for rule in rules]
    return F.array_compact(F.array(*found)) if found else F.array().cast(FINDING)


def capture_findings(c: Column | str, pattern: str, category: str, code: str, severity: str, message: str) -> Column:
    """A finding for each match of a pattern; ``{}`` in the message stands for its first group."""
    before, after = message.split("{}")
    groups = F.regexp_extract_all(as_column(c), F.lit(pattern), F.lit(1))
    return F.transform(groups, lambda g: finding(category, code, severity, F.concat(F.lit(before), g, F.lit(after))))


def explode_findings(df: DataFrame, key: list[str], found: Column) -> DataFrame:
    """Findings as rows, each after the key of its text."""
    return df.select(*key, F.inline(found))


def rule_scan(df: DataFrame, key: list[str], text: str, rules: list[Rule]) -> DataFrame:
    """One row per text and rule that applies; texts are read once and nothing is shuffled."""
    return explode_findings(df, key, findings(text, rules))


def readiness(
    documents: DataFrame, found: DataFrame, key: str, categories: list[str], strict: bool = False
) -> DataFrame:
    """Errors, warnings, score 0–100 and verdict per document.

    A category passes when it has no error. The score is the share of passes among passes and errors.
    ``strict`` lets warnings block too. Documents without findings score 100.
    """
    sums = found.groupBy(key, "category").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    per_document = sums.groupBy(key).agg(
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"),
        F.count_if(F.col("errors") > 0).alias("failed_categories"),
    )
    every = documents.select(key).join(per_document, key, "left").na.fill(0)
    passed = F.lit(len(categories)) - F.col("failed_categories")
    total = passed + F.col("errors")
    score = F.when(total > 0, F.floor(100 * passed / total + 0.5)).otherwise(F.lit(0)).cast("int")
    blocking = F.col("errors") + (F.col("warnings") if strict else F.lit(0))
    return every.select(key, passed.alias("passed"), "errors", "warnings", score.alias("score"), (blocking == 0).alias("ready"))


def category_counts(found: DataFrame, key: str) -> DataFrame:
    """Errors, warnings and passes per document and category."""
    return found.groupBy(key, "category").agg(
        *[F.count_if(F.col("severity") == s).alias(name) for s, name in zip(SEVERITIES, ("passes", "warnings", "errors"))]
    )


def worst_status(found: DataFrame, key: list[str]) -> DataFrame:
    """``fail``, ``warn`` or ``pass`` per key, whichever is worst."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    label = F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("_rank").cast("int"))
    return found.groupBy(*key).agg(F.max(rank).alias("_rank")).select(*key, label.alias("status"))


def extract_refs(df: DataFrame, key: list[str], text: str, patterns: list[str], out: str = "ref") -> DataFrame:
    """Distinct references per document, found by any of the patterns (group 1)."""
    lists = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)) for pattern in patterns]
    merged = lists[0] if len(lists) == 1 else F.flatten(F.array(*lists))
    return df.select(*key, F.explode(F.array_distinct(merged)).alias(out))
