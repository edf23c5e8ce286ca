"""Status vocabularies and log patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions import as_column

# What each vocabulary maps to what, and the answer for anything else.
VOCABULARIES = {
    "kernel": (
        {
            "queued": "queued",
            "running": "running",
            "complete": "complete",
            "error": "error",
            "cancelled": "cancelled",
            "cancelacknowledged": "cancelled",
        },
        "error",
    ),
    "tracking": ({"complete": "FINISHED", "cancelled": "KILLED"}, "FAILED"),
    "report": ({"running": "RUNNING", "finished": "FINISHED", "failed": "FAILED"}, "UNKNOWN"),
}
KERNEL_MESSAGE = r"""(?i)status "(?:KernelWorkerStatus\.)?(\w+)\""""
JOB_PREFIX = "JOB_STATE_"
TERMINAL = ["complete", "completed", "error", "failed", "cancelled"]

# Lines that count as errors in a log. The first four ignore case.
ERROR_PATTERNS = [
    "(?i:error)",
    "(?i:exception)",
    "(?i:traceback)",
    "(?i:failed)",
    "--->",
    "RuntimeError",
    "ValueError",
    "TypeError",
    "AttributeError",
    "ImportError",
    "ModuleNotFoundError",
]
ERROR_LINE = "|".join(ERROR_PATTERNS)


def normalise_status(c: Column | str, vocabulary: str = "kernel") -> Column:
    """One status vocabulary out of many; unknown text becomes the vocabulary's default."""
    text = as_column(c)
    if vocabulary == "submission":
        word = F.lower(text)
        return (
            F.when(word.contains("pending"), F.lit("pending"))
            .when(word.contains("complete"), F.lit("complete"))
            .otherwise(F.lit("error"))
        )
    if vocabulary == "job":
        filled = F.when(text.isNull() | (text == ""), F.lit("UNKNOWN")).otherwise(text)
        return F.regexp_replace(filled, JOB_PREFIX, "")
    mapping, default = VOCABULARIES[vocabulary]
    result = F.lit(default)
    word = F.lower(text)
    for raw, name in mapping.items():
        result = F.when(word == raw, F.lit(name)).otherwise(result)
    return result


def status_from_message(c: Column | str) -> Column:
    """The kernel status inside a sentence such as ``a/b has status "KernelWorkerStatus.RUNNING"``."""
    return normalise_status(F.regexp_extract(as_column(c), KERNEL_MESSAGE, 1), "kernel")


def is_error_line(c: Column | str) -> Column:
    return as_column(c).rlike(ERROR_LINE)


def infer_phase(phase: Column | str, has_model: Column | str, checkpoint: Column | str) -> Column:
    """The reported phase; without one, what the stored files say."""
    return F.coalesce(
        as_column(phase),
        F.when(as_column(has_model), F.lit("completed")),
        F.when(as_column(checkpoint).isNotNull(), F.lit("training")),
        F.lit("not_started"),
    )
