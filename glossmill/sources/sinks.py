"""Writers of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import clean_translation


def submission_table(df: DataFrame, id_column: str, output_column: str, clean: str | None = None) -> DataFrame:
    """The two columns of a submission; ``clean`` names a cleaner for the output."""
    output = F.col(output_column) if clean is None else clean_translation(output_column, clean)
    return df.select(F.col(id_column), output.alias(output_column))


def write_submission(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Submission as CSV with header, one part file per task. Rows carry their id, so order is free."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')
