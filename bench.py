"""Times the headline queries and prints one JSON line.

The session and its Python workers are started before the clock. The given tables are single row groups, so the session
asks for texts to be dealt over the cores (``spark.glossmill.deal``); the move counts in the times.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from glossmill.plans import QUERIES, load_all  # noqa: E402
from glossmill.session import DEAL, local_session  # noqa: E402

HEADLINE = [
    "corpus_bleu_by_lang", "sentence_bleu", "worst_best_sentences", "kfold_bleu", "corpus_chrf", "corpus_chrf_words", "corpus_ter",
    "clean_translation_full", "consonant_skeleton", "scan_secrets", "readiness", "profile_lineitem", "infer_types_orders", "table_fingerprint",
    "assign_versions", "datasets_by_run", "datasets_with_links", "lineage_turns", "resolve_refs", "retention_plan", "study_best",
    "log_tail", "list_runs", "run_timeouts", "weighted_vote", "missing_refs", "batch_infer_dummy",
]

WARM_UP = ["table_counts", "batch_infer_dummy"]


def run(spark, name: str, folder: str) -> float:
    """Seconds to compute every row and column of a query."""
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    load_all()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", **{DEAL: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        run(spark, name, folder)
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    report = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
