"""Headline queries on the bench data; prints one JSON line.

Set BENCH_SF_DIR and BENCH_CPUS to change data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docproof.plans.queries import QUERIES  # noqa: E402
from docproof.session import build_session  # noqa: E402

HEADLINE = (
    "process_documents",
    "session_accuracy",
    "session_view",
    "apply_review",
    "export_session",
    "search_text",
    "recent_sessions",
    "document_with_children",
    "batch_summary",
    "island_count",
    "assemble_document_text",
    "assemble_token_stream",
    "clean_ocr",
    "strip_html",
    "normalize_number",
    "engine_compare",
    "stream_process",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["docs_by_type"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
