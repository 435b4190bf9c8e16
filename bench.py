"""Time the headline queries on the given tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_calls", "segment_scan", "page_specs", "clean_characters", "normalize_text",
    "script_plausibility", "memo_keys", "protect_literals", "protect_restore", "token_validation",
    "html_balance", "batches_of_documents", "batch_fill", "batches_of_talk", "word_chunks",
    "rolling_context", "batch_prompts", "answers_strict", "reconciled_batches", "halved_batches",
    "translated_documents", "translated_marked_documents", "memo_upsert", "memo_hits", "memo_run",
    "page_ranges", "page_sets", "run_progress", "output_stems", "page_modes", "block_shapes",
    "size_groups", "mergeable_pairs", "free_boxes", "free_room", "covered_images",
    "merged_columns", "joined_lines", "reading_order", "stream_memo",
]


def dealt(spark, sf: str, files: int) -> str:
    """The tables over several files each, as large tables are; the given ones are one split each. Not timed."""
    from folioflow.session import shared_dir

    folder = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    for name in sorted(n for n in os.listdir(sf) if n.endswith(".parquet")):
        spark.read.parquet(f"{sf}/{name}").repartition(files).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    from folioflow.plans.registry import load_all
    from folioflow.session import local_session, release, ship_package

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    entries = load_all()
    chosen = sys.argv[1:] or HEADLINE
    tables = dealt(spark, sf, int(cpus) if cpus.isdigit() else 8)
    entries["corpus_calls"].run(spark, tables).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in chosen:
        start = time.perf_counter()
        # streams watch the given folder itself
        entries[name].run(spark, sf if name.startswith("stream_") else tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
        print(f"{times[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    release(spark, tables)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
