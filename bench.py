"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textvane.plans import catalog  # noqa: E402
from textvane.session import local_session  # noqa: E402

HEADLINE = (
    "scan_tables upsert_latest latest_labels unlabelled_items sequence_ids tokenise word_count vocab_index tfidf "
    "dictionary_parse lemmatise inflections edit_neighbours spell_correct compound_split clean_titles "
    "training_examples nb_scores nb_leave_one_out relevant_items ensemble_weights ensemble_scores "
    "nearest_centroid cluster_score kmeans mlp_forward page_extract page_records stream_word_count stream_refresh"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries = catalog.queries()
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)) if cpus.isdigit() else 16, memory="12g")
    # The first job of a session pays for starting it.
    queries["word_count"](spark, sf_dir.replace("sf0.1", "sf0.01") if "sf0.1" in sf_dir else sf_dir).count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
