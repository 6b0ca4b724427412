"""Time the headline queries: prints one JSON line.

Every query writes all of its rows and columns to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.session import tuned_session, workspace  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

LIMIT = 1_700  # seconds after which what is done is reported

HEADLINES = (
    "norm_rules",
    "ads_label",
    "flagged_per_business",
    "featurize_metadata",
    "add_meta_features",
    "dedup_reviews",
    "word_ngrams",
    "doc_freq",
    "corpus_cosine",
    "pair_cosine",
    "rules_label",
    "pseudo_label",
    "enrich_business",
    "ens_precision",
    "avg_report",
    "error_slice",
    "tune_rules_or_ml",
    "cosine_sweep",
    "tune_oof",
    "group_kfold",
    "vocab_topk",
    "tfidf_features",
    "lr_score",
    "holdout_eval",
    "stream_label",
    "group_cv",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = tuned_session(
        "bench", f"local[{cpus}]", spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_report"](spark, sf_dir).count()  # start workers before the clock
    seconds = {}

    def report(early: bool = False) -> None:
        """The one line; if the time is up, over the queries that were done."""
        line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec"}
        line |= {"queries": seconds, "sf": sf_dir.rstrip("/").split("/sf")[-1]}
        if len(seconds) < len(names):
            line["not_done"] = [n for n in names if n not in seconds]
        print(json.dumps(line), flush=True)
        if early:
            os._exit(1)

    limit = threading.Timer(float(os.environ.get("BENCH_LIMIT", LIMIT)), report, [True])
    limit.daemon = True
    limit.start()
    for name in names:
        start = time.perf_counter()
        with workspace(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    limit.cancel()
    report()
    spark.stop()


if __name__ == "__main__":
    main()
