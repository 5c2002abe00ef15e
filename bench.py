"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the local cores. Each
query runs once to warm the JVM on the smallest table at hand and once timed; the
result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from textassay.plans import queries
from textassay.session import build

HEADLINE = [
    "corpus_profile", "corruption_by_class", "pattern_counts_documents", "repair_text", "collision_table", "tokens_df",
    "tfidf_weights", "vocab_diff", "dup_titles_units", "exact_dupes", "stratified_split", "split_fingerprint",
    "paired_delta", "neardup_pairs", "neardup_units", "neardup_recall", "oov_flags", "bayes_2x2",
]


def fit_logistic(spark, folder):
    """One TF-IDF and logistic fit on 80% of a sample of up to 5,000 rows, sampling and scoring of all other rows included."""
    return queries.fitted(spark, folder).results


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", **{
        "spark.master": f"local[{cpus}]", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
    })
    spark.sparkContext.setLogLevel("OFF")
    runs = {name: getattr(queries, name) for name in HEADLINE} | {"fit_logistic": fit_logistic}
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    timings = {}
    for name, query in runs.items():
        if os.path.isdir(small) and name != "fit_logistic":
            query(spark, small).write.format("noop").mode("overwrite").save()
        start = time.time()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
