"""A larger trial: records made from the given tables many times over, a third of them in one entity with equal e-mails.

``python trial.py [COPIES]`` prints one JSON line with the number of records and the seconds of each part. Copies are made
by Spark from the unified view of the tables below ``$BENCH_SF_DIR``; 30 of sf0.1 are 6.2 million records.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.views import view  # noqa: E402
from kinweave.operators import resolution, scores  # noqa: E402
from kinweave.operators.components import connected_components  # noqa: E402
from kinweave.plans.report import identity_report  # noqa: E402
from kinweave.session import local_session  # noqa: E402
from kinweave.sources.shared import materialise  # noqa: E402


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 30
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    work = tempfile.mkdtemp(prefix="kinweave-trial-")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "trial", **{"spark.checkpoint.dir": work})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, run):
        start = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - start, 1)
        return out

    def stored(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    copy = F.concat(F.lit("-"), F.col("copy").cast("string"))
    hot = F.xxhash64("pk", "copy") % 3 == 0
    many = view(spark, folder, "unified").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    many = many.withColumns(
        {
            "entity_id": F.when(hot, F.lit("hot")).otherwise(F.concat("entity_id", copy)),
            "email": F.when(hot, F.lit("none@example.com")).when(F.col("email").isNotNull(), F.concat(copy, "email")),
            "pk": F.concat("pk", copy),
        }
    ).drop("copy")
    records = timed("records", lambda: materialise(many, "records").df)
    reports, _ = timed("profile", lambda: identity_report(records))
    timed("reports", lambda: [stored(df) for df in reports.values()])
    timed("levels", lambda: stored(scores.levels(scores.unified_view(records))))
    keyed = records.select(F.col("pk").alias("record_id"), "datasource", *resolution.FIELDS)
    edges = timed("edges", lambda: materialise(resolution.pair_scores(resolution.pairs(keyed)), "edges").df)
    timed("components", lambda: stored(connected_components(edges)))
    print(json.dumps({"records": records.count(), "edges": edges.count(), "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
