"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from manygrain import rollup, share_of_parent, summarize_with_margins
from manygrain.queries import QUERIES

HEADLINE = ("rollup_basic", "cube_basic", "product_spec", "fixed_by", "share_parent", "share_parent_3level", "share_total_cube", "expand_then_window", "nest_rows", "count_distinct_margins")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.range(100_000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int").alias(c) for k, (c, n) in enumerate((("division", 50), ("region", 20), ("store", 10), ("item", 5)))], F.rand(1).alias("revenue")).cache()
    rows.count()

    def parent_share(spark, folder):
        return summarize_with_margins(rows, r=F.sum("revenue"), share=share_of_parent("r"), grouping=rollup("division", "region", "store", "item"), margin_label=None)

    seconds = {}
    for name, f in ({n: QUERIES[n] for n in HEADLINE} | {"parent_share_100k": parent_share}).items():
        took = []
        for _ in range(4):
            began = time.time()
            f(spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
