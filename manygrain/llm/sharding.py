"""Operator 5: shards by balanced label propagation.

Documents with equal texts are neighbours. Members of a group with the same label always move
together, so the graph that iterates holds cells (group, label seat) with counts: a group of any
size is at most shards x SEATS rows. Each round a cell looks for the shard where most of its
group sits and that has room, and moves there if the round's quota admits it. The documents take
their cell's shard at the end; unlinked documents fill what is left, so that the counts of the
shards differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, drop_stored, ranked, stored

SEATS, BINS, ROUNDS = 16, 256, 40


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move cells (key, cell, n, shard) towards their group's shards; shards gain nothing over their quota."""
    spark, shards = cells.sparkSession, len(quotas)
    whole = max(1, quotas[-1] // 8)
    for k in range(rounds):
        load = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
        room = [quotas[s] - load.get(s, 0) for s in range(shards)]
        open_ = [s for s in range(shards) if room[s] > 0]
        if not open_:
            break
        votes = cells.groupBy("key", "shard").agg(F.sum("n").alias("v"))
        group = votes.groupBy("key").agg(
            F.map_from_entries(F.collect_list(F.struct("shard", "v"))).alias("votes"),  # one entry a shard at most
            F.max(F.when(F.col("shard").isin(open_), F.struct("v", (-F.col("shard")).alias("s")))).alias("best"),
            F.sum("v").alias("total"),
        ).where("size(votes) > 1")
        # ties: towards the lower shard, or from a full one to one with room
        tied = (-F.col("best.s") < F.col("shard")) | ~F.col("shard").isin(open_)
        better = (F.col("best.v") > F.col("votes")[F.col("shard")]) | ((F.col("best.v") == F.col("votes")[F.col("shard")]) & (-F.col("best.s") != F.col("shard")) & tied)
        bin_ = F.when(F.col("total") > whole, bucket_of(F.col("key"), F.col("cell"), F.lit(k), buckets=BINS)).otherwise(bucket_of(F.col("key"), F.lit(k), buckets=BINS))
        wish = cells.join(group, "key", "left").withColumn("to", F.when(better, -F.col("best.s")).cast("int")).withColumn("bin", F.when(F.col("to").isNotNull(), bin_))
        wish = stored(wish.select("key", "cell", "n", "shard", "to", "bin"), "wish")
        asked = wish.where("to is not null").groupBy("to", "bin").agg(F.sum("n").alias("n")).collect()
        granted = []
        for to, b, n in sorted(tuple(r) for r in asked):
            if n <= room[to]:
                room[to] -= n
                granted.append((to, b))
        if not granted:
            drop_stored(wish)
            break
        yes = F.broadcast(spark.createDataFrame(granted, "to int, bin int").withColumn("yes", F.lit(True)))  # at most shards x BINS rows
        after = wish.join(yes, ["to", "bin"], "left").select("key", "cell", "n", F.when(F.col("yes"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        after = stored(after, "cells")
        drop_stored(cells, wish)
        cells = after
    return cells


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text has size 8 and checksum 0 and no neighbours; empty texts are equal texts. Rows
    without doc_id and repeated rows are rows like any other. Fewer rows than shards leave the
    last shards empty.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"),
    )
    rows = stored(rows.withColumn("cell", bucket_of(F.col("doc_id"), F.col("text_crc32"), buckets=shards * SEATS)), "rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    cells = rows.where("key is not null").groupBy("key", "cell").agg(F.count("*").alias("n"))
    linked = cells.groupBy("key").agg(F.sum("n").alias("members")).where("members > 1").select("key")
    cells = stored(cells.join(linked, "key").select("key", "cell", "n", (F.col("cell") % shards).alias("shard")), "cells")
    cells = propagate(cells, quotas)
    labelled = rows.join(cells.select("key", "cell", "shard"), ["key", "cell"], "left").select("doc_id", "size", "text_crc32", F.coalesce("shard", F.lit(-1)).alias("label"))
    labelled = stored(labelled, "labelled")
    drop_stored(rows)
    numbered, offsets, totals = ranked(labelled, "label", ["doc_id", "text_crc32"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    kept = [min(totals.get(s, 0), quotas[s]) for s in range(shards)]
    over, at = {-1: 0}, totals.get(-1, 0)
    for s in range(shards):
        over[s] = at
        at += totals.get(s, 0) - kept[s]
    facts = [(s, b, first, 0 if s < 0 else kept[s], over[s]) for s, ats in offsets.items() for b, first in enumerate(ats)]
    facts = F.broadcast(spark.createDataFrame(facts, "label int, _bucket int, _first long, _kept long, _over long"))  # a row for each of 25 labels and their buckets
    rank = F.col("_first") + F.col("_row")
    numbered = numbered.join(facts, ["label", "_bucket"]).withColumn("_rank", rank).withColumn("_pool", F.col("_over") + F.col("_rank") - F.col("_kept"))
    fits = F.col("_rank") < F.col("_kept")
    shard, slot, start = F.lit(None).cast("int"), F.lit(None).cast("long"), sum(quotas[s] - kept[s] for s in range(shards))
    for s in reversed(range(shards)):
        start -= quotas[s] - kept[s]
        shard = F.when(F.col("_pool") >= start + quotas[s] - kept[s], shard).otherwise(F.lit(s))
        slot = F.when(F.col("_pool") >= start + quotas[s] - kept[s], slot).otherwise(F.col("_pool") - start + kept[s])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(fits, F.col("label")).otherwise(shard).alias("shard"),
        F.when(fits, F.col("_rank")).otherwise(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard_documents(table(spark, sf_dir, "documents"), 24)
