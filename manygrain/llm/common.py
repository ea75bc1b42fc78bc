"""Shared helpers: reading tables, written intermediate tables, distributed ranks, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A struct of the columns, whatever their names."""
    return F.struct(*[df["`" + c.replace("`", "``") + "`"].alias(c) for c in (df.columns if columns is None else columns)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="manygrain-")
    return shared_dir.own


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; the folder is the cluster's to empty
            return


#: Settings of a written table's execution: it removes its shuffle files when it ends, and hands rows to Python in small batches.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def stored(df: DataFrame, what: str, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: a lost executor loses none of it.

    The write's shuffle files go when it ends, as the table stands in for them. With a ``path`` the
    table is written there and stays; else it goes when the program ends.
    """
    spark, named = df.sparkSession, path
    path = path or f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not named:
        _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            remove(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


#: Up to so many small rows (some 20 MB) a table is broadcast.
FEW = 500_000


def beside(df: DataFrame, weight: Column | None = None, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at most, or if ``weight`` (small values a row holds) sums up to that; else a join shuffles."""
    total = df.agg(F.count("*") if weight is None else F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def bucket_of(*cols: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


#: Rows of a key that are numbered in one task, about.
RANKED = 1 << 20


def ranked(df: DataFrame, key: str, spread: Sequence[str], order: Sequence[Column], least: int = 32) -> tuple[DataFrame, dict, dict]:
    """Number the rows of each key from 0 without gaps, without one task per key.

    Rows of a key are dealt to ``least`` buckets, or one for RANKED rows, by a hash of ``spread``; a
    window numbers each (key, bucket), the counts of all (key, bucket) are collected and give the
    offsets. The caller bounds the number of keys; what is collected is one number per key and bucket.
    Adds ``_bucket`` and ``_row`` (from 0); returns also {key: offsets by bucket} and {key: rows}. ``df``: a written table.
    """
    totals = {r[0]: r[1] for r in df.groupBy(key).count().collect()}
    many = {k: -(-n // RANKED) for k, n in totals.items() if n > least * RANKED}
    buckets = F.coalesce(F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, n)])[F.col(key)], F.lit(least)) if many else F.lit(least)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), buckets).cast("int"))
    counts = {(r[0], r[1]): r[2] for r in df.groupBy(key, "_bucket").count().collect()}
    offsets: dict = {}
    for k in totals:
        at, offsets[k] = 0, []
        for b in range(many.get(k, least)):
            offsets[k].append(at)
            at += counts.get((k, b), 0)
    window = Window.partitionBy(key, "_bucket").orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window).cast("long") - 1), offsets, totals


#: Up to so many edges (8 MB) components are found in the memory of one task.
INSIDE = 500_000


def _components_inside(edges: DataFrame) -> DataFrame:
    """node, component of the edges u, v, found in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .simhash import local_roots

        ends = [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for batch in batches if batch.num_rows]
        if ends:
            u, v = np.concatenate(ends, axis=1)
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = local_roots(len(nodes), iter([(at[: len(u)], at[len(u) :])]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(solve, "node long, component long")


def connected_components(edges: DataFrame, rounds: int = 60, inside: int | None = None) -> DataFrame:
    """Components of an undirected graph: up to ``inside`` (INSIDE) edges in one task, else by alternating large-star and small-star rounds.

    ``edges`` has columns a, b (long). Returns node, component (the smallest node that can be
    reached); nodes without an edge to another node are absent. Null ends are ignored.
    Hot nodes: minima are pre-aggregated, the joins back are plain shuffle joins of two
    tables, which adaptive execution splits. Each round is written and the one before deleted:
    some four tables a round, with a file for each shuffle partition however few edges there are.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() <= (INSIDE if inside is None else inside):
        out = stored(_components_inside(e), "components")
        drop_stored(e)
        return out
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: every neighbour lies below its node here
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "edges")
        drop_stored(e, least, large, low)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._stored_at = e._stored_at
    return out
