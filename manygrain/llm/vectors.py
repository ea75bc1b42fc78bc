"""Operator 10: near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors fall into buckets floor((a.x + b) / w) of several random projections, in
several tables; members of a bucket are compared by their exact cosine. Projections per table
follow log(rows), so that chance meetings stay few, and tables follow from the projections, so
that a pair at the threshold is missed with probability ``MISS`` at most.

A bucket is worked through in chunks and yields local roots, not pairs. Rows of large buckets
that ended in another component than most of their bucket are then compared with all of its
chunks, so no large bucket hides a link. Direct links are counted inside the components,
block by block, each pair once. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, bucket_of, connected_components, drop_stored, stored
from .simhash import local_roots

#: Bucket width over the distance at the threshold; chance of missing a pair there; rows that meet by chance in a bucket; rows in a chunk.
WIDTH, MISS, CHANCE, CHUNK = 8.0, 1e-4, 32, 1024


def collision(ratio: float) -> float:
    """Probability that one projection of width w joins two points at distance w / ratio."""
    phi = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def shape(n: int, cosine: float) -> tuple[float, int, int]:
    """Width, projections per table, tables, for n vectors."""
    near = math.sqrt(2 - 2 * cosine) or 1e-6
    p1, p2 = collision(WIDTH), collision(WIDTH * near / math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n / CHANCE, 2)) / -math.log(p2)))
    return WIDTH * near, k, math.ceil(math.log(MISS) / math.log1p(-(p1**k)))


def units(rows: pa.Array) -> np.ndarray:
    """Unit vectors of equally long lists, in double precision."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def grouped(keys: list[str], body: Callable[[pa.Table], pa.Table]) -> Callable:
    """A mapInArrow function over partitions sorted by ``keys``: ``body`` of each group's rows, which a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(starts, starts[1:]):
                now = tuple(c[a] for c in columns)
                if held and now != last:
                    out.append(body(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
            if out and (done := pa.concat_tables(out).combine_chunks()).num_rows:
                yield from done.to_batches()
        if held and (done := body(pa.Table.from_batches(held))).num_rows:
            yield from done.combine_chunks().to_batches()

    return run


def by_group(df: DataFrame, keys: list[str], body: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(grouped(keys, body), schema)


def hashed(classes: DataFrame, n: int, cosine: float, seed: int = 5) -> DataFrame:
    """bucket, node: a row for each class and table. Vectors of another length never share a bucket."""
    width, k, tables = shape(n, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            node, vec = batch.column(0), batch.column(1)
            lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == d))
                some, ids = vec.take(at), node.take(at)
                if d not in made:
                    rng = np.random.default_rng((seed, d))
                    made[d] = rng.standard_normal((d, k * tables)), rng.uniform(0, width, k * tables), rng.integers(1, 1 << 63, k * tables, dtype=np.uint64) | np.uint64(1)
                a, b, mixer = made[d]
                cells = np.floor((units(some) @ a + b) / width).astype(np.int64).view(np.uint64) * mixer
                keys = np.add.reduce(cells.reshape(len(at), tables, k), axis=2)
                keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(d)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t].copy().view(np.int64)), ids], names=["bucket", "node"])

    return classes.select("node", "vec").mapInArrow(run, "bucket long, node long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def by_cosine(cosine: float) -> tuple[Callable, Callable]:
    """How rows are loaded and compared: unit vectors, cosine of ``cosine`` or more."""
    return units, lambda x, y: x @ y.T >= cosine


def link_buckets(tables: DataFrame, vectors: DataFrame, load: Callable, near: Callable, chunk: int = CHUNK) -> DataFrame:
    """Edges that connect all rows of a bucket that ``near`` joins. tables (written): bucket, node; vectors: node, vec.

    What is dealt and kept by bucket are numbers; a vector is fetched where its bucket's chunk is compared.
    """

    def pairs(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(x), chunk):
            for b in range(a, len(x), chunk):
                i, j = np.nonzero(near(x[a : a + chunk], x[b : b + chunk]))
                keep = i + a < j + b
                yield i[keep] + a, j[keep] + b

    def within(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        if len(node) < 2:
            return _edges([], [])
        root = local_roots(len(node), pairs(load(group.column("vec").combine_chunks())))
        at = np.flatnonzero(root != np.arange(len(root)))
        return _edges(node[at], node[root[at]])

    sizes = stored(tables.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1"), "sizes")
    placed = tables.join(beside(sizes), "bucket").withColumn("chunk", bucket_of(F.col("node"), F.col("bucket"), buckets=1 << 30) % F.ceil(F.col("rows") / chunk).cast("int"))
    placed = stored(placed, "placed")
    edges = stored(by_group(placed.select("bucket", "chunk", "node").join(vectors, "node"), ["bucket", "chunk"], within, "a long, b long").distinct(), "edges")
    large = placed.where(F.col("rows") > chunk)
    if large.isEmpty():
        drop_stored(placed, sizes)
        return edges
    # rows of large buckets outside their bucket's main component meet every chunk of it
    part = connected_components(edges)
    large = stored(large.join(part.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")), "large")
    drop_stored(part, placed, sizes)
    main = large.groupBy("bucket", "part").count().groupBy("bucket").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    placed, large = large, large.join(main, "bucket")
    chunks = F.sequence(F.lit(0), F.ceil(F.col("rows") / chunk).cast("int") - 1)
    guests = large.where("part <> main").select("bucket", F.explode(chunks).alias("chunk"), "node", "part", F.lit(1).alias("guest"))
    hosts = large.join(guests.select("bucket").distinct(), "bucket").select("bucket", "chunk", "node", "part", F.lit(0).alias("guest"))

    def across(group: pa.Table) -> pa.Table:
        guest, part = (group.column(c).to_numpy() for c in ("guest", "part"))
        g, h = np.flatnonzero(guest == 1), np.flatnonzero(guest == 0)
        if not len(g) or not len(h):
            return _edges([], [])
        x = load(group.column("vec").combine_chunks())
        found = set()
        for a in range(0, len(g), chunk):
            for b in range(0, len(h), chunk):
                i, j = np.nonzero(near(x[g[a : a + chunk]], x[h[b : b + chunk]]))
                i, j = part[g[a + i]], part[h[b + j]]
                found.update(zip(i[i != j].tolist(), j[i != j].tolist()))
        return _edges(*zip(*found)) if found else _edges([], [])

    met = hosts.unionByName(guests).join(vectors, "node")
    more = stored(by_group(met, ["bucket", "chunk"], across, "a long, b long").distinct(), "edges")
    drop_stored(placed)
    return edges.unionByName(more)


def count_links(members: DataFrame, cosine: float, block: int = CHUNK // 2) -> DataFrame:
    """node, links: the weight of all other classes of its component at ``cosine`` or more. members: component, node, weight, vec.

    A row is copied to one task per block of its component; blocks have ``block`` rows, and up to
    eight times as many in components of over 64 blocks.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("rows"))
    sizes = stored(sizes, "sizes")
    wide = F.greatest(F.lit(block), F.least(F.lit(8 * block), F.ceil(F.col("rows") / 64)))
    rows = members.join(beside(sizes), "component").withColumn("blocks", F.ceil(F.col("rows") / wide).cast("int"))
    rows = rows.withColumn("own", bucket_of(F.col("node"), buckets=1 << 30) % F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rows = rows.withColumn("pair", F.explode(pairs)).select("component", "pair.i", "pair.j", "own", "node", "weight", "vec")

    def counted(group: pa.Table) -> pa.Table:
        i, j, own, node, weight = (group.column(c).to_numpy() for c in ("i", "j", "own", "node", "weight"))
        x = units(group.column("vec").combine_chunks())
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ours, theirs = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for a in range(0, len(left), block):
            some = left[a : a + block]
            near = x[some] @ x[right].T >= cosine
            if i[0] == j[0]:
                near[np.arange(len(some)), np.arange(a, a + len(some))] = False
            ours[a : a + block] = near @ weight[right]
            theirs += near.T @ weight[some]
        if i[0] == j[0]:
            return pa.table({"node": pa.array(node[left], pa.int64()), "links": pa.array(ours)})
        return pa.table({"node": pa.array(np.concatenate([node[left], node[right]]), pa.int64()), "links": pa.array(np.concatenate([ours, theirs]))})

    out = by_group(rows, ["component", "i", "j"], counted, "node long, links long")
    return out.groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, as
    do rows without vec_id (their component is null, and they are not kept). Vectors of different
    lengths never link. Equal vectors, repeated rows too, count as links of each other.
    """
    vec = F.col("vec")
    sound = F.exists(vec, lambda v: v != 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").alias("vec")).withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    classes = rows.where("sound").groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    classes = stored(classes, "classes")
    tables = stored(hashed(classes, classes.count(), cosine), "tables")
    edges = link_buckets(tables, classes.select("node", "vec"), *by_cosine(cosine), CHUNK)
    drop_stored(tables)
    components = connected_components(edges)
    inside = classes.join(components, "node")
    links = count_links(inside.select("component", "node", "weight", "vec"), cosine, CHUNK // 2)
    known = stored(classes.join(components, "node", "left").join(links, "node", "left").select("vec", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.lit(True).alias("sound")), "known")
    out = rows.join(known, ["vec", "sound"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN components c ON c.a = e.vec_id LEFT JOIN counts n ON n.a = e.vec_id
"""
