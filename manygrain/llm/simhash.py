"""Operator 4: SimHash near-duplicates, linked through vantage-point trees.

Fingerprints are reduced to distinct ones first, so copies never meet again. A tree of vantage
points splits the Hamming space: at a node, fingerprints within ``mu`` of the vantage point go
left, the others right, and those of the left side that a fingerprint right of the boundary
could still reach (distance over mu - radius) go right as well. Two fingerprints within
``radius`` therefore meet in at least one leaf; leaves go on splitting in memory and
end in blocks compared exactly. A leaf yields one row per member (its local root), not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_stored, stored

#: Fingerprints sampled to place the vantage points of the shared tree, at most.
SAMPLE = 1 << 15
#: Distinct fingerprints that a leaf of the shared tree is meant to hold.
LEAF = 8192
BLOCK = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int, bits: int = 64) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles, repeats included; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    votes = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = np.array(hashes[at : at + (1 << 15)], dtype=">u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int, extra: list[str] | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the ``extra`` columns of every row."""
    extra = extra or []
    rows = docs.select("text", "doc_id", *extra)
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(0)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1, batch.num_columns)], pa.array(values)], names=[*batch.schema.names[1:], "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields[1:])
    return rows.mapInArrow(run, f"{schema}, fp long")


def plant(sample: np.ndarray, depth: int, radius: int) -> list:
    """The shared tree: nested [vantage point, mu, left, right], leaves are their numbers."""
    rng, leaves = np.random.default_rng(7), iter(range(1 << 62))

    def grow(points: np.ndarray, left: int) -> list | int:
        if left == 0 or len(points) < 8:
            return next(leaves)
        vantage = points[rng.integers(len(points))]
        d = np.bitwise_count(points ^ vantage)
        # of the middle distances, the boundary that the fewest points crowd
        mus = np.unique(np.quantile(d, np.linspace(0.35, 0.65, 7)).astype(int))
        cost = [(((d > mu - radius) & (d <= mu)).sum() + abs((d <= mu).mean() - 0.5) * len(d), mu) for mu in mus]
        mu = int(min(cost)[1])
        near = d <= mu
        if near.all() or not near.any():
            return next(leaves)
        return [int(vantage), mu, grow(points[near], left - 1), grow(points[~near | (d > mu - radius)], left - 1)]

    return grow(sample, depth)


def visit(tree: list | int, fps: np.ndarray, index: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) for each leaf that rows of ``index`` belong to."""
    if len(index) == 0:
        return
    if isinstance(tree, int):
        yield tree, index
        return
    vantage, mu, left, right = tree
    d = np.bitwise_count(fps[index] ^ np.uint64(vantage)).astype(np.int64)
    yield from visit(left, fps, index[d <= mu], radius)
    yield from visit(right, fps, index[d > mu - radius], radius)


def near_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within ``radius``, some more than once; splits by vantage points, then compares blocks."""
    rng = np.random.default_rng(11)

    def search(index: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(index) <= BLOCK or depth > 24:
            for a in range(0, len(index), BLOCK):
                one = fps[index[a : a + BLOCK]]
                for b in range(a, len(index), BLOCK):
                    x, y = np.nonzero(np.bitwise_count(one[:, None] ^ fps[index[b : b + BLOCK]][None, :]) <= radius)
                    keep = (x + a) < (y + b)
                    yield index[x[keep] + a], index[y[keep] + b]
            return
        d = np.bitwise_count(fps[index] ^ fps[index[rng.integers(len(index))]]).astype(np.int64)
        mu = int(np.median(d))
        near, far = index[d <= mu], index[d > mu - radius]
        if max(len(near), len(far)) > 0.9 * len(index):
            yield from search(index, 25)
            return
        yield from search(near, depth + 1)
        yield from search(far, depth + 1)

    yield from search(np.arange(len(fps)), 0)


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place of each place's component."""
    root = np.arange(n)
    ends = [np.stack(p) for p in pairs if len(p[0])]
    if not ends:
        return root
    a, b = np.concatenate(ends, axis=1)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def link_fingerprints(reps: DataFrame, radius: int) -> DataFrame:
    """Edges a, b among the nodes of ``reps`` (node long, fp long, fp distinct) that connect what lies within ``radius``.

    The tree's vantage points come from the SAMPLE fingerprints with the smallest hashes; its
    depth follows the count, so leaves stay near LEAF rows, up to SAMPLE / 8 leaves. Larger leaves
    are searched by vantage points of their own, inside their task.
    """
    n = reps.count()
    if n < 2:
        return reps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    sample = np.array([r[0] for r in reps.select("fp", F.xxhash64("fp").alias("h")).orderBy("h").limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(n / LEAF))))
    tree = plant(sample, depth, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for leaf, at in visit(tree, fp.view(np.uint64), np.arange(len(fp)), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int64)), pa.array(node[at]), pa.array(fp[at])], names=["leaf", "node", "fp"])

    def compare(leaf: pa.Table) -> pa.Table:
        node, fp = (leaf.column(c).to_numpy() for c in ("node", "fp"))
        root = local_roots(len(fp), near_pairs(np.ascontiguousarray(fp).view(np.uint64), radius))
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(node[at], pa.int64()), "b": pa.array(node[root[at]], pa.int64())})

    routed = reps.select("node", "fp").mapInArrow(route, "leaf long, node long, fp long")
    return routed.groupBy("leaf").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row: fingerprints link at ``radius`` or fewer differing bits.

    component_id is the smallest doc_id that can be reached, the row's own included. Null and
    empty texts have fingerprint zero and link like any other. A row without doc_id links
    nothing and has no component. Repeated rows and equal doc_ids are rows like any other.
    """
    prints = stored(fingerprints(docs, width), "prints")
    reps = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "reps")
    # one doc_id may stand on rows with different texts: those fingerprints meet in its node
    edges = stored(link_fingerprints(reps, radius), "links")
    same = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    many = prints.join(same.select("doc_id"), "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    components = stored(connected_components(edges.unionByName(many)), "components")
    final = stored(reps.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    drop_stored(reps, edges, components)
    out = prints.join(final, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
