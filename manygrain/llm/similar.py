"""Near-duplicate texts by five-word shingles and a similarity of 0.8 or more, for the pipeline's stage of operator 4.

At that similarity two 64-bit SimHash fingerprints differ in some ten bits, a radius at which
no triangle bound prunes (random fingerprints differ in 32 +- 4). So fingerprints link within
RADIUS bits through the vantage-point trees, and texts further apart meet by min-wise hashes
of the same shingles: TABLES tables of ROWS hashes miss a pair at the threshold with
probability (1 - 0.8^ROWS)^TABLES = 0.0006. Both only name candidates, as does the estimate from
HASHES hashes, which drops pairs under SKETCH. Texts that candidates connect are compared by all
their distinct shingles, so what links has a similarity of SIMILARITY or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, connected_components, drop_stored, stored
from .simhash import LOWER, fingerprint, link_fingerprints
from .vectors import link_buckets

WIDTH, SIMILARITY, RADIUS, ROWS, TABLES, HASHES = 5, 0.8, 2, 3, 10, 128
#: Estimates under SKETCH are no candidates (4 standard errors under SIMILARITY); texts compared at once; shingles of them, and different ones, at once.
SKETCH, CHUNK, SHINGLES, COLUMNS = 0.65, 256, 400_000, 4096
_RNG = np.random.default_rng(13)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's distinct shingles, one of the empty text where there is no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    grams = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.array([xxh64_intdigest(g, 42) for g in grams], np.uint64)


def signature(text: str | None, width: int = WIDTH) -> bytes:
    """The least of each of HASHES hashes over a text's distinct shingles (32 bits each)."""
    h = shingles(text, width)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 1024):
        some = (h[None, at : at + 1024] * _A[:, None] + _B[:, None]) >> np.uint64(32)
        least = np.minimum(least, some.min(axis=1).astype(np.uint32))
    return least.tobytes()


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            prints = np.array([fingerprint(t, WIDTH) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(prints), pa.array([signature(t) for t in texts], pa.binary())], names=["doc_id", "th", "fp", "vec"])

    return docs.select("text", "doc_id", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long, vec binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _load(batch.column(1)).astype(np.uint64)
            for t in range(TABLES):
                key = np.full(len(x), np.uint64((t + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
                for r in range(ROWS):
                    key = (key ^ x[:, t * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["bucket", "node"])

    return classes.select("node", "vec").mapInArrow(run, "bucket long, node long")


def _load(vec: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.uint32).reshape(-1, HASHES)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    same = np.zeros((len(x), len(y)), np.int16)
    for k in range(HASHES):
        same += x[:, None, k] == y[None, :, k]
    return same >= SKETCH * HASHES


def _shingled(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "vec"])

    return texts.select("node", "text").mapInArrow(run, "node long, vec binary")


def _sets(vec: pa.Array) -> np.ndarray:
    return vec.to_numpy(zero_copy_only=False)


def _parts(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of sets with SHINGLES shingles at most, or one set."""
    ends, held = [0], 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > SHINGLES:
            ends.append(k)
            held = 0
        held += n
    return list(zip(ends, [*ends[1:], len(size)]))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs at SIMILARITY or more; common shingles are counted by products of 0-1 matrices, some shingles at a time."""
    a, b = ([np.frombuffer(v, np.uint64) for v in some] for some in (x, y))
    m, n = (np.array([len(s) for s in some]) for some in (a, b))
    out = np.zeros((len(a), len(b)), bool)
    for a0, a1 in _parts(m):
        for b0, b1 in _parts(n):
            common = _common(a[a0:a1], b[b0:b1])
            out[a0:a1, b0:b1] = common >= SIMILARITY * (m[a0:a1, None] + n[None, b0:b1] - common) - 1e-6  # counts are whole numbers
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    sets = [*a, *b]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code)
    code, row = code[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    common = np.zeros((len(a), len(b)))
    for at in range(0, int(code[-1]) + 1, COLUMNS):
        first, last = np.searchsorted(code, (at, at + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[first:last], code[first:last] - at] = 1
        common += held[: len(a)] @ held[len(a) :].T
    return common


def _verified(docs: DataFrame, classes: DataFrame, maybe: DataFrame) -> DataFrame:
    """Edges that connect the classes within a component of ``maybe`` whose texts are at SIMILARITY or more."""
    members = stored(classes.join(maybe, "node").select("node", "doc_id", "th", F.col("component").alias("bucket")), "members")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(beside(members), ["doc_id", "th"])
    sets = stored(_shingled(texts), "shingles")
    edges = link_buckets(members.select("bucket", "node"), sets, _sets, _near, CHUNK)
    drop_stored(members, sets)
    return edges


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which no near duplicate with a smaller doc_id exists; one of equal rows.

    Rows without doc_id can't be told apart and all stay. Texts without a word are near duplicates
    of each other. Rows with equal doc_id but different texts link: they stay or go together.
    """
    signed, spare = stored(_signed(docs), "signed"), []

    def kept(df: DataFrame, what: str) -> DataFrame:
        spare.append(stored(df, what))
        return spare[-1]

    known = signed.where("doc_id is not null")
    classes = known.groupBy("fp", "vec").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    classes = kept(classes.select("fp", "vec", F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.th"), "classes")
    reps = kept(classes.groupBy("fp").agg(F.min("node").alias("node")), "reps")
    equal = classes.join(reps.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    banded = kept(_banded(classes), "banded")
    maybe = link_fingerprints(reps, RADIUS).unionByName(equal).unionByName(link_buckets(banded, classes.select("node", "vec"), _load, _alike, CHUNK))
    linked = connected_components(maybe)
    edges = _verified(docs, classes, linked)
    rows = kept(known.join(classes.select("fp", "vec", "node"), ["fp", "vec"]).select("doc_id", "node").distinct(), "rows")
    shared = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("y")).where("b <> y").select("doc_id", "b")
    edges = edges.unionByName(rows.join(shared, "doc_id").select(F.col("node").alias("a"), "b"))
    components = connected_components(edges)
    rows = kept(rows.join(components, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")), "rows")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("least"))
    gone = stored(rows.join(least, "component").where("doc_id <> least").select(F.col("doc_id").alias("node")).distinct(), "gone")
    left = docs.join(beside(gone), docs["doc_id"] == gone["node"], "left_anti")
    again = signed.where("doc_id is not null").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("_id")).distinct()
    again = stored(again, "again")
    drop_stored(signed, linked, components, *spare)
    if again.isEmpty():
        return left
    return left.join(again, left["doc_id"] == again["_id"], "left_anti").unionByName(left.join(again, left["doc_id"] == again["_id"], "left_semi").dropDuplicates(["doc_id", "text"]))
