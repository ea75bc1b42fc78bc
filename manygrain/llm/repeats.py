"""Operator 8: repeated byte strings, by longest previous factors in suffix order.

A match of LENGTH bytes is all that decides, so suffixes are compared to that depth. Suffixes that
agree to it share the smallest hash among their GRAM-byte substrings and its place, so each
suffix goes to the group of that hash, and suffixes next to each other in a text with the same
hash travel as one stretch. Stretches whose hash is found once hold no match. Equal stretches are
merged and counted. Of the rest, groups are sorted into suffix order, with the common prefixes of
neighbours; the previous and the next smaller text position in that order give each suffix its
longest previous factor. A factor of LENGTH bytes is an earlier match, a neighbour that agrees to
the full depth any match.

Groups of more than GROUP stretches are divided first, as in a string quicksort: the group's earliest
stretch is the pivot, whose strings settle those that equal them; what is left of a stretch differs
from the pivot at a known byte to the left or to the right of the hashed substring, and goes on in
the group of that byte. A stretch makes two pieces at most, which never overlap. This repeats until
every group fits a task, whatever its size was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

LENGTH, GRAM, GROUP = 200, 32, 256
#: Bytes of a text that are hashed at a time (positions have 24 bits); stretches sorted at once, in whole groups.
CHUNK, BATCH = 1 << 21, 128
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: What tells a stretch's place apart: lo is its first start, n counts its starts, o is the hashed substring's place after lo.
_PLACE = ("doc_id", "th", "lo", "n", "o")


def stretches(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first start, number of starts, place of the hashed substring after the first start) of a text's stretches."""
    span = length - GRAM + 1
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        some = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - at), at)
        g = some.astype(np.uint64)
        for k, m in enumerate(_M):
            g = g[: -(1 << k)] * m + g[1 << k :]
        g ^= g >> np.uint64(33)
        g *= np.uint64(0xFF51AFD7ED558CCD)
        g ^= g >> np.uint64(29)
        low = (g & ~np.uint64((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        yield g[place[first]].view(np.int64), first + at, np.diff(np.append(first, len(place))), place[first] - first


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    names = ["h", "rh", "doc_id", "th", "lo", "n", "o"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            held, size = [], 0

            def flush() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*held)]
                ids = pa.array([d for d, n in held_ids for _ in range(n)], pa.int64())
                h, rh, th, lo, n, o = columns
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(rh), ids, pa.array(th), pa.array(lo, pa.int32()), pa.array(n, pa.int16()), pa.array(o, pa.int16())], names=names)

            held_ids: list[tuple] = []
            for doc_id, text, th in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode()
                for h, lo, n, o in stretches(data, length):
                    view = memoryview(data)
                    rh = np.array([xxh3_64_intdigest(view[a:b], s) for a, b, s in zip(lo.tolist(), (lo + n + length - 1).tolist(), o.tolist())], np.uint64).view(np.int64)
                    held.append((h, rh, np.full(len(h), th, np.int64), lo, n, o))
                    held_ids.append((doc_id, len(h)))
                    size += len(h)
                if size > 200_000:
                    yield flush()
                    held, held_ids, size = [], [], 0
            if held:
                yield flush()

    return texts.select("doc_id", "text", "th").mapInArrow(run, "h long, rh long, doc_id long, th long, lo int, n short, o short")


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of fixed-depth suffixes (rows of bytes) and how many bytes each shares with the one before."""
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel(), kind="stable")
    sorted_, common = windows[order], np.zeros(len(order), np.int64)
    differ = sorted_[1:] != sorted_[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), windows.shape[1])
    return order, common


def previous_factors(position: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order; those under ``least`` are given as 0.

    position: the suffixes' places in the text; common: bytes shared with the one before. On either
    side, the nearest suffix with a smaller position shares more with a suffix than any farther one,
    so the longer of the two is its longest previous factor.
    """

    def nearest_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
        near, shared = np.arange(len(position)) - 1, common.copy()
        while len(at := np.flatnonzero((shared >= least) & (position[near] >= position))):
            shared[at], near[at] = np.minimum(shared[at], shared[near[at]]), near[near[at]]
        return np.where((near >= 0) & (shared >= least), shared, 0)

    after = np.append(common[1:], 0)[::-1]
    return np.maximum(nearest_smaller(position, common), nearest_smaller(position[::-1], after)[::-1])


def _words(length: int) -> int:
    """Words of 64 bits for a mask over the places that the hashed substring can have in a string."""
    return (length - GRAM) // 64 + 1


def _mask_names(length: int) -> list[str]:
    return [f"{kind}{w}" for kind in ("other", "earlier") for w in range(_words(length))]


def _mask_kinds(length: int) -> str:
    return ", ".join(f"{x} long" for x in _mask_names(length))


def _packed(flags: np.ndarray, place: np.ndarray, first: np.ndarray, words: int) -> list[np.ndarray]:
    """Bits at ``place``, gathered from each of ``first`` on."""
    bit = np.where(flags, np.uint64(1) << (place & 63).astype(np.uint64), np.uint64(0))
    return [np.bitwise_or.reduceat(np.where(place >> 6 == w, bit, np.uint64(0)), first).view(np.int64) for w in range(words)]


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by ``key``; a group is not cut, so it bounds a table with BATCH."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH):
            held.append(batch.slice(a, BATCH))
            if sum(x.num_rows for x in held) < BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            at = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if at:
                yield table.slice(0, at)
            held = table.slice(at).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def matches(table: pa.Table, length: int) -> list[np.ndarray]:
    """Masks (other, earlier) of each stretch of whole groups g, by the hashed substring's place in the string."""
    g, lo, n, o, th = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "lo", "n", "o", "th"))
    known, doc = table.column("doc_id").is_valid().to_numpy(), table.column("doc_id").fill_null(0).to_numpy()
    by_text = np.lexsort((th, doc, known))
    change = np.zeros(len(g), np.int64)
    for c in (th, doc, known.astype(np.int64)):
        change[1:] |= c[by_text][1:] != c[by_text][:-1]
    rank = np.empty(len(g), np.int64)
    rank[by_text] = np.cumsum(change)
    data = table.column("bytes").combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1 + data.offset)[data.offset :].astype(np.int64)
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - first[row]
    buffer = np.frombuffer(data.buffers()[2], np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length)[ends[row] + step]
    number = (np.cumsum(np.append(0, g[1:] != g[:-1]))[row]).astype(">u4").view(np.uint8).reshape(-1, 4)
    order, common = suffix_order(np.concatenate([number, windows], axis=1))  # the group's number comes before its strings
    common = np.maximum(common - 4, 0)
    factors = previous_factors(((rank[row] << 32) + lo[row] + step)[order], common, length)
    other, earlier = np.zeros(len(row), bool), np.zeros(len(row), bool)
    other[order] = (common == length) | (np.append(common[1:], 0) == length)
    earlier[order] = factors == length
    place = o[row] - step
    return [*_packed(other, place, first, _words(length)), *_packed(earlier, place, first, _words(length))]


def _match_groups(pieces: DataFrame, length: int) -> DataFrame:
    """h, rh and masks, of the pieces in groups that fit a task."""
    names = _mask_names(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "g"):
            masks = matches(table, length)
            yield from pa.table([table.column("h"), table.column("rh"), *map(pa.array, masks)], names=["h", "rh", *names]).to_batches()

    rows = pieces.select("g", "h", "rh", "doc_id", "th", "lo", "n", "o", "bytes").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, f"h long, rh long, {_mask_kinds(length)}")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Bytes that a and b have in common from their start."""
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    return int(differ.argmax()) if differ.any() else m


def against_pivot(data: np.ndarray, n: int, o: int, pivot: np.ndarray, pivot_n: int, pivot_o: int) -> tuple[int, int]:
    """How far a stretch and its pivot agree to the left and to the right of the hashed substring, as far as both reach; (-1, 0) if not there."""
    if (data[o : o + GRAM] != pivot[pivot_o : pivot_o + GRAM]).any():
        return -1, 0
    return _shared(data[:o][::-1], pivot[:pivot_o][::-1]), _shared(data[o + GRAM :], pivot[pivot_o + GRAM :])


def _divide(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(masks of what the pivots settle, smaller pieces in their new groups g) of the pieces of large groups."""
    words, span = _words(length), length - GRAM
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th", (F.col("lo") + F.col("o")).alias("at"), "rh", "h", "bytes", "n", "o")
    pivots = pieces.groupBy("g").agg(F.min(place).alias("p")).select(F.col("g"), F.col("p.h").alias("ph"), F.col("p.rh").alias("prh"), F.col("p.bytes").alias("pbytes"), F.col("p.n").alias("pn"), F.col("p.o").alias("po"))
    both = pieces.join(stored(pivots, "pivots"), "g")
    names = ["g", "h", "rh", "ph", "prh", "doc_id", "th", "lo", "n", "o", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, o, pn, po = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "o", "pn", "po"))
            data, pivots = (batch.column(batch.schema.get_field_index(c)) for c in ("bytes", "pbytes"))
            out = []
            for k in range(batch.num_rows):
                x = np.frombuffer(data[k].as_buffer(), np.uint8)
                left, right = against_pivot(x, n[k], o[k], np.frombuffer(pivots[k].as_buffer(), np.uint8), pn[k], po[k])
                out.append((left, right, int(x[o[k] - left - 1]) if 0 <= left < o[k] else -1, int(x[o[k] + GRAM + right]) if o[k] + GRAM + right < len(x) else -1))
            left, right, before, after = np.array(out, np.int64).reshape(-1, 4).T
            # by the hashed substring's place: equal to the pivot's string, beyond what agrees on the left, else on the right
            low, high = np.maximum(o - n + 1, span - right), np.minimum(o, left)
            masks = [np.zeros(len(o), np.uint64) for _ in range(words)]
            for d in range(span + 1):
                masks[d >> 6] |= np.where((low <= d) & (d <= high), np.uint64(1) << np.uint64(d & 63), np.uint64(0))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            sides = [pa.array(c.astype(np.int32)) for c in (left, right, before, after)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(m.view(np.int64)) for m in masks], *sides], names=[*names, *_mask_names(length)[:words], "left", "right", "before", "after"])

    kinds = "g long, h long, rh long, ph long, prh long, doc_id long, th long, lo int, n short, o short, bytes binary, "
    found = both.mapInArrow(run, kinds + ", ".join(f"{x} long" for x in _mask_names(length)[:words]) + ", left int, right int, before int, after int")
    found = stored(found, "divided")
    own = (F.col("h") == F.col("ph")) & (F.col("rh") == F.col("prh"))
    others = [x for x in _mask_names(length)[:words]]
    settled = found.where(~own).select("h", "rh", *others, *[F.col(x).alias(x.replace("other", "earlier")) for x in others])
    of_pivot = found.where(~own).groupBy("ph", "prh").agg(*[F.bit_or(x).alias(x) for x in others]).select(F.col("ph").alias("h"), F.col("prh").alias("rh"), *others, *[F.lit(0).cast("long").alias(x.replace("other", "earlier")) for x in others])

    def piece(low: Column, high: Column, side: str, agreed: str, byte: str) -> DataFrame:
        """Strings whose hashed substring has a place from ``low`` to ``high``."""
        skip, count = F.col("o") - high, high - low + 1
        rows = found.where(~own).where(count > 0)
        key = F.xxhash64("g", F.lit(side), agreed, byte)
        return rows.select(key.alias("g"), "h", "rh", "doc_id", "th", (F.col("lo") + skip).cast("int").alias("lo"), count.cast("short").alias("n"), high.cast("short").alias("o"),
                           F.substring("bytes", skip + 1, count + (length - 1)).alias("bytes"))

    lowest = F.col("o") - F.col("n") + 1
    on_left = piece(F.greatest(F.col("left") + 1, lowest), F.col("o"), "left", "left", "before")
    on_right = piece(lowest, F.least(F.col("left"), F.lit(span - 1) - F.col("right"), F.col("o")), "right", "right", "after")
    return settled.unionByName(of_pivot), on_left.unionByName(on_right)


def _masks(ranges: DataFrame, length: int) -> DataFrame:
    """h, rh and masks of distinct stretches (g, h, rh, place, bytes and k, the rows of its group)."""
    found, now = None, ranges
    while True:
        some = stored(_match_groups(now.where(F.col("k") <= GROUP), length), "matched")
        found = some if found is None else found.unionByName(some)
        large = now.where(F.col("k") > GROUP)
        if large.isEmpty():
            break
        settled, pieces = _divide(large, length)
        found, pieces = found.unionByName(stored(settled, "settled")), stored(pieces, "pieces")
        sizes = pieces.groupBy("g").agg(F.count("*").alias("k")).where("k > 1")
        now = stored(pieces.join(sizes, "g"), "ranges")
    return found.groupBy("h", "rh").agg(*[F.bit_or(x).alias(x) for x in _mask_names(length)])


def _where() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), *_PLACE)


def repeated_starts(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """doc_id, th, found: per text, an array of (lo, n, o, mask): starts of repeated strings of ``length`` bytes.

    Bit d of the mask (words of 64 bits) is the string that starts at lo + o - d. ``keep="none"``: every
    start whose string starts elsewhere too. ``keep="first"``: only those whose string starts
    earlier, in order of doc_id (null first), text hash and byte.
    """
    cut = stored(_cut(_texts(docs), length), "cut")
    twice = stored(cut.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "twice")
    held = stored(cut.join(twice, "h"), "held")
    drop_stored(cut, twice)
    kinds = stored(held.groupBy("h", "rh").agg(F.count("*").alias("c"), F.min(_where()).alias("at")), "kinds")
    groups = stored(kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "groups")
    mixed = kinds.join(groups, "h").select("h", "rh", "k", *[F.col(f"at.{x}").alias(x) for x in _PLACE])
    asked = mixed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "rh", "k", "lo", "n", "o")).alias("asked"))  # no more than the text has stretches
    asked = stored(asked.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), "asked")
    texts = _texts(docs)
    joined = texts.join(asked, texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["th"] == asked["_th"])).select("doc_id", "th", "text", "asked")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "rh", "k", "lo", "n", "o"]
        for batch in batches:
            for doc_id, th, text, asked in zip(*[batch.column(k) for k in range(4)]):
                data, want = text.as_py().encode(), asked.values.flatten()
                lo, n = want[3].to_numpy(), want[4].to_numpy()
                cutout = pa.array([data[a : a + m + length - 1] for a, m in zip(lo.tolist(), n.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*want, pa.array([doc_id.as_py()] * len(lo), pa.int64()), pa.array([th.as_py()] * len(lo), pa.int64()), cutout], names=[*names, "doc_id", "th", "bytes"])

    ranges = joined.mapInArrow(slices, "h long, rh long, k long, lo int, n short, o short, doc_id long, th long, bytes binary")
    ranges = stored(ranges.withColumn("g", F.col("h")), "ranges")
    masks = stored(_masks(ranges, length), "masks")
    drop_stored(ranges, asked, groups)
    verdict = stored(kinds.join(masks, ["h", "rh"], "left"), "verdict")
    drop_stored(kinds, masks)
    me = held.join(verdict, ["h", "rh"])
    everything, kind = (F.col("c") > 1, "other") if keep == "none" else (_where() != F.col("at"), "earlier")
    mask = F.array(*[F.when(everything, F.lit(-1)).otherwise(F.coalesce(f"{kind}{w}", F.lit(0))).cast("long") for w in range(_words(length))])
    me = me.select("doc_id", "th", F.struct("lo", "n", "o", mask.alias("mask")).alias("x")).where(F.exists("x.mask", lambda w: w != 0))
    return me.groupBy("doc_id", "th").agg(F.collect_list("x").alias("found"))  # no more than the text has stretches


def covered(n_bytes: int, lo: np.ndarray, n: np.ndarray, o: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which bytes the strings of marked starts cover; mask: one row of words for each stretch."""
    bits = np.unpackbits(np.ascontiguousarray(mask, "<i8").view(np.uint8), axis=1, bitorder="little")
    row, place = np.nonzero(bits)
    step = o[row] - place
    start = (lo[row] + step)[(step >= 0) & (step < n[row])]
    ends = np.bincount(start, minlength=n_bytes + 1) - np.bincount(start + length, minlength=n_bytes + 1)
    return np.cumsum(ends[:n_bytes]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every row.

    Texts are UTF-8 bytes, null is empty; texts shorter than ``length`` lose nothing. Equal texts
    lose everything with ``keep="none"``; with "first", the row with the smallest doc_id keeps its
    text (rows equal in doc_id and text count as one there).
    """
    found = stored(repeated_starts(docs, length, keep).withColumnsRenamed({"doc_id": "_id", "th": "_th"}), "found")
    texts = _texts(docs)
    joined = texts.join(found, texts["doc_id"].eqNullSafe(found["_id"]) & (texts["th"] == found["_th"]), "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, text, found in zip(*[batch.column(k).slice(a, 256) for k in range(3)]):
                    data = text.as_py().encode()
                    if found.is_valid:
                        lo, n, o, mask = found.values.flatten()
                        words = mask.flatten().to_numpy().reshape(len(lo), -1)
                        gone = covered(len(data), *[x.to_numpy().astype(np.int64) for x in (lo, n, o)], words, length)
                        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                        rows.append((doc_id.as_py(), len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
                    else:
                        rows.append((doc_id.as_py(), len(data), 0, 0, data))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = remove_repeats(table(spark, sf_dir, "documents"), LENGTH, "none")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
