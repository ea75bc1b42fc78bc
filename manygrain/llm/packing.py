"""Operator 3: best-fit packing planned on a histogram of lengths.

Best-fit decreasing runs over counts of lengths, not over documents: sequences with equal room
form a run, and a length takes the tightest runs that hold it. The plan depends on the sequence
length alone in size: each length consumes whole runs and splits at most one, adding at most
three, so there are at most 3 x capacity runs at any time. Documents then take planned slots by
their rank within their length.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored
from .tokens import Encoder, default_vocabulary


def plan_lengths(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, per sequence, first sequence, first offset), by first rank.

    Rank r of an entry goes to sequence ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    rooms: list[int] = []  # sorted rooms in use
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number)
    sequences, plan = 0, {}

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            heapq.heappush(runs[room], (first, number))

    for length in sorted(counts, reverse=True):
        left, rank, entries = counts[length], 0, []
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = heapq.heappop(runs[room])
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            per = room // length
            full, odd = divmod(min(left, per * number), per)
            entries.append((rank, per, first, capacity - room))
            put(room - per * length, first, full)
            if odd:
                put(room - odd * length, first + full, 1)
            put(room, first + full + bool(odd), number - full - bool(odd))
            rank += full * per + odd
            left -= full * per + odd
        plan[length] = np.array(entries, dtype=np.int64)
    return plan


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces (all columns of ``docs`` but text are left out)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``capacity`` tokens.

    Ranks within a length are dealt over buckets that follow its count, so a length that holds most
    rows is no single task. Collected is a count for each length and bucket.
    """
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "start")]
    rows, offsets, totals = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], order)
    base = {n: np.array(at, np.int64) for n, at in offsets.items()}
    shared = rows.sparkSession.sparkContext.broadcast((base, plan_lengths(totals, capacity)))  # offsets of the buckets, and the plan's entries

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, plan = shared.value
        for batch in batches:
            length, bucket, row = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_bucket", "_row"))
            rank, sequence, offset = np.zeros((3, len(row)), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rank[at] = base[int(n)][bucket[at]] + row[at]
                entry = plan[int(n)][np.searchsorted(plan[int(n)][:, 0], rank[at], side="right") - 1]
                k = rank[at] - entry[:, 0]
                sequence[at], offset[at] = entry[:, 2] + k // entry[:, 1], entry[:, 3] + k % entry[:, 1] * n
            keep = [batch.column(k) for k, name in enumerate(batch.schema.names) if name not in ("_bucket", "_row")]
            names = [name for name in batch.schema.names if name not in ("_bucket", "_row")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return rows.mapInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens; only longer ones are cut.

    Null and empty texts are the end id alone. Null and repeated doc_ids are rows like any other;
    their order among equals does not matter, as equal rows take equal slots. No rows: no pieces.
    """
    return place(stored(cut_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())
