"""Operator 1: token ids in files of directly addressable codes.

A token id is cut into chunks of ``WIDTH`` bits, lowest first. Level 0 holds the lowest chunk
of every id; a bitmap beside it tells which ids go on in the next level, and a rank directory
(ones before every ``SPAN`` bits) gives an id's place there. ``fetch_token`` therefore reads any
single token from a few bytes, without decoding its block.

A file is a Parquet table with one row per segment: the container gives atomic, retried task
output on any store that Spark reaches. Nothing in it is compressed and each row is a row group
of its own, so a segment's codes lie at a known place of a file: ``Tokens`` finds it from the
file's footer and reads a token's few bytes there. A segment holds whole documents, closed at
``SEGMENT`` tokens or more; rows are ordered by (part, segment), and so by (doc_id, text).
"""

from __future__ import annotations

import io
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .tokens import Encoder, default_vocabulary

WIDTH, SPAN, SEGMENT = 8, 512, 1 << 20
#: Pieces of a generation that a worker remembers.
PIECES = 450_000
MAGIC = b"DAC1"
SEGMENTS = "part int, segment int, n_tokens long, n_docs int, payload binary"


def pack_codes(ids: np.ndarray) -> bytes:
    """Levels of chunks, each with a continuation bitmap and a rank directory."""
    ids, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        rest = ids >> np.uint32(WIDTH)
        on = rest > 0
        bits = np.packbits(on, bitorder="little")
        full = np.pad(bits, (0, -len(bits) % (SPAN // 8))).view(np.uint64)
        ones = np.bitwise_count(full).reshape(-1, SPAN // 64).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(ones)))[:-1].astype("<u8") if len(on) else np.zeros(0, "<u8")
        levels.append((len(ids), ids.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not on.any():
            break
        ids = rest[on]
    head, at = [], 8 + 32 * len(levels)
    for n, *parts in levels:
        places = []
        for p in parts:
            places.append(at)
            at += len(p)
        head.append(struct.pack("<4Q", n, *places))
    return b"".join([MAGIC, struct.pack("<I", len(levels)), *head, *[p for _, *parts in levels for p in parts]])


def _levels(payload) -> list[tuple[int, int, int, int]]:
    if bytes(payload[:4]) != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    return [struct.unpack_from("<4Q", payload, 8 + 32 * k) for k in range(struct.unpack_from("<I", payload, 4)[0])]


def fetch_token(read: Callable[[int, int], bytes], i: int) -> int:
    """The i-th token by ``read(place, bytes)``: one chunk, one bit, one directory entry and under SPAN bits per level."""
    value = 0
    levels = _levels(read(0, 8 + 32 * struct.unpack("<I", read(4, 4))[0]))
    if not 0 <= i < levels[0][0]:
        raise IndexError(i)
    for k, (_, chunks, bits, ranks) in enumerate(levels):
        value |= read(chunks + i, 1)[0] << (WIDTH * k)
        block = i // SPAN
        some = read(bits + block * SPAN // 8, (i >> 3) - block * SPAN // 8 + 1)
        if not some[-1] >> (i & 7) & 1:
            break
        before = int.from_bytes(some[:-1], "little").bit_count() + (some[-1] & ((1 << (i & 7)) - 1)).bit_count()
        i = struct.unpack("<Q", read(ranks + 8 * block, 8))[0] + before
    return value


def token_at(payload, i: int) -> int:
    """The i-th token of codes in memory."""
    view = memoryview(payload)
    return fetch_token(lambda at, n: bytes(view[at : at + n]), i)


def unpack_codes(payload) -> np.ndarray:
    """All tokens as uint32."""
    view, levels = memoryview(payload), _levels(memoryview(payload))
    out, where = np.zeros(levels[0][0], "<u4"), None
    chunk_of = out.view(np.uint8).reshape(-1, 4)
    for k, (n, chunks, bits, _) in enumerate(levels):
        values = np.frombuffer(view, np.uint8, n, chunks)
        if where is None:
            chunk_of[:, k] = values
        else:
            chunk_of[where, k] = values
        if k + 1 < len(levels):
            on = np.unpackbits(np.frombuffer(view, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little").view(bool)
            where = np.flatnonzero(on) if where is None else where[on]
    return out


def _payload(doc_ids: list, lengths: list, ids: np.ndarray) -> bytes:
    """Document ids (with a null mask), lengths, codes."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return struct.pack("<Q", len(doc_ids)) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u8").tobytes() + pack_codes(ids)


def read_payload(payload) -> tuple[list, np.ndarray, memoryview]:
    """doc_ids, lengths and the codes of a segment."""
    view = memoryview(payload)
    n = struct.unpack_from("<Q", view)[0]
    known = np.frombuffer(view, np.uint8, n, 8 + 8 * n)
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(view, "<i8", n, 8), known)]
    return doc_ids, np.frombuffer(view, "<u8", n, 8 + 9 * n).astype(np.int64), view[8 + 17 * n :]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 1, segment: int = SEGMENT, path: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write segments; returns the segment table.

    ``path`` names the folder of the files, which ``Tokens`` reads; without it they go when the program ends.

    Rows are ordered by (doc_id, text): a null doc_id comes first, equal doc_ids by their text,
    repeated rows each count. A null or empty text is the end id alone. A text of any length
    stays whole, so a segment exceeds ``segment`` by one document at most. No rows: no segments.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("_h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").drop("_h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, number = TaskContext.get().partitionId(), Encoder.of(vocabulary, PIECES), 0
        doc_ids, lengths, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            one = [part], [number], [total], [len(doc_ids)], [_payload(doc_ids, lengths, np.concatenate(held))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["part", "segment", "n_tokens", "n_docs", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(end_id))
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                held.append(ids)
                total += len(ids)
                if total >= segment:
                    yield close()
                    doc_ids, lengths, held, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    # one row group a row, and payloads as they are
    return stored(ordered.mapInArrow(encode, SEGMENTS), "tokens", path, **{"compression": "none", "parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"})


def segment_offsets(segments: DataFrame) -> DataFrame:
    """part, segment, first: the number of tokens in all segments before; payloads aren't read.

    Sums per part come first, so the one window over all rows sees a row per written file.
    """
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    offsets = segments.select("part", "segment", "n_tokens").withColumn("_within", within)
    return offsets.join(parts, "part").select("part", "segment", (F.col("_before") + F.col("_within")).alias("first"))


def read_digests(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    names = ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc_ids, lengths, codes = read_payload(payload.as_buffer())
                ids = unpack_codes(codes)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths)]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = ([part] * len(sums), [number] * len(sums), doc_ids, ends - lengths, lengths, sums)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    read = segments.select("part", "segment", "payload").mapInArrow(decode, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read.join(segment_offsets(segments), ["part", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


class _Remote(io.RawIOBase):
    """A file of any store that Spark reaches, read from the driver; ``fetched`` counts its bytes."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.stream, self.size, self.at, self.fetched = files.open(place), files.getFileStatus(place).getLen(), 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.size - self.at if n is None or n < 0 else max(0, min(n, self.size - self.at))
        self.stream.seek(self.at)
        out = bytes(self.stream.readNBytes(n))
        self.at, self.fetched = self.at + n, self.fetched + n
        return out

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


class Tokens:
    """Random access to written token files: what is read for a token is some bytes of its segment.

    Built from the segments' numbers (a row for each SEGMENT tokens), which stay in Spark; a look-up is a
    filter on them. A segment's place and its documents are remembered for ``RECENT`` segments.
    """

    RECENT = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        segments = spark.read.parquet(path).select("part", "segment", "n_tokens", "n_docs", F.col("_metadata.file_path").alias("file"))
        self.index = segments.join(segment_offsets(segments), ["part", "segment"])
        self.held: OrderedDict[tuple[str, int], tuple[_Remote, int]] = OrderedDict()

    def _segment(self, file: str, number: int) -> tuple[_Remote, int]:
        """The open file, and where the payload starts in it."""
        import pyarrow.parquet as pq

        if (file, number) not in self.held:
            remote = _Remote(self.spark, file)
            group = pq.read_metadata(pa.PythonFile(remote, "r")).row_group(number)
            column = next(group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema == "payload")
            if column.compression != "UNCOMPRESSED" or group.num_rows != 1:
                raise ValueError(f"{file}: not written by write_tokens")
            # the chunk is one page: its header, four bytes of length, the payload
            start, size = column.data_page_offset, column.total_compressed_size
            head = self._bytes(remote, start, min(size, 1 << 14))
            ends = [k for k in range(4, len(head) - 7) if struct.unpack_from("<I", head, k - 4)[0] == size - k]
            at = next(k for k in ends if self._bytes(remote, start + k + 8 + 17 * struct.unpack_from("<Q", head, k)[0], 4) == MAGIC)
            self.held[file, number] = remote, start + at
            if len(self.held) > self.RECENT:
                self.held.popitem(last=False)[1][0].close()
        self.held.move_to_end((file, number))
        return self.held[file, number]

    @staticmethod
    def _bytes(remote: _Remote, at: int, n: int) -> bytes:
        remote.seek(at)
        return remote.read(n)

    def _token(self, file: str, number: int, i: int) -> int:
        remote, start = self._segment(file, number)
        n = struct.unpack("<Q", self._bytes(remote, start, 8))[0]
        codes = start + 8 + 17 * n
        return fetch_token(lambda at, size: self._bytes(remote, codes + at, size), i)

    def at(self, i: int) -> int:
        """The i-th token of all."""
        found = self.index.where((F.col("first") <= i) & (F.col("first") + F.col("n_tokens") > i)).select("file", "segment", "first").first()
        if found is None:
            raise IndexError(i)
        return self._token(found[0], found[1], i - found[2])

    def of(self, documents: DataFrame, doc_id: int, i: int) -> int:
        """The i-th token of a document; documents: doc_id, start, n_tokens, as ``read_digests`` gives them."""
        found = documents.where(F.col("doc_id") == doc_id).select("start", "n_tokens").first()
        if found is None:
            raise KeyError(doc_id)
        if not 0 <= i < found[1]:
            raise IndexError(i)
        return self.at(found[0] + i)

    def close(self) -> None:
        for remote, _ in self.held.values():
            remote.close()
        self.held.clear()


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read_digests(write_tokens(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1))
