"""Every registered query of the subpackage over whole tables: against its SQL in DuckDB, or against the contract's wording worked out in plain Python."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from manygrain.llm.queries import ORACLES, QUERIES
from manygrain.llm.tokens import Encoder, default_vocabulary

from .test_operators import brute_base, brute_components, brute_repeats

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Encoder.of(default_vocabulary()).tokenizer
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def plain(rows):
    one = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return Counter(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_op1(spark, ids):
    got = QUERIES["op1_token_files"](spark, DATA).collect()
    at, want = 0, []
    for d in sorted(ids):
        want.append((d, at, len(ids[d]) + 1, crc([*ids[d], 1])))
        at += len(ids[d]) + 1
    assert sorted(tuple(r)[:4] for r in got) == want


def test_op3(spark, ids):
    got = QUERIES["op3_packing"](spark, DATA).collect()
    want = Counter()
    for d, own in ids.items():
        own = [*own, 0]
        for k, at in enumerate(range(0, len(own), 2048)):
            piece = own[at : at + 2048]
            want[(d, k, at, len(piece), crc(piece))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    # as few as best fit over the same pieces, one by one, and near the bound of the sizes
    rooms = []
    for n in sorted((r.length for r in got), reverse=True):
        fits = [(x, k) for k, x in enumerate(rooms) if x >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(2048 - n)
    assert len(sequences) <= len(rooms) + 1 and len(sequences) <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_op4(spark, texts):
    from xxhash import xxh64_intdigest

    def fingerprint(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    order = sorted(texts)
    prints = [fingerprint(texts[d]) for d in order]
    root = brute_components(len(order), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = QUERIES["op4_simhash"](spark, DATA).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(d, f"{p:016x}", order[r]) for d, p, r in zip(order, prints, root)]


def test_op5(spark, texts):
    got = QUERIES["op5_sharding"](spark, DATA).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts.items())
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None and 0 <= r.shard < 24 for r in got)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    where = defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    linked = [t for t, n in Counter(texts.values()).items() if n > 1]
    assert sum(len(where[t]) - 1 for t in linked) == 0  # all groups fit a shard here: no link is cut


def test_op6(spark, texts):
    for r in QUERIES["op6_private"](spark, DATA).collect():
        base = brute_base(texts[r.doc_id])
        written = [f"{kind}:{s}:{e}" for s, e, kind in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[2] == k for b in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and not Counter(written) - Counter(r.spans.split(","))


def test_op8(spark, texts):
    data = [(d, t.encode()) for d, t in sorted(texts.items())]
    want = {d: (n, hashlib.sha256(kept).hexdigest()) for d, n, kept in brute_repeats(data)}
    got = QUERIES["op8_repeats"](spark, DATA).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want and all(r.n_bytes == len(texts[r.doc_id].encode()) and (r.n_spans > 0) == (r.n_removed > 0) for r in got)


def test_pipeline_over_tables(spark, texts):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA).collect()
    assert got and {r.doc_id for r in got} <= set(texts) and all(1 <= r.length <= 2048 for r in got)
