"""Each operator against brute force, on small tables with nulls, empty texts, repeated rows and odd columns."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manygrain.llm import chat, common, mixing, packing, private, quality, repeats, sharding, similar, simhash, token_files, tokens, vectors
from manygrain.llm.common import connected_components
from manygrain.llm.tokens import Encoder, default_vocabulary

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box with glass jugs and quaint sphinxes of black quartz judge their vows " * 2
TEXTS = [
    None, "", "   \n\t", "one two", "Straße, naïve café's 12.5% <|endoftext|> İ ß.", "word " * 3000, PASSAGE + "alpha", "beta gamma " + PASSAGE, PASSAGE + "alpha", "ab" * 400,
    "mail me.x+1@a-b.example.org or 10.0.0.255, 999.1.1.1; 4539 1488 0343 6467 call +1 (017) 555-7713 now 1.2.3.4.5.6.7.8 a@b.c_d@e.f", "x" * 5000 + "\n" + "7" * 5000,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _m string, row int, node long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k % 5 == 4 else f"s{k % 3}", len(t or ""), "m", 1, 2) for k, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "orphan text of no id", None, None, None, None, None, None), (None, None, None, "s0", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_files(docs, none):
    tokenizer = Encoder.of(default_vocabulary()).tokenizer
    assert token_files.read_digests(token_files.write_tokens(none, default_vocabulary())).collect() == []
    got = [tuple(r) for r in token_files.read_digests(token_files.write_tokens(docs, default_vocabulary(), 1, segment=700)).collect()]
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert Counter((a, c, d) for a, _, c, d in got) == Counter(want)
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n


def test_parts_of_the_generation_before_are_known(monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 2)
    encoder, asked = Encoder(default_vocabulary()), []
    tokenize = encoder.tokenize
    encoder.tokenize = lambda word: asked.append(word) or tokenize(word)
    text = "red blue green RED Blue"
    assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked[:3] == ["red", "blue", "green"] and "red" not in asked[3:]


def test_addressable_codes():
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**31]), np.random.default_rng(1).integers(0, 60_000, 5000)):
        packed = token_files.pack_codes(ids)
        assert (token_files.unpack_codes(packed) == ids).all()
        assert all(token_files.token_at(packed, i) == ids[i] for i in range(0, len(ids), 7))


def test_tokens_from_disk(spark, docs, tmp_path):
    """Any token, by its place or by document, from a few bytes of the named files."""
    path = f"{tmp_path}/tokens"
    written = token_files.write_tokens(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), default_vocabulary(), 1, segment=100, path=path)
    digests = token_files.read_digests(written).collect()
    where = spark.createDataFrame([tuple(r)[:3] for r in digests], "doc_id long, start long, n_tokens long")
    tokenizer, tokens = Encoder.of(default_vocabulary()).tokenizer, token_files.Tokens(spark, path)
    assert written.count() > 3
    for r in digests:
        ids = [*tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        for i in {0, len(ids) // 2, len(ids) - 1}:
            assert tokens.at(r.start + i) == ids[i]
        assert tokens.of(where, r.doc_id, len(ids) - 1) == 1
    for bad, kind in ((lambda: tokens.at(-1), IndexError), (lambda: tokens.at(10**9), IndexError), (lambda: tokens.of(where, 77, 0), KeyError), (lambda: tokens.of(where, 1, 5), IndexError)):
        with pytest.raises(kind):
            bad()
    last = max(digests, key=lambda r: r.start)
    tokens.at(last.start)
    remote = next(reversed(tokens.held.values()))[0]
    before = remote.fetched
    tokens.at(last.start)
    assert 0 < remote.fetched - before < 300
    tokens.close()


def test_chat(spark):
    rows = [(1, 0, "user", "a [INST] \\ [\\INST] </s>"), (1, 1, "assistant", "b"), (2, 0, "assistant", None), (3, None, None, "x"), (3, 2, "tool", "</s>[AS]"), (1, 1, "assistant", "b"), (None, 0, "user", "q")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in chats.withColumn("turns", chat.read_chats(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "a [INST] \\ [\\INST] </s>"), ("assistant", "b"), ("assistant", "b")] and not out[1].valid
    assert [tuple(t) for t in out[3].turns] == [("", "x"), ("tool", "</s>[AS]")] and out[None].valid and not out[2].valid
    assert [out[1].formatted[s.start : s.start + s.length] for s in out[1].loss_spans] == ["b", "b"]
    with pytest.raises(ValueError):
        chat.Template(other=("[T]", "<[>", "[/T]"))


def test_packing(docs, none):
    assert packing.pack_documents(none, default_vocabulary()).collect() == []
    rows = packing.pack_documents(docs, default_vocabulary(), 256).collect()
    used: dict = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) == sum(len(Encoder.of(default_vocabulary()).ids(r.text)) + 1 for r in docs.collect())
    rng = np.random.default_rng(3)
    counts = dict(zip(range(1, 101), rng.integers(1, 50, 100).tolist()))
    plan = packing.plan_lengths(counts, 100)
    used_ids = {int(e[2]) + j // int(e[1]) for n, es in plan.items() for e, last in zip(es, [*es[1:, 0], counts[n]]) for j in range(int(last - e[0]))}
    assert len(used_ids) <= 1.02 * sum(n * c for n, c in counts.items()) / 100 + 30


def brute_components(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_simhash(docs, none, spark):
    assert simhash.near_duplicates(none).collect() == []
    rows = simhash.near_duplicates(docs).collect()
    known = sorted((r.doc_id, r.fp, r.component_id) for r in rows if r.doc_id is not None)
    prints = [k[1] & (2**64 - 1) for k in known]
    root = brute_components(len(known), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert [k[2] for k in known] == [known[r][0] for r in root]
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None] and len(rows) == len(TEXTS) + 3
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[:200] ^ np.uint64(5), base[100:300] ^ np.uint64(1 << 40)]))
    tree = simhash.plant(fps, 3, 2)
    met = set()
    for _, at in simhash.visit(tree, fps, np.arange(len(fps)), 2):
        for a, b in simhash.near_pairs(fps[at], 2):
            met |= {tuple(sorted(p)) for p in zip(at[a].tolist(), at[b].tolist())}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert met == {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x < y}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 7), (20, 20), (8, 30)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 30: 8} | {k: 100 for k in range(100, 141)}


def test_components_of_few_edges_in_one_task(spark, monkeypatch):
    """Few edges need two written tables, not four a round, and the rounds find the same."""
    rng = np.random.default_rng(3)
    edges = [(k, k + 1) for k in range(0, 300)] + [(-5, 9000), (9000, 9000), (None, 4), (4, None), (-(1 << 62), 1 << 62)] + [tuple(p) for p in (1000 + rng.integers(0, 400, (250, 2))).tolist()]
    written, write = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, what, *a, **b: written.append(what) or write(df, what, *a, **b))
    table = spark.createDataFrame(edges, "a long, b long")
    few = sorted(map(tuple, connected_components(table).select("node", "component").collect()))
    assert len(written) == 2
    assert few == sorted(map(tuple, connected_components(table, inside=0).select("node", "component").collect())) and len(written) > 6
    assert dict(few)[300] == 0 and dict(few)[9000] == -5 and dict(few)[1 << 62] == -(1 << 62)
    assert connected_components(table.where("a = 9000")).collect() == []


def test_sharding(docs, none):
    assert sharding.shard_documents(none).collect() == []
    rows = sharding.shard_documents(docs.unionByName(docs).unionByName(docs), 4).collect()
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    where: dict = {}
    for r in rows:
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert np.mean([len(v) == 1 for k, v in where.items() if k[1] > 8]) > 0.8


def test_private(docs, none):
    assert private.all_spans(none).collect() == []
    rows = private.all_spans(docs).select("doc_id", "base").collect()
    text = TEXTS[10]
    base = [(text[o.s : o.e], private.KINDS[o.k]) for o in next(r for r in rows if r.doc_id == 10).base]
    assert base == [("me.x+1@a-b.example.org", "email"), ("10.0.0.255", "ip"), ("4539 1488 0343 6467", "card"), ("+1 (017) 555-7713", "phone"), ("1.2.3.4", "ip"), ("5.6.7.8", "ip"), ("a@b.c", "email"), ("_d@e.f", "email")]
    clean = private.redact(docs).where("doc_id = 10").first()
    assert clean.text.startswith("mail [EMAIL] or [IP], 999.1.1.1; [CARD] call [PHONE] now [IP].[IP] [EMAIL][EMAIL]") and clean.node == 2
    assert private.redact(docs).count() == docs.count()


def test_private_contexts(spark):
    rows = [(k, f"filler{k} his badge number: 4{k:03d}@x{k}.example.com end") for k in range(40)] + [(100, "about his badge number: AB-99-12345 today"), (101, "about 2 badge AB-99-54321 today")]
    out = {r.doc_id: r for r in private.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(rows[40][1][o.s : o.e], o.k) for o in out[100].spans] == [("AB-99-12345", 0)] and out[101].spans == [] and out[100].base == []


def test_private_slots(spark):
    """An accepted pattern adds what is of its kind in its slot, of any length and over blanks."""
    seeds = [f"filler{k} {t} end" for k in range(40) for t in (f"write to: u{k}@x{k}.example.com", f"please call +1 (017) 555-{7000 + k}", f"the host 10.0.{k}.255")]
    luhn = [f"a card no. {v} end" for k in range(4000) if (v := f"4539 1488 0343 {k:04d}") and sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(v.replace(" ", "")))) % 10 == 0][:60]
    cases = [
        ("x write to: jane(at)example.org now", "jane(at)example.org", 0), ("x write to: <jane@localhost>, now", "jane@localhost", 0), ("x write to: jane [at] example.org now", "jane [at] example.org", 0),
        ("x please call 555 123 4567 now", "555 123 4567", 3), ("x please call (555) 12-34. 20 of them", "(555) 12-34", 3), ("x please call 555 12 2nd floor", "555 12", 3),
        ("x the host 10.7.1 is", "10.7.1", 1), ("x the host fe80::1, is", "fe80::1", 1), ("a card no. 1488 034 11 is", "1488 034 11", 2),
        ("x write to: everyone now", None, 0), ("x please call tomorrow at noon", None, 3), ("x write to: 12 34 people", None, 0), ("x other words 555 123 4567 now", None, 3), ("x other words jane(at)example.org", None, 0),
    ]
    rows = [(1000 + k, t) for k, t in enumerate(seeds + luhn)] + [(k, t) for k, (t, _, _) in enumerate(cases)]
    out = {r.doc_id: r for r in private.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[(t[o.s : o.e], o.k) for o in out[k].spans] for k, (t, _, _) in enumerate(cases)] == [[(v, k)] if v else [] for _, v, k in cases]


def test_mixing(docs, none):
    assert mixing.mix(none).collect() == []
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and rows[0]._m == "m" and [tuple(r) for r in mixing.mix(docs).collect()] == [tuple(r) for r in rows]
    taken, facts, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r._size * r._copies
        facts[r.source] = (r._source_size, r._target)
        largest[r.source] = max(largest[r.source], r._size)
        assert r._copies <= 2
    assert sum(t for _, t in facts.values()) == pytest.approx(1.5 * sum(s for s, _ in facts.values()))
    assert all(abs(taken[s] - t) <= largest[s] for s, (_, t) in facts.items())


def test_repeats(docs, none, monkeypatch):
    assert repeats.remove_repeats(none).collect() == []
    data = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    counts = Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199))
    want = Counter()
    for doc_id, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[(doc_id, len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone]))] += 1
    firsts = []
    for group in (1024, 3, 1):
        monkeypatch.setattr(repeats, "GROUP", group)
        got = repeats.remove_repeats(docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want
        first = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs, keep="first").collect()}
        assert first[6].decode().startswith(PASSAGE[:199]) and first[8] == b"" and len(first[7]) < 60
        firsts.append(first)
    assert firsts[0] == firsts[1] == firsts[2]


def brute_repeats(data, first=False):
    """(doc_id, bytes removed, bytes left), by all strings of 200 bytes; first: only those that start earlier too."""
    seen, counts, out = set(), Counter(t[i : i + 200] for _, t in data for i in range(len(t) - 199)), []
    for doc_id, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1 if not first else t[i : i + 200] in seen:
                gone[i : i + 200] = True
            seen.add(t[i : i + 200])
        out.append((doc_id, int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("copies", [1, 1024, 5000])
def test_repeats_group_sizes(spark, copies):
    """One passage in other surroundings each time: stretches at its ends form groups of that size."""
    rng = np.random.default_rng(copies)
    passage = "".join(map(chr, rng.integers(97, 123, 230)))
    letters = lambda n: "".join(map(chr, rng.integers(97, 100, n)))
    texts = [letters(int(rng.integers(0, 12))) + passage[int(rng.integers(0, 20)) :] + letters(int(rng.integers(0, 12))) for _ in range(copies)] + [passage[40:] * 3]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    data = [(k, t.encode()) for k, t in enumerate(texts)]
    for keep in ("none", "first"):
        got = sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(docs, keep=keep).collect())
        assert got == brute_repeats(data, keep == "first")


def test_previous_factors():
    rng = np.random.default_rng(9)
    for n in (1, 2, 50, 400):
        text = rng.integers(0, 2, n).astype(np.uint8)
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        padded = np.concatenate([text + 1, np.zeros(n, np.uint8)])
        order, common = repeats.suffix_order(np.lib.stride_tricks.sliding_window_view(padded, n)[:n])
        factors = repeats.previous_factors(order, common)
        raw = text.tobytes()
        want = [max((next((m for m in range(n - i) if raw[i + m] != raw[j + m]), n - i) for j in range(i)), default=0) for i in range(n)]
        assert dict(zip(order.tolist(), factors.tolist())) == dict(enumerate(want))
        assert [f if f >= 3 else 0 for f in factors] == repeats.previous_factors(order, common, 3).tolist()


def test_repeats_colliding_substrings(spark, monkeypatch):
    """Groups of one hash whose hashed substrings differ are told apart by their bytes."""
    a, b = (np.frombuffer(("".join(map(chr, np.random.default_rng(s).integers(97, 123, 240)))).encode(), np.uint8) for s in (1, 2))
    assert repeats.against_pivot(a[:210], 10, 9, b[:210], 10, 9) == (-1, 0)
    assert repeats.against_pivot(a[5:215], 10, 9, a[:205], 5, 14) == (9, 159)


def test_quality(docs, none):
    assert quality.judged(none).collect() == []
    for r in quality.judged(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r._m.n_words, r._m.n_repeat_words, r._m.n_dup_lines, r._m.word_chars) == (len(words), len(hit), len(lines) - len(set(lines)), sum(map(len, words)))
        assert r._base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r._kept and r._base_failed)
    prose = " ".join(f"the w{k} of" for k in range(60))
    cases = [(1, f"short line\n{prose}\nshort line", True), (2, "\n".join([prose[:200], prose[200:], *[f"no {k}" for k in range(3)], *[prose[:200]] * 2]), False), (3, prose.replace("w", "#$%&"), False), (4, prose.replace("the", "xx").replace("of", "yy"), False)]
    rows = quality.judged(docs.sparkSession.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()
    assert {r.doc_id: r._kept for r in rows} == {k: kept for k, _, kept in cases}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:1] + 0.03 * rng.standard_normal((60, 16))]).astype(np.float32)
    rows = [(k, [float(v) for v in r], k) for k, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [1.0], 0), (905, [1.0], 0), (None, [1.0], 0), (906, [], 0)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    root = brute_components(len(x), lambda a, b: near[a, b])
    assert [(got[k].n_links, got[k].component_id) for k in range(len(x))] == [(int(near[k].sum()) - 1, root[k]) for k in range(len(x))]
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (900, 901, 902, 903, 906)) and got[905].component_id == 904 and not got[None].kept


def test_vectors_chunks(spark, monkeypatch):
    """CHUNK reaches the linking of large buckets and the counting over blocks."""
    seen = []
    link, count = vectors.link_buckets, vectors.count_links
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "link_buckets", lambda t, v, load, near, chunk=1024: seen.append(chunk) or link(t, v, load, near, chunk))
    monkeypatch.setattr(vectors, "count_links", lambda m, cosine, block=512: seen.append(block) or count(m, cosine, block))
    vectors.near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>"))
    assert seen == [16, 8]


def test_similar(docs, none):
    assert similar.keep_one(none).collect() == []
    ids = [r.doc_id for r in similar.keep_one(docs).collect()]
    assert ids.count(6) == 1 and 8 not in ids and ids.count(None) == 2 and {3, 4, 5, 9, 10, 11} <= set(ids) and not {1, 2} & set(ids)


def test_similar_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts[10 * k] = " ".join(words)
        for c in range(k % 4):
            near = list(words)
            near[int(rng.integers(0, 200))] = f"new{k}_{c}"
            texts[10 * k + 1 + c] = " ".join(near)
        texts[10 * k + 9] = " ".join(words[:100] + [f"w{x}" for x in rng.integers(0, 5000, 100)])
    ids = sorted(texts)
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in texts.items())}
    root = brute_components(len(ids), lambda a, b: len(grams[ids[a]] & grams[ids[b]]) >= 0.8 * len(grams[ids[a]] | grams[ids[b]]))
    got = similar.keep_one(spark.createDataFrame([(k, t, "en", "s0", len(t), "m", 1, 2) for k, t in texts.items()], SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == sorted({ids[r] for r in root})


@pytest.mark.parametrize("shingles", [400_000, 300])
def test_similar_at_the_limit(spark, monkeypatch, shingles):
    """Pairs at 0.78 to 0.85: the shingles decide, not their estimate."""
    monkeypatch.setattr(similar, "SHINGLES", shingles)
    rng, rows, want = np.random.default_rng(6), [], []
    for k in range(63):
        words, m = [f"w{x}" for x in rng.integers(0, 5000, 200)], 16 + k % 9
        a, b = " ".join(words), " ".join(words[:-m] + [f"new{k}_{x}" for x in range(m)])
        one, two = ({tuple(t.split()[i : i + 5]) for i in range(196)} for t in (a, b))
        rows += [(2 * k, a), (2 * k + 1, b)]
        want += [2 * k] if len(one & two) >= 0.8 * len(one | two) else [2 * k, 2 * k + 1]
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == want and 70 < len(want) < 120


def test_similar_shared_ids(spark):
    """Each text of a doc_id keeps its own links, and the doc_id links its texts."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(5)]
    rows = [(10, t) for t in texts] + [(20 + k, f"{t} more") for k, t in enumerate(texts)] + [(5, texts[0] + " less"), (40, "another text of its own")]
    for order in (rows, rows[::-1]):
        got = similar.keep_one(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(r.doc_id for r in got) == [5, 40]


def test_pipeline(docs, none, spark):
    import corpus_pipeline

    good = " ".join(f"the word{k} of and text{k * k}" for k in range(40))
    more = docs.unionByName(spark.createDataFrame([(50 + k, good + f" tail{k}", "en", f"s{k % 2}", 1, "m", 7, 8) for k in range(3)] + [(60, good[::-1] + " the of a@b.cd", "en", "s1", 1, "m", 7, 8)], SCHEMA))
    for start in (more, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            assert name == "packing" or now.columns == docs.columns
            if name == "near_duplicates" and start is more:
                assert sorted(r.doc_id for r in now.collect() if r.doc_id and r.doc_id >= 50) == [50, 60]
        ids = {r.doc_id for r in now.collect()}
        assert ids <= {50, 60} and (start is none or ids)


def brute_base(text):
    """Base spans (s, e, kind) by the wording of the contract."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda v: re.sub("[^0-9]", "", v)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, (form, right)) in enumerate(tests.items()) for m in re.finditer(form, text) if right(m.group())]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_private_query(spark, docs, tmp_path):
    """op6's rows: every count, digest and base span; base spans stay among all spans."""
    rng = np.random.default_rng(12)
    parts = ["a.b@c.de", "x@y", "10.20.30.40", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (017) 555-7713", "+12 3", " ", "\n", "naïve ", "\U0001f600", "7", "-", ".", "word "]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), 60)) for _ in range(150)] + TEXTS
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in private.query(spark, str(tmp_path)).collect():
        base = brute_base(texts[r.doc_id] or "")
        written = [f"{kind}:{s}:{e}" for s, e, kind in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[2] == k for b in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and not Counter(written) - Counter(r.spans.split(","))


def test_private_learns_both_sides(spark):
    """Patterns with a word on either side and with two on the right need more seeds; secrets come from their patterns alone."""
    rows = [(k, f"f{k} (mid) u{k}@x{k}.example.com (post) t{k}") for k in range(30)] + [(100 + k, f'f{k} token = "{k:032x}" g{k}') for k in range(30)]
    cases = [("q (mid) jane(at)example.org (post) z", [("jane(at)example.org", 0)]), ("q mid jane(at)example.org other z", []), ('q token = "pass9word" z', [("pass9word", 4)]), (f'q sha = "{7:032x}" z', [])]
    rows += [(1000 + k, t) for k, (t, _) in enumerate(cases)]
    out = {r.doc_id: r for r in private.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[(t[o.s : o.e], o.k) for o in out[1000 + k].spans] for k, (t, _) in enumerate(cases)] == [w for _, w in cases]
    assert all([o.k for o in out[100 + k].spans] == [4] and not out[100 + k].base for k in range(30))


def test_private_long_text(spark):
    """Work grows with the text: 300,000 words with digits, as many matches, in one text."""
    n = 300_000
    text = " ".join(f"w{k}9{k % 97:05d}x" if k % 50 else f"u{k}@x.example.com" for k in range(n))
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string").repartition(2)
    began = time.time()
    got = {r.doc_id: r for r in private.all_spans(docs).collect()}
    assert time.time() - began < 120
    assert [(text[o.s : o.e]) for o in got[1].base] == [f"u{k}@x.example.com" for k in range(0, n, 50)] and got[2].spans == []
    clean = private.redact(docs).where("doc_id = 1").first().text
    assert clean.count("[EMAIL]") == n // 50 and clean == re.sub(r"u\d+@x\.example\.com", "[EMAIL]", text)


def test_clashing_columns(spark):
    """Columns named like an operator's own pass untouched; those that an operator adds give way."""
    names = ["target", "_q", "_id", "_th", "_key", "_text", "_size", "_of", "row", "key", "spans", "th", "of", "source_size", "_step", "a.b", "node", "bucket"]
    rows = [(k, f"mail u{k}@x.example.com " + "word " * (k + 1), f"s{k % 2}", *[f"{n}{k}" for n in names]) for k in range(12)]
    wide = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    mixed = mixing.mix(wide).collect()
    assert len(mixed) == 12 and all(r[n] == f"{n}{r.doc_id}" for r in mixed for n in names if n != "_size") and all(r["_size"] == r.doc_id + 3 for r in mixed)
    clean = private.redact(wide)
    assert clean.columns == wide.columns and all(r["text"].startswith("mail [EMAIL] ") and all(r[n] == f"{n}{r.doc_id}" for n in names) for r in clean.collect())
    assert sorted(tuple(r) for r in similar.keep_one(wide).collect()) == sorted(tuple(r) for r in rows)


def test_mixing_odds(spark):
    """Inclusion follows size: of equal numbers of short and long documents, more long ones are drawn, and the words still meet the target."""
    rows = [(k, "w " * (4 if k % 2 else 16), "s") for k in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    drawn = Counter(r._size for r in out if r._copies == 2)
    assert all(r._copies in (1, 2) for r in out) and drawn[16] > 1.4 * drawn[4] > 0
    assert abs(sum(r._size * r._copies for r in out) - out[0]._target) <= 16
    none = mixing.mix(spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [r._copies for r in none] == [0, 0]
