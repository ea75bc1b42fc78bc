"""Operator 6: personal data by patterns of form, then bootstrapped patterns of context.

Base entities (email, ip, card, phone) come from their forms. They and quoted runs of hexadecimal
digits (secret) seed a graph: a pattern is a kind with words around it (two to the left, one on
either side, or two to the right); its instances are the entities found there and what looks
like an identifier of the kind (LIKE): tokens with an at-like sign, digit groups joined by dots or
colons, whole runs of digit groups, and for every kind tokens of MIN_DIGITS digits or more. A
pattern's score is the share of its distinct instances believed to be of its kind, an instance's
belief the noisy-or of its patterns; both are recomputed over the whole corpus for a few rounds.
Patterns scored ``ACCEPT`` or more on SUPPORT seeds or more (WIDE if not two words to the left) add
the unseen instances of their kind that they lead to; secrets need such a pattern too.

Work grows with a text's length and its matches: places and neighbouring words come from the
pieces between matches, in blocks, never from a search through the text for each match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, beside, stored, whole_row
from .quality import bound

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET, EVERY = 4, 0b11111
ACCEPT, SUPPORT, WIDE, ROUNDS, MIN_DIGITS = 0.8, 5, 20, 3, 5
#: Items that a scan takes at a time; code points of a text's blocks and of what stands around a match.
STEP, BLOCK, AROUND = 64, 4096, 80
# The forms, with quantifiers that never back off where nothing could follow (equal matches, no
# recursion on long runs), and starts within a run left out, where the run's start has failed.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TOKEN = rf"(?<![^\x20\x09-\x0D])(?=(?:[^\x20\x09-\x0D0-9]*+[0-9]){{{MIN_DIGITS}}})[^\x20\x09-\x0D]++"
_START, _OPEN = r"(?<![^\x20\x09-\x0D])", r"(?<![^\x20\x09-\x0D\"'(\[<{=:])"
_AT = r"(?:[@\uFF20\uFE6B]|&#64;|%40|[(\[{<_-](?i:at)[)\]}>_-])"
_SIGN = r"@\uFF20\uFE6B&%(\[{<_-"  # with which _AT begins
_GROUP = r"[0-9]++(?![\p{L}_@%])"
_HEX = r"(?<=[\"'])[0-9A-Fa-f]{32,}+(?=[\"'])"
#: What an accepted pattern may add: the kinds (bits by place in KINDS), a cheap test of the text, a form, and whether signs around it are cut off.
LIKE = [
    (EVERY, rf"[0-9](?:[^\x20\x09-\x0D0-9]*+[0-9]){{{MIN_DIGITS - 1}}}", TOKEN, True),
    (0b00001, r"[@\uFF20\uFE6B]|&#64;|%40|[(\[{<_-][Aa][Tt][)\]}>_-]", rf"{_START}(?:[^\x20\x09-\x0D]++\x20(?=[{_SIGN}]){_AT}\x20[^\x20\x09-\x0D]++|(?=[^\x20\x09-\x0D{_SIGN}]*+[{_SIGN}])(?=[^\x20\x09-\x0D]+?{_AT}[^\x20\x09-\x0D])[^\x20\x09-\x0D]++)", True),
    (0b00010, r"[0-9A-Fa-f]?[.:]++[0-9]|[0-9][.:]", rf"{_OPEN}(?=[A-Fa-f.:]*+[0-9])[0-9A-Fa-f]*+(?:[.:]++[0-9A-Fa-f]*+)++(?![^\x20\x09-\x0D\"')\]>}},;!?|])", True),
    (0b01100, r"[0-9]", rf"{_OPEN}\+?\(?{_GROUP}(?:(?:\)?[\x20.\x2F-]?\(?|\)?\x20[-.\x2F]\x20\(?){_GROUP})*+", False),
    (0b10000, r"[\"'][^\"'0-9\x20\x09-\x0D]*+[0-9]", r"(?<=[\"'])(?=[^\"'0-9\x20\x09-\x0D]*+[0-9])[^\"'\x20\x09-\x0D]{6,}+(?=[\"'])", False),
]
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPAN = "struct<s:int,e:int,v:string,b:string,a:string>"
_SEEN = "struct<s:int,e:int,k:int,t:int,c:array<string>,v:bigint>"
_KEPT = "struct<s:int,k:int,e:int>"


def _no(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The results of ``step(state, item) -> (state, result)`` over an array in order, as an array of ``kind``.

    An aggregate copies what it has gathered at each item. So the states at every STEP items come
    first, and each block's results from its state.
    """

    def results(state: Column, block: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            after, result = step(acc["state"], item)
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

        return F.aggregate(block, F.struct(state.alias("state"), _no(kind).alias("out")), one, lambda acc: acc["out"])

    def long(x: Column) -> Column:
        block = lambda k: F.slice(x, k * STEP + 1, F.lit(STEP))
        count = F.floor((F.size(x) - 1) / STEP).cast("int")
        states = F.aggregate(
            F.sequence(F.lit(1), count), F.array(zero),
            lambda acc, k: F.concat(acc, F.array(F.aggregate(block(k - 1), F.element_at(acc, -1), lambda state, item: step(state, item)[0]))),
        )
        return bound(states, lambda at: F.flatten(F.transform(at, lambda state, k: results(state, block(k)))))

    return bound(items, lambda x: F.when(F.size(x) <= STEP, results(zero, x)).otherwise(long(x)))


def occurrences(text: Column, form: str) -> Column:
    """Matches as (s, e, v, b, a): code points, e exclusive; the match, and up to AROUND code points before and after it.

    Matches and the pieces between them give the places.
    """

    def shifted(x: Column, by: int) -> Column:
        return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))

    def step(state: Column, o: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(o["gap"])
        end = start + F.length(o["match"])
        before = F.substring(F.concat(state["tail"], o["gap"]), -AROUND, AROUND)
        after = F.substring(F.concat(o["next"], F.coalesce(o["then"], F.lit("")), F.coalesce(o["last"], F.lit(""))), 1, AROUND)
        tail = F.substring(F.concat(state["tail"], o["gap"], o["match"]), -AROUND, AROUND)
        return F.struct(end.alias("at"), tail.alias("tail")), F.struct(start.alias("s"), end.alias("e"), o["match"].alias("v"), before.alias("b"), after.alias("a"))

    def places(x: Column) -> Column:
        zipped = F.arrays_zip(F.slice(x["p"], 1, F.size(x["m"])).alias("gap"), x["m"].alias("match"), shifted(x["p"], 1).alias("next"), shifted(x["m"], 1).alias("then"), shifted(x["p"], 2).alias("last"))
        return scan(zipped, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, _SPAN)

    both = F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("m"), F.split(text, form, -1).alias("p"))
    return bound(both, lambda x: F.when(F.size(x["m"]) == 0, _no(_SPAN)).otherwise(places(x)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def total(d: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(d)), F.lit(0),
            lambda a, i: a + bound(F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)),
        )

    return bound(_digits(v), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def base_spans(text: Column) -> Column:
    """Base entities as an array of (s, k, e, v, b, a), by start and kind (k: place in KINDS)."""
    tests = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: F.rlike(v, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": _luhn,
        "phone": lambda v: F.length(_digits(v)).between(10, 15),
    }
    none = _no("struct<s:int,k:int,e:int,v:string,b:string,a:string>")

    def of_kind(k: int, kind: str) -> Column:
        right = F.filter(occurrences(text, FORMS[kind]), lambda o: tests[kind](o["v"]))
        typed = F.transform(right, lambda o: F.struct(o["s"].alias("s"), F.lit(k).alias("k"), o["e"].alias("e"), o["v"].alias("v"), o["b"].alias("b"), o["a"].alias("a")))
        return F.when(F.rlike(text, F.lit(HINTS[kind])), typed).otherwise(none)

    return F.sort_array(F.concat(*[of_kind(k, kind) for k, kind in enumerate(FORMS)]))


def contexts(before: Column, after: Column) -> Column:
    """Two words to the left (L), one on either side (M), two to the right (R): lower case, digits as 0, without signs next to the place."""
    word, left_signs, right_signs = r"[^\x20\x09-\x0D]{1,30}", r"[\"'(\[<=:]*$", r"^[\"')\]>},.;:!?|]*"
    plain = lambda w: F.regexp_replace(F.regexp_replace(F.lower(w), SPACE, " "), "[0-9]", "0")
    left = F.regexp_extract(before, rf"((?:(?<![^\x20\x09-\x0D]){word}{SPACE})?(?<![^\x20\x09-\x0D]){word}){SPACE}{left_signs}", 1)
    right = F.regexp_extract(after, rf"{right_signs}{SPACE}({word}(?:{SPACE}{word}(?![^\x20\x09-\x0D]))?)", 1)

    def of_words(x: Column) -> Column:
        l, r = F.split(x["l"], " "), F.split(x["r"], " ")
        return F.filter(F.array(
            F.when(F.size(l) == 2, F.concat(F.lit("L "), x["l"])),
            F.when((x["l"] != "") & (x["r"] != ""), F.concat(F.lit("M "), F.element_at(l, -1), F.lit(" _ "), F.element_at(r, 1))),
            F.when(F.size(r) == 2, F.concat(F.lit("R "), x["r"])),
        ), lambda c: c.isNotNull())

    return bound(F.struct(plain(left).alias("l"), plain(right).alias("r")), of_words)


def apart(seen: Column) -> Column:
    """Of entities and others by start: without the others that overlap an entity (k not null), in two passes."""
    marked = f"struct<o:{_SEEN},hit:boolean>"

    def forward(reach: Column, o: Column) -> tuple[Column, Column]:
        return F.when(o["k"].isNotNull(), F.greatest(reach, o["e"])).otherwise(reach), F.struct(o.alias("o"), (o["k"].isNull() & (o["s"] < reach)).alias("hit"))

    def backward(reach: Column, x: Column) -> tuple[Column, Column]:
        o = x["o"]
        return F.when(o["k"].isNotNull(), F.least(reach, o["s"])).otherwise(reach), F.struct(o.alias("o"), (x["hit"] | (o["k"].isNull() & (o["e"] > reach))).alias("hit"))

    def both(x: Column) -> Column:
        passed = scan(F.reverse(scan(F.sort_array(x), F.lit(0), forward, marked)), F.lit(2**31 - 1), backward, marked)
        return F.transform(F.filter(passed, lambda o: ~o["hit"]), lambda o: o["o"])

    return bound(seen, lambda x: F.when(F.exists(x, lambda o: o["k"].isNotNull()) & F.exists(x, lambda o: o["k"].isNull()), both(x)).otherwise(x))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), base (s, k, e) and seen (s, e, k or null, kinds it may be of, contexts, value) of each row."""
    text = F.coalesce("text", F.lit(""))

    def entry(s: Column, e: Column, k: Column, t: int, o: Column, v: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), k.cast("int").alias("k"), F.lit(t).alias("t"), contexts(o["b"], o["a"]).alias("c"), F.xxhash64(F.lower(v)).alias("v"))

    def cut(o: Column) -> Column:
        """Without the signs around it."""
        opened = F.length(F.regexp_extract(o["v"], r"^[\"'(\[<{=:]*+", 0))
        return bound(F.struct(opened.alias("a"), F.length(F.regexp_extract(o["v"], r"[\"')\]>},.;:!?|]*$", 0)).alias("z")), lambda n: F.struct(
            (o["s"] + n["a"]).alias("s"), F.greatest(o["s"] + n["a"], o["e"] - n["z"]).alias("e"), F.substring(o["v"], n["a"] + 1, F.greatest(F.length(o["v"]) - n["a"] - n["z"], F.lit(0))).alias("v"), o["b"].alias("b"), o["a"].alias("a")))

    def of_form(t: int, hint: str, form: str, trim: bool) -> Column:
        typed = lambda o: entry(o["s"], o["e"], F.lit(None), t, o, o["v"])
        found = F.transform(occurrences(text, form), lambda o: bound(cut(o), typed) if trim else typed(o))
        return F.when(F.rlike(text, F.lit(hint)), found).otherwise(_no(_SEEN))

    def both(base: Column) -> Column:
        seeds = F.transform(base, lambda b: entry(b["s"], b["e"], b["k"], EVERY, b, b["v"]))
        secrets = F.when(F.rlike(text, F.lit(_HEX)), F.transform(occurrences(text, _HEX), lambda o: entry(o["s"], o["e"], F.lit(SECRET), EVERY, o, o["v"]))).otherwise(_no(_SEEN))
        seen = apart(F.concat(seeds, secrets, *[of_form(*x) for x in LIKE]))
        return F.struct(F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"))).alias("base"), F.filter(seen, lambda o: (F.size(o["c"]) > 0) & (o["e"] > o["s"])).alias("seen"))

    rows = docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("th"), bound(base_spans(text), both).alias("x"))
    return rows.select("doc_id", "th", "x.base", "x.seen")


def believed(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted instances that are no base entities: doc_id, th, s, k, e."""
    seen = found.select("doc_id", "th", F.explode("seen").alias("o")).select("doc_id", "th", "o.s", "o.e", "o.k", "o.t", "o.v", F.explode("o.c").alias("c"))
    links = stored(seen.groupBy("c", "v").agg(F.max("k").alias("k"), F.bit_or("t").alias("t")), "links")  # one row per pattern context and value
    least = F.when(F.col("c").startswith("L "), SUPPORT).otherwise(WIDE)
    support = links.where("k is not null").groupBy("c", "k").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least)
    support = stored(support.withColumnRenamed("k", "pk"), "support")
    fits = F.expr("t & shiftleft(1, pk)") != 0  # a seed fits every kind: it counts against the others
    edges = stored(links.join(support, "c").where(fits).select("c", "v", "pk", F.when(F.col("k").isNotNull(), (F.col("k") == F.col("pk")).cast("double")).alias("sure")), "edges")
    belief = edges.groupBy("v", "pk").agg(F.coalesce(F.max("sure"), F.lit(0.0)).alias("b"))
    for _ in range(rounds):
        belief = stored(belief, "belief")
        score = edges.join(belief, ["v", "pk"]).groupBy("c", "pk").agg((F.sum("b") / (F.count("*") + 1)).alias("score"))
        score = stored(score, "score")
        noisy = F.lit(1.0) - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        belief = edges.join(score, ["c", "pk"]).groupBy("v", "pk").agg(F.coalesce(F.max("sure"), noisy).alias("b"))
    strong = score.where(F.col("score") >= ACCEPT).groupBy("c").agg(F.max(F.struct("score", (-F.col("pk")).alias("n"), "pk")).alias("best"))
    strong = strong.select("c", "best", "best.pk")
    rows = seen.where(F.col("k").isNull() | (F.col("k") == SECRET)).join(strong, "c").where(fits & F.coalesce(F.col("k") == F.col("pk"), F.lit(True)))
    return rows.groupBy("doc_id", "th", "s", "e").agg(F.max("best").alias("best")).select("doc_id", "th", "s", F.col("best.pk").alias("k"), "e")


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, base and spans (arrays of s, k, e by start and kind) for every row of ``docs``.

    A null text is empty. Rows are told apart by doc_id and a hash of the text; rows equal in both
    have equal spans, and a null doc_id is an id like any other.
    """
    found = stored(found_in(docs), "found")
    added = believed(found).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "k", "e")).alias("added"))  # a few for each token of the text at most
    added = added.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    out = found.join(added, found["doc_id"].eqNullSafe(added["_id"]) & (found["th"] == added["_th"]), "left")
    return out.select("doc_id", "th", "base", F.sort_array(F.concat("base", F.coalesce("added", _no(_KEPT)))).alias("spans"))


def without(text: Column, spans: Column) -> Column:
    """``text`` with [KIND] in place of ``spans`` (by start); overlapping spans become one, named after the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def part(blocks: Column, a: Column, z: Column) -> Column:
        """Code points a to z, from the blocks that they lie in."""
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((z - 1) / BLOCK).cast("int")
        within = F.substring(F.get(blocks, first), a % BLOCK + 1, z - a)
        across = F.concat(F.substring(F.get(blocks, first), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(F.get(blocks, last), F.lit(1), z - last * BLOCK))
        return F.when(z <= a, F.lit("")).when(first == last, within).otherwise(across)

    def rebuilt(blocks: Column) -> Column:
        def step(at: Column, o: Column) -> tuple[Column, Column]:
            return F.greatest(at, o["e"]), F.when((o["s"] >= at), F.concat(part(blocks, at, o["s"]), names[o["k"]])).otherwise(F.lit(""))

        end = F.array_max(F.transform(spans, lambda o: o["e"]))
        return F.concat(F.array_join(scan(spans, F.lit(0), step, "string"), ""), bound(end, lambda z: part(blocks, z, F.length(text))))

    return bound(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), rebuilt)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [KIND]; overlapping spans become one, named after the first.

    Other columns, of whatever name, stay as they are.
    """
    rows = docs.select(whole_row(docs).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.xxhash64(F.lit(1), "row.text").alias("key"))
    spans = all_spans(docs.select("doc_id", "text")).where("size(spans) > 0").select(F.col("doc_id").alias("of"), "th", "spans").distinct()
    spans = beside(stored(spans, "spans"), F.size("spans"))
    rows = rows.join(spans, rows["id"].eqNullSafe(spans["of"]) & (rows["key"] == spans["th"]), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(without(F.col("row.text"), F.col("spans")))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda o: F.concat_ws(":", kinds[o["k"]], o["s"], o["e"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = all_spans(table(spark, sf_dir, "documents"))
    counted = lambda k: F.size(F.filter("base", lambda o: o["k"] == k)).cast("long")
    counts = [counted(k).alias(f"n_{kind}") for k, kind in enumerate(FORMS)]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
