"""Operator 9: quality rules from a threshold table, compiled into one projection.

Each rule is a row (name, measure, least, most); ``compile_rules`` turns the table into one
boolean expression over the measures, and ``measured`` computes all measures of a text in one
projection of built-in functions. Arrays that several functions read are bound once, as the
variable of a one-element ``transform``; otherwise the optimizer would repeat their expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Common function words of the languages that are expected.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "by", "this", "from", "at", "as", "it",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "est", "pas", "pour", "dans", "avec", "sur", "par",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "den", "ein", "eine", "auf", "im", "dem", "auch", "sich",
    "el", "los", "las", "y", "del", "por", "con", "una", "no", "se", "es", "para", "su", "al", "lo",
)

#: (rule, measure, least, most); None: no bound. A measure that is null passes.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word_length", "mean_word_chars", 2.0, 15.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop_words", "n_stop_words", 2.0, None),
    ("repeated_lines", "dup_line_ratio", None, 0.3),  # by characters: one short line twice among three is no fault
    ("pipes_and_bullets", "bullet_line_ratio", None, 0.9),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more (windows compare by a 64-bit hash of their words)."""

    def of_windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
        return bound(F.sort_array(hashes), of_sorted)

    def of_sorted(g: Column) -> Column:
        last = F.size(g) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (F.get(g, k - 1)["h"] == g[k]["h"])) | ((k < last) & (F.get(g, k + 1)["h"] == g[k]["h"])))
        places = F.sort_array(F.transform(twice, lambda k: g[k]["i"]))
        return bound(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
            F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("end")), lambda s, i: F.struct((s["n"] + 3 - F.greatest(F.lit(0), s["end"] - i)).alias("n"), (i + 3).alias("end")), lambda s: s["n"])
        ))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(of_windows(words)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_m``: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of the rules."""
    text = F.coalesce("text", F.lit(""))
    long = lambda c: c.cast("long")

    def of_words(w: Column) -> Column:
        stops = F.array_intersect(F.array(*[F.lit(s) for s in STOP_WORDS]), F.transform(w, F.lower))
        return F.struct(long(F.size(w)).alias("n_words"), long(F.size(stops)).alias("n_stop_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        bullets = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^\s*[-*•|]")))
        return F.struct(long(F.size(lines)).alias("n_lines"), long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), long(F.size(bullets)).alias("n_bullets"), long(F.length(F.array_join(lines, ""))).alias("line_chars"), long(F.length(F.array_join(F.array_distinct(lines), ""))).alias("distinct_chars"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    chars = F.struct(
        long(F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
    )

    def together(t: Column) -> Column:
        w, l, c = t["w"], t["l"], t["c"]
        words, rows = F.greatest(w["n_words"], F.lit(1)), F.greatest(l["n_lines"], F.lit(1))
        return F.struct(
            w["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), l["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            w["n_stop_words"].alias("n_stop_words"), (c["word_chars"] / words).alias("mean_word_chars"), (c["n_symbols"] / words).alias("symbol_ratio"), ((l["line_chars"] - l["distinct_chars"]) / F.greatest(l["line_chars"], F.lit(1))).alias("dup_line_ratio"), (l["n_bullets"] / rows).alias("bullet_line_ratio"),
        )

    parts = F.struct(bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("w"), bound(lines, of_lines).alias("l"), chars.alias("c"))
    return docs.withColumn("_m", bound(parts, together))


def compile_rules(measures: Column, rules=RULES) -> Column:
    """True where no rule of the table fails."""
    verdict = F.lit(True)
    for _, name, least, most in rules:
        if least is not None:
            verdict = verdict & F.coalesce(measures[name] >= F.lit(least), F.lit(True))
        if most is not None:
            verdict = verdict & F.coalesce(measures[name] <= F.lit(most), F.lit(True))
    return verdict


def judged(docs: DataFrame, rules=RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``docs`` with _m, _base_failed and _kept.

    A null or empty text has no words, fails and is dropped. Each row is judged alone, so ties,
    repeated rows and null ids change nothing. ``_m`` and its like replace columns of that name.
    """
    m = F.col("_m")
    failed = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])
    return measured(docs).withColumn("_base_failed", failed).withColumn("_kept", ~failed & compile_rules(m, rules))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *[F.col("_m")[n].alias(n) for n in names], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
p AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(3, coalesce(after - i, 3))) AS BIGINT) AS n FROM p GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(array_to_string(lines, '')) AS line_chars, length(array_to_string(list_distinct(lines), '')) AS distinct_chars,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•|]'))) AS n_bullets,
    len(list_intersect([{stops}], list_transform(words, lambda x: lower(x)))) AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AND n_symbols / greatest(n_words, 1) <= 0.1 AND n_stop_words >= 2
    AND (line_chars - distinct_chars) / greatest(line_chars, 1) <= 0.3 AND n_bullets / greatest(n_lines, 1) <= 0.9 AS kept
FROM f
""".replace("{stops}", ", ".join(f"'{s}'" for s in STOP_WORDS))
