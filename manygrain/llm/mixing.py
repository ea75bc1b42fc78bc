"""Operator 7: mixing sources to target weights by Pareto order sampling.

Every source gets a target from its weight. Whole copies are certain; what is left is drawn with
unequal probabilities: p being the share of the source's words that is left, a document's inclusion
odds are p/(1-p) times its size over the mean size of its source. Documents rank by their
random odds u/(1-u) over their inclusion odds, and the first ones are taken until the words left
are reached. u is a fixed hash of the doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored, whole_row

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
STEPS, SEED = 4096, "mix-1"
#: Sources up to which their table is broadcast (some MB); beyond, the join shuffles.
FEW_SOURCES = 50_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also target: ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources (by code point, null last) take the weights in turn. Resharing what is above the
    limit until none is above comes to one level, least(limit, weight x level), found by
    sorting on limit / weight. The windows see one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sources.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(most)).withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    out = out.withColumn("_before", F.sum("_limit").over(by_limit) - F.col("_limit")).withColumn("_weights", F.sum("_weight").over(everything) - F.sum("_weight").over(by_limit) + F.col("_weight"))
    out = out.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("_before")) / F.col("_weights"))
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return out.withColumn("_found", level).select("source", "source_size", F.when(F.col("_found").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_weight") * F.col("_found"))).alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """52 bits of a hash of the doc_id as a number strictly between 0 and 1."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))


ADDED = ("_size", "_source_size", "_target", "_copies")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """All rows of ``docs`` with _size, _source_size, _target and _copies (0, 1 or 2); own columns of these names give way.

    The size of a null or empty text is 0; such rows are never drawn. A null source is a source of
    its own, the last. Equal doc_ids draw the same number and rank by size; a null doc_id draws
    one too. No rows: no rows. Any other column, of whatever name, is passed on.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [c for c in docs.columns if c not in ADDED]
    sized = docs.select(whole_row(docs, own).alias("row"), docs["doc_id"], docs["source"], words.alias("_size"))
    sized = sized.withColumn("_u", uniform(F.col("doc_id"), seed))
    facts = stored(sized.select("source", "_size", "_u", "doc_id"), "sizes")
    sources = facts.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count_if(F.col("_size") > 0).alias("_docs"))
    sources = targets(sources.select("source", "source_size")).join(sources.select(F.col("source").alias("_of"), "_docs"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_whole", F.floor(rate)).withColumn("_p", rate - F.floor(rate))
    sources = sources.withColumn("_left", F.when(F.col("_p") > 0, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0))
    sources = sources.withColumn("_unit", F.when(F.col("_p") > 0, F.col("_p") / (1 - F.col("_p")) / (F.col("source_size") / F.col("_docs"))))  # inclusion odds of a word
    sources = stored(sources.withColumnRenamed("source", "_source"), "sources")
    few = sources.count() <= FEW_SOURCES

    def with_source(rows: DataFrame) -> DataFrame:
        right = F.broadcast(sources) if few else sources
        rows = rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")
        odds = F.col("_u") / (1 - F.col("_u"))
        rank = F.when((F.col("_p") > 0) & (F.col("_size") > 0), odds / (F.col("_unit") * F.col("_size")))
        return rows.withColumn("_q", rank).withColumn("_step", F.floor(rank / (1 + rank) * STEPS).cast("int"))

    # a step is a slice of the ranking: whole steps are taken by their sums, one is ranked row by row
    steps = with_source(facts).where("_q is not null and _size > 0").groupBy("source", "_step", "_left").agg(F.sum("_size").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("source").orderBy("_step"))
    cut = steps.withColumn("_before", run - F.col("_n")).where("_before <= _left").groupBy("source").agg(F.max_by("_step", "_step").alias("_cut"), F.max("_before").alias("_taken"))
    cut = stored(cut.withColumnRenamed("source", "_at"), "cut")
    edge = F.broadcast(cut) if few else cut

    def with_cut(rows: DataFrame) -> DataFrame:
        return rows.join(edge, rows["source"].eqNullSafe(edge["_at"]), "left").drop("_at")

    last = with_cut(with_source(facts)).where("_step = _cut and _size > 0")
    before = F.sum("_size").over(Window.partitionBy("source").orderBy("_q", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("_here", F.coalesce(before, F.lit(0))).where("_taken + _here + _size / 2 <= _left")
    ends = last.groupBy("source").agg(F.max(F.struct("_q", F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id"), "_size")).alias("_end"), F.count("*").alias("_rows"))
    ends = stored(ends.withColumnRenamed("source", "_of"), "ends")
    end = F.broadcast(ends) if few else ends
    out = with_cut(with_source(sized))
    out = out.join(end, out["source"].eqNullSafe(end["_of"]), "left").drop("_of")
    me = F.struct("_q", F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("doc_id")), F.col("_size").alias("_size"))
    drawn = (F.col("_size") > 0) & F.coalesce((F.col("_step") < F.col("_cut")) | ((F.col("_step") == F.col("_cut")) & (me <= F.col("_end"))), F.lit(False))
    out = out.withColumn("_copies", (F.col("_whole") + drawn.cast("int")).cast("int"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_copies")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS docs, CAST(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS INTEGER) - 1 AS place
  FROM sized GROUP BY source),
limited AS (
  SELECT source, source_size, docs, ([3.0, 1.0, 2.0])[place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM sources),
ordered AS (
  SELECT *, sum(most) OVER w - most AS before, sum(weight) OVER () - sum(weight) OVER w + weight AS weights, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM limited WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT arg_min((total - before) / weights, most / weight) AS found FROM ordered WHERE most / weight > (total - before) / weights),
targets AS (
  SELECT source, source_size, docs, CASE WHEN found IS NULL THEN most ELSE least(most, weight * found) END AS target FROM limited CROSS JOIN level),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
joined AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.source, floor(rate) AS whole, rate - floor(rate) AS p,
    (rate - floor(rate)) / (1 - (rate - floor(rate))) / (source_size / docs) AS unit,
    CASE WHEN rate > floor(rate) THEN target - floor(rate) * source_size ELSE 0 END AS remaining, d.u
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN (u / (1 - u)) / (unit * size) END NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM joined)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND before + size / 2.0 <= remaining THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
