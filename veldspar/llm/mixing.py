"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source's weight is a line over the time from 0 to 1; its integral, scaled to 1, is the share of the source's
demand that is due by a time. A document's place in its source's token order is turned into a training position by
the inverse of that integral, and the mix is range-sorted by position.

Token order inside a source comes from two levels: sums by (source, slice of the hash order) are small and get
prefix sums; inside a slice a window adds the rest. So a source with a third of all rows is spread over all slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm.common import WORD, fresh, store, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
#: Slope of a source's weight over time, by its place in the order of sources: early, level and late sources.
SLOPES = (-0.5, 0.0, 0.5)
SLICES = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str = "source") -> DataFrame:
    """source, source_size, target, slope of every source, given rows with ``size``.

    Targets share BUDGET of all words by weight and stop at MOST times the source's size; what is over goes to the
    others by weight. The level is found in closed form: in the order of cap by weight, a source is capped exactly
    if the level that the later ones would share is at or over its own cap by weight.
    """
    by_source = sizes.groupBy(F.col(source_col).alias("_s")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("_s").asc_nulls_last())
    ranked = by_source.withColumn("_k", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_k") % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("slope", F.element_at(F.array(*[F.lit(w) for w in SLOPES]), (F.col("_k") % len(SLOPES) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", MOST * F.col("source_size"))
    level = Window.orderBy(F.col("_cap") / F.col("_w"), "_k")
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_left", BUDGET * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.sum("_w").over(after))
        .withColumn("_first", F.min(F.when(F.col("_level") < F.col("_cap") / F.col("_w"), F.struct((F.col("_cap") / F.col("_w")).alias("_r"), "_k", "_level"))).over(whole))
    )
    target = F.when(F.col("_level") < F.col("_cap") / F.col("_w"), F.least(F.col("_cap").cast("double"), F.col("_first._level") * F.col("_w"))).otherwise(F.col("_cap").cast("double"))
    return ranked.select(F.col("_s"), "source_size", "slope", target.alias("target"))


def due(share: Column, slope: Column) -> Column:
    """The time in 0..1 by which ``share`` of a source's demand is due: inverse of the integral of 1 + slope * (2 t - 1)."""
    flat = 1 - slope
    root = F.sqrt(F.greatest(flat * flat + 4 * slope * share, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise((root - flat) / (2 * slope))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, times, position (of its first use).

    Documents are taken whole: every one ``floor(target / source_size)`` times, and once more those whose middle,
    in the source's hash order, lies within what is left; so a source misses its target by less than a document,
    and no document is taken more than twice. Order: md5 of the id, the id, the size, a hash of the text; rows
    equal in all of these are alike. Null texts have size 0; a null source is a source of its own, a null id sorts
    first; a table without words takes nothing. Other columns are ignored.
    """
    sizes = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), words_in(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_o"), F.xxhash64(F.col(text_col)).alias("_h"),
    )
    sizes = store(sizes.withColumn("_slice", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int")), "sizes")
    goal = targets(sizes, "_s")
    by_slice = sizes.groupBy("_s", "_slice").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    plan = by_slice.join(goal.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    inside = Window.partitionBy("_s", "_slice").orderBy("_o", F.col("_id").asc_nulls_first(), "size", F.col("_h").asc_nulls_first())
    rows = sizes.withColumn("_before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = rows.join(plan.select(F.col("_s").alias("_t"), F.col("_slice").alias("_u"), "_ahead", "source_size", "target", "slope"), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_slice") == F.col("_u")))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("long")
    middle = F.col("_ahead") + F.col("_before") + F.col("size") / 2
    left = F.col("target") - passes * F.col("source_size")
    once_more = (F.col("size") > 0) & (passes < MOST) & (middle <= left)
    times = F.when(F.col("size") > 0, passes + F.when(once_more, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return both.select(
        F.col("_id").alias(id_col), F.col("_s").alias(source_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"),
        F.when(times > 0, due(F.least(middle / F.col("target"), F.lit(1.0)), F.col("slope"))).alias("position"), F.col("_h"),
    )


def blend(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, as the mix uses them: repeated or left out, range-sorted by training position.

    Uses of one document lie ``source_size / target`` of its source's demand apart. Rows equal in id, source and text share a decision.
    """
    h, i, s, g, times, position, lag, use, at = (fresh(docs, x) for x in ("_hash", "_i", "_source", "_g", "_times", "_position", "_lag", "_use", "_at"))
    plan = mix(docs).where(F.col("times") > 0).groupBy("doc_id", "source", "_h").agg(F.max("times").alias(times), F.min("position").alias(position), F.max(F.col("source_size") / F.col("target")).alias(lag))
    plan = plan.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("_h").alias(g), times, position, lag)
    kept = docs.withColumn(h, F.xxhash64("text")).join(plan, F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(h) == F.col(g)))
    used = kept.withColumn(use, F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))
    used = used.withColumn(at, F.least(F.col(position) + F.col(use) * F.col(lag), F.lit(1.0)))
    return used.repartitionByRange(F.col(at), F.col("doc_id")).sortWithinPartitions(at, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    out = out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))
    return out.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE k % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope,
         2 * source_size AS cap FROM by_source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
first_free AS (SELECT level FROM levels WHERE level < cap::DOUBLE / w ORDER BY cap::DOUBLE / w, k LIMIT 1),
goals AS (
  SELECT source, source_size, slope, CASE WHEN level < cap::DOUBLE / w THEN least(cap::DOUBLE, (SELECT level FROM first_free) * w) ELSE cap::DOUBLE END AS target FROM levels),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY o, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM sizes),
timed AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, g.slope, p.middle,
         CASE WHEN p.size = 0 OR g.source_size = 0 THEN 0
              ELSE least(floor(g.target / g.source_size), 2) + CASE WHEN least(floor(g.target / g.source_size), 2) < 2
                   AND p.middle <= g.target - least(floor(g.target / g.source_size), 2) * g.source_size THEN 1 ELSE 0 END END AS times,
         least(p.middle / g.target, 1.0) AS share
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * times AS BIGINT) AS taken,
       CASE WHEN times > 0 THEN round(CASE WHEN slope = 0 THEN share
            ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * share, 0)) - (1 - slope)) / (2 * slope) END, 9) END AS position
FROM timed
"""
