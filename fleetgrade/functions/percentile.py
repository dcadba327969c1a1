"""Exact percentiles per group without gathering a group into one task.

Spark's ``percentile`` aggregate keeps a value->count map per group and merges
it in a single task, so a workspace that owns a third of a 100 TB history would
pin all its distinct durations in one task's memory. This operator gives the same
exact, linearly interpolated result (``PERCENTILE`` semantics: position
``p * (n - 1)`` over the sorted values) with bounded work per task:

1. count each distinct value per group (map-side partial aggregation);
2. start every requested rank with its group's whole value range;
3. while some range holds more than ``2**bucket_bits`` distinct values, cut it into ``2**bucket_bits`` equal
   parts between its least and greatest value, sum counts per part, and go on with the part
   that holds the rank, narrowed to the values really in it;
4. only inside the last ranges, order the distinct values (at most ``2**bucket_bits``) and read the
   values at the ranks.

Every level splits off at least one value and usually all but one in ``2**bucket_bits`` of them, for
whole numbers and fractions of any spread alike, so a second level is rare and no task ever
orders more than ``2**bucket_bits`` values or ``2**bucket_bits`` sums. Values count as DOUBLE; NULL and NaN
values are left out. Only "is any range still large" reaches the driver per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrade.session import cut_lineage

BITS = 16   # ranges are cut into 2^16 parts until they hold at most 2^16 values


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Step 1: multiplicity ``_c`` of each value per group."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))


def _within(values: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values inside the ranges (few rows per group) of their group."""
    return values.join(ranges, on=keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def exact_percentiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float], bucket_bits: int = BITS,
                      counts: DataFrame | None = None) -> DataFrame:
    """One row per group with one DOUBLE column per entry of ``probs``.

    Groups whose values are all NULL produce no row (join back with a left join).
    ``counts`` is an already computed (ideally materialised) ``value_counts`` table, which
    every level reads.
    """
    names, limit, buckets = list(probs), 2 ** bucket_bits, max(2, 2 ** bucket_bits)
    vc = counts if counts is not None else cut_lineage(value_counts(df, keys, value), "value-counts")
    vc = vc.select(*keys, F.col(value).cast("double").alias("_v"), "_c").where(~F.isnan("_v"))

    # Target ranks (0-based) of every probability, one struct per (prob, side).
    n1 = (F.col("_n") - F.lit(1)).cast("double")
    specs = []
    for i, name in enumerate(names):
        pos = n1 * F.lit(float(probs[name]))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            specs.append(F.struct(F.lit(i).alias("pid"), F.lit(side).alias("side"),
                                  pos.alias("pos"), rank.cast("long").alias("rank")))
    whole = vc.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    ranks = ["pid", "side", "pos", "rank"]
    span = ["_lo", "_hi", "_start"]
    targets = cut_lineage(whole.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_start"), "_d", F.explode(F.array(*specs)).alias("t"))
                          .select(*keys, *span, "_d", *[F.col(f"t.{r}").alias(r) for r in ranks]), "ranks")
    while True:
        large = targets.where(F.col("_d") > limit)
        if large.isEmpty():
            break
        # Halves keep the width finite for any two doubles.
        place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bucket = F.least(F.lit(buckets - 1), F.floor(place * buckets)).cast("long")
        parts = (_within(vc, large.select(*keys, *span).distinct(), keys).groupBy(*keys, *span, bucket.alias("_b"))
                 .agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_nlo"), F.max("_v").alias("_nhi"), F.count(F.lit(1)).alias("_nd")))
        upto = Window.partitionBy(*keys, *span).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.withColumn("_end", F.col("_start") + F.sum("_bc").over(upto)).withColumn("_from", F.col("_end") - F.col("_bc"))
        narrowed = (large.drop("_d").join(parts, on=[*keys, *span])
                    .where((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_end")))
                    .select(*keys, F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"), F.col("_from").alias("_start"),
                            F.col("_nd").alias("_d"), *ranks))
        targets = cut_lineage(narrowed.unionByName(targets.where(F.col("_d") <= limit)), "ranks")

    # The values of the last ranges, with the rank range each covers.
    upto = Window.partitionBy(*keys, *span).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (_within(vc, targets.select(*keys, *span).distinct(), keys).groupBy(*keys, *span, "_v").agg(F.sum("_c").alias("_c"))
              .withColumn("_cend", F.col("_start") + F.sum("_c").over(upto)).withColumn("_cbeg", F.col("_cend") - F.col("_c")))
    hits = (targets.drop("_d").join(ranked, on=[*keys, *span])
            .where((F.col("rank") >= F.col("_cbeg")) & (F.col("rank") < F.col("_cend")))
            .select(*keys, *ranks, "_v"))

    # One aggregate per group: the floor/ceil values of every probability, then
    # the same interpolation as Spark's PERCENTILE.
    def pick(i: int, side: str, col: str) -> Column:
        return F.max(F.when((F.col("pid") == i) & (F.col("side") == side), F.col(col)))

    aggs = []
    for i in range(len(names)):
        aggs += [pick(i, "lo", "pos").alias(f"_pos{i}"), pick(i, "lo", "rank").alias(f"_lo{i}"),
                 pick(i, "hi", "rank").alias(f"_hi{i}"), pick(i, "lo", "_v").alias(f"_lov{i}"),
                 pick(i, "hi", "_v").alias(f"_hiv{i}")]
    per_group = hits.groupBy(*keys).agg(*aggs)

    def interpolate(i: int) -> Column:
        pos, lo, hi = F.col(f"_pos{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        lo_v, hi_v = F.col(f"_lov{i}"), F.col(f"_hiv{i}")
        return F.when((hi == lo) | (hi_v == lo_v), lo_v).otherwise(
            (hi.cast("double") - pos) * lo_v + (pos - lo.cast("double")) * hi_v)

    return per_group.select(*keys, *[interpolate(i).alias(name) for i, name in enumerate(names)])


def approx_percentiles(df: DataFrame, keys: list[str], value: str,
                       probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Sketch-based alternative (bounded memory per group, relative rank error 1/accuracy)."""
    names = list(probs)
    arr = F.percentile_approx(F.col(value), [float(probs[n]) for n in names], accuracy)
    return (df.groupBy(*keys).agg(arr.alias("_a"))
            .select(*keys, *[F.col("_a")[i].cast("double").alias(n) for i, n in enumerate(names)]))
