"""Exact percentiles of groups of any size.

``percentile`` keeps all distinct values of a group in one task. Here that is done only for groups of
at most ``DIRECT`` values. In a larger group the two neighbouring order statistics that a
percentile lies between are located by histograms: the range is cut into bins, partial counts are
summed, the bin that holds the wanted place becomes the range, and again, until one value is left. What is
exchanged are counts of bins, never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.sources.staged import staged

#: Values of a group that one task may hold, bins of a histogram, and large groups whose ranges are broadcast.
DIRECT = 1_000_000
BINS = 2048
BROADCAST = 10_000
#: Parts of a large group's rows when there are too many such groups to broadcast.
PARTS = 64


def percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], *others: Column, counted: DataFrame | None = None) -> DataFrame:
    """One row for each group of ``by`` (one row in all without it): the percentiles named in ``probs``, and other aggregates.

    As ``percentile`` does it: places are counted from 0 to n - 1, and a percentile between two
    places is interpolated; nulls don't count, groups without a value have null, NaN is the largest
    value. A null key is a group. ``counted`` may be a cheaper table that has a row for each row of
    ``df`` at least: whether a group can be large is read off it first.
    """
    asked = [F.percentile(value, p).alias(n) for n, p in probs.items()]
    many = (counted if counted is not None else df).groupBy(*by).count().filter(F.col("count") > DIRECT)
    if many.isEmpty():
        return df.groupBy(*by).agg(*asked, *others)
    # Structs of equal fields are equal, nulls included.
    keyed = df.withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0)))
    rows = staged(keyed.select("_g", F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL"), "values")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = staged(sizes.filter(F.col("_n") > DIRECT), "large_groups")
    count = large.count()
    places = _located(rows, large, sorted(set(probs.values())), count)
    found = places.groupBy("_g").agg(*[F.max(F.when(F.col("_p") == p, F.col("_at"))).alias(n) for n, p in probs.items()])
    small = rows.join(F.broadcast(large) if count <= BROADCAST else large, "_g", "left_anti")
    direct = small.groupBy("_g").agg(*[F.percentile("_v", p).alias(n) for n, p in probs.items()])
    every = keyed.groupBy("_g").agg(F.lit(0).alias("_some"), *others)
    return every.join(direct.unionByName(found), "_g", "left").select(*[F.col(f"_g.{k}").alias(k) for k in by], *probs, *[c for c in every.columns if c not in ("_g", "_some")])


def _located(rows: DataFrame, large: DataFrame, probs: list[float], count: int) -> DataFrame:
    """``_g``, ``_p`` and ``_at``, the percentile, for the groups of ``large`` (``_n``, ``_lo``, ``_hi``)."""
    key = ["_g"]
    wanted = large.withColumn("_p", F.explode(F.array(*map(F.lit, probs)))).withColumn("_exact", F.col("_p") * (F.col("_n") - 1))
    # ``_k`` is the place within the range that is left; both neighbours are looked for, one range each.
    ends = F.explode(F.array(F.floor("_exact"), F.ceil("_exact")))
    open_ = wanted.withColumn("_place", ends).select(*key, "_p", "_exact", "_place", F.col("_place").alias("_k"), "_lo", "_hi").distinct()
    open_ = staged(open_, "ranges")
    done = None
    while True:
        settled = open_.filter("_lo = _hi")
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.filter("_lo < _hi")
        if open_.isEmpty():
            break
        if count <= BROADCAST:
            meet = rows.join(F.broadcast(open_), key)
        else:
            parted = open_.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
            meet = rows.withColumn("_part", F.pmod(F.xxhash64("_v", F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")).join(parted, [*key, "_part"])
        meet = meet.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        # Both ends have a bin of their own, so a range always shrinks, infinite ones too.
        bin_ = F.when(F.col("_v") == F.col("_hi"), BINS - 1).when(F.col("_v") == F.col("_lo"), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 2), F.floor(share * (BINS - 2)) + 1)))
        bins = meet.groupBy(*key, "_p", "_exact", "_place", "_k", bin_.alias("_bin")).agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        target = [*key, "_p", "_exact", "_place", "_k"]
        held = F.array_sort(F.collect_list(F.struct("_bin", "_m", "_lo", "_hi")))  # BINS at most
        walk = F.aggregate(F.col("_bins"), F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("struct<m:bigint,lo:double,hi:double,before:bigint>").alias("hit")), lambda a, b: F.struct((a["seen"] + b["_m"]).alias("seen"), F.when(a["hit"].isNull() & (a["seen"] + b["_m"] > F.col("_k")), F.struct(b["_m"].alias("m"), b["_lo"].alias("lo"), b["_hi"].alias("hi"), a["seen"].alias("before"))).otherwise(a["hit"]).alias("hit")))["hit"]
        found = bins.groupBy(*target).agg(held.alias("_bins")).withColumn("_hit", walk)
        open_ = staged(found.select(*key, "_p", "_exact", "_place", (F.col("_k") - F.col("_hit.before")).alias("_k"), F.col("_hit.lo").alias("_lo"), F.col("_hit.hi").alias("_hi")), "ranges")
    part = F.col("_exact") - F.floor("_exact")
    low, high = F.min_by("_lo", "_place"), F.max_by("_lo", "_place")
    return done.groupBy(*key, "_p", "_exact").agg(low.alias("_a"), high.alias("_b")).withColumn("_at", F.when(part == 0, F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b"))).select(*key, "_p", "_at")
