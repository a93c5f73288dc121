"""Exact medians per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from airspan.operators.sizing import GROUP_ROWS, broadcast_if_small, largest_group
from airspan.schemas import name_col
from airspan.session import durable

# Ranks beside the middle, as a share of the rows, that a bracket takes in, and the size of the sketches, whose
# ranks are far nearer than that.
WIDTH, SKETCH = 0.01, 1000
# Ranks that a sketch is asked for.
STEPS = 200


def group_median(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], group_rows: int = GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """One row per group with the exact median of each column, nulls skipped.

    The built-in median holds the distinct values of a group in one task. It is used when the
    largest group is counted to be small enough; otherwise sketches bracket the middle of each group
    until so few values are left. ``largest`` spares the count where it is known already.
    """
    largest = largest_group(df, keys) if largest is None else largest
    if largest <= group_rows:
        return df.groupBy(*keys).agg(*[F.median(F.col(name_col(c))).alias(c) for c in columns])
    return bracketed_median(df, keys, columns, group_rows)


def _unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """(keys, _what, _value) of every value there is, and the columns that ``_what`` names."""
    names = {f"v{i}": c for i, c in enumerate(columns)}
    flat = df.select(*keys, *[F.col(name_col(c)).cast("double").alias(v) for v, c in names.items()])
    return flat.unpivot(list(keys), list(names), "_what", "_value").filter(F.col("_value").isNotNull()), names


def _widened(df: DataFrame, keys: Sequence[str], medians: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per group of ``df``, null where a column has no value, out of (keys, _what, _median)."""
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_what") == v, F.col("_median"))).alias(v) for v in names])
    if not keys:
        return wide.select(*[F.col(v).alias(c) for v, c in names.items()])
    groups = df.select(*keys).distinct().alias("g")
    found = groups.join(
        wide.alias("w"), [F.col(f"g.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], "left")
    return found.select("g.*", *[F.col(f"w.{v}").alias(c) for v, c in names.items()])


def bracketed_median(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], most: int = GROUP_ROWS, width: float = WIDTH,
) -> DataFrame:
    """Median by brackets: a mergeable quantile sketch per group tells between which two values the middle is, one
    pass counts the values below and between, and only those between are looked at again, until a group has at most
    ``most`` different ones left, which are ranked. Sketches and counts are combined before the shuffle,
    so its size does not depend on the rows of a group.

    A bracket that turns out not to hold the middle ranks is not used: the group keeps the one before, and if that stays
    too wide, its values are ranked by ``ranked_median``."""
    keys, most = list(keys), max(most, 1000)
    flat, names = _unpivoted(df, keys, columns)
    group = [*keys, "_what"]
    total = flat.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # NaN is the largest of all values, as in any sort.
    state = durable(total.select(
        *group, "_n", F.lit(float("-inf")).alias("_low"), F.lit(float("nan")).alias("_high"), F.lit(0).cast("long").alias("_below"),
        F.col("_n").alias("_inside"), F.lit(False).alias("_stuck")))
    first, second = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    while not (open_ := state.filter((F.col("_inside") > most) & (F.col("_low") < F.col("_high")) & ~F.col("_stuck"))).isEmpty():
        inside = _inside(flat, open_, group)
        share = lambda rank: (rank - F.col("_below") + F.lit(0.5)) / F.col("_inside")
        step = lambda at: F.greatest(F.lit(0), F.least(F.lit(STEPS), at.cast("int")))
        steps = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
        sketched = inside.filter(~F.isnan("_value")).groupBy(*group).agg(
            F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("_value", F.lit(SKETCH)), steps).alias("_s"))
        # A group that has nothing but NaN has no sketch, and stays as it is.
        # Saved, as a sketch made again need not be the same.
        bounds = durable(open_.alias("o").join(sketched.alias("s"), [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group], "left").select(
            "o.*", F.get("s._s", step(F.floor((share(first) - width) * STEPS))).alias("_from"),
            F.get("s._s", step(F.ceil((share(second) + width) * STEPS))).alias("_to")))
        counted = _inside(flat, bounds, group, "_from", "_to").groupBy(*group).agg(
            F.sum((F.col("_value") < F.col("_from")).cast("long")).alias("_less"),
            F.sum(F.col("_value").between(F.col("_from"), F.col("_to")).cast("long")).alias("_between"))
        joined = bounds.alias("o").join(counted.alias("c"), [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group]).select(
            "o.*", "c._less", "c._between")
        below = F.col("_below") + F.col("_less")
        holds = (below <= first) & (second < below + F.col("_between")) & (F.col("_between") < F.col("_inside"))
        pick = lambda new, old: F.when(holds, new).otherwise(F.col(old)).alias(old)
        moved = joined.select(*group, "_n", pick(F.col("_from"), "_low"), pick(F.col("_to"), "_high"), pick(below, "_below"),
                              pick(F.col("_between"), "_inside"), F.coalesce(~holds, F.lit(True)).alias("_stuck"))
        done = state.filter(~((F.col("_inside") > most) & (F.col("_low") < F.col("_high")) & ~F.col("_stuck")))
        state = durable(done.unionByName(moved))
    wide_ones = state.filter((F.col("_inside") > most) & (F.col("_low") < F.col("_high")))
    single = state.filter(F.col("_low") == F.col("_high")).select(*group, F.col("_low").alias("_median"))
    few = state.filter((F.col("_inside") <= most) & (F.col("_low") < F.col("_high")))
    values = _inside(flat, few, group).groupBy(*group, "_value", "_n", "_below").agg(F.count(F.lit(1)).alias("_times"))
    running = W.partitionBy(*group).orderBy("_value")
    ranked = values.withColumn("_end", F.col("_below") + F.sum("_times").over(running)).withColumn("_start", F.col("_end") - F.col("_times"))
    held = lambda rank: F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_value")))
    medians = single.unionByName(ranked.groupBy(*group).agg(((held(first) + held(second)) / 2).alias("_median")))
    if not wide_ones.isEmpty():
        medians = medians.unionByName(_ranked(_all_of(flat, wide_ones, group), keys))
    return _widened(df, keys, medians, names)


def _all_of(flat: DataFrame, groups: DataFrame, group: Sequence[str]) -> DataFrame:
    own = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)])
    return flat.join(broadcast_if_small(own), [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], "left_semi")


def _inside(flat: DataFrame, bounds: DataFrame, group: Sequence[str], *more: str) -> DataFrame:
    """The values within their group's bracket, with the bracket's columns."""
    own = bounds.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_n", "_low", "_high", "_below", "_inside", *more)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    found = flat.join(broadcast_if_small(own), same).filter(F.col("_value").between(F.col("_low"), F.col("_high")))
    return found.drop(*[f"_g{i}" for i in range(len(group))])


def ranked_median(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median by rank: count equal values, sort them over all tasks, add up counts per sort
    partition, then look only into the one or two partitions that hold the middle ranks."""
    flat, names = _unpivoted(df, keys, columns)
    return _widened(df, keys, _ranked(flat, keys), names)


def _ranked(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _what, _median) of (keys, _what, _value)."""
    counted = flat.groupBy(*keys, "_what", "_value").agg(F.count(F.lit(1)).alias("_n"))
    group = [*keys, "_what"]
    placed = durable(
        counted.repartitionByRange(*group, "_value").withColumn("_part", F.spark_partition_id()))
    segments = placed.groupBy(*group, "_part").agg(F.sum("_n").alias("_in_part"))
    in_group = W.partitionBy(*group)
    before = in_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    middle = (
        segments
        .withColumn("_before", F.coalesce(F.sum("_in_part").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_in_part").over(in_group))
        .withColumn("_low", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_high", F.floor(F.col("_total") / 2))
        .filter("_before <= _high and _before + _in_part > _low")
    )
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*group, "_part"]]
    running = W.partitionBy(*group, "_part").orderBy("_value")
    candidates = (
        placed.alias("p").join(middle.alias("m"), same)
        .select("p.*", "_before", "_low", "_high")
        .withColumn("_end", F.col("_before") + F.sum("_n").over(running))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    holds = lambda rank: (F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_end"))
    return candidates.groupBy(*group).agg(
        ((F.max(F.when(holds("_low"), F.col("_value")))
          + F.max(F.when(holds("_high"), F.col("_value")))) / 2).alias("_median"))
