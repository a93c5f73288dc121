"""Bagged nearest neighbours over whole-number features, for several targets at once."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from functools import reduce
from math import e, factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from airspan.llm.groups import map_group_batches
from airspan.schemas import name_col
from airspan.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BAGS = 10
NEIGHBOURS = 5
# Radii within which whole blocks of points are compared in tasks, the points that a block should have, and the distances
# that a task holds at a time.
BLOCK_RADII, BLOCK_POINTS, DISTANCES = (4, 16), 5_000, 1 << 19


def _times_drawn(seed: int, bag: int, keys: Sequence[str]):
    """How often a row is in a bag: Poisson with mean one, from a hash of the row's key, so the
    same wherever and whenever the row is read."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(bag), *[F.col(name_col(k)) for k in keys]), F.lit(10**9))
    reached, times = 0.0, F.lit(0)
    for n in range(12):
        reached += 1 / (e * factorial(n))
        times = times + F.when(drawn >= int(reached * 10**9), 1).otherwise(0)
    return times.cast("double")


class NearestModel:
    """Training rows, collapsed to one line per distinct feature point, with how often each bag has it (``n``). ``sums`` has the
    targets' sums of each bag, one after the other; of a single row, which most points are, its targets are enough."""

    def __init__(
        self, points: DataFrame, features: Sequence[str], n_targets: int, bags: int = BAGS, k: int = NEIGHBOURS
    ):
        self.points, self.features, self.n_targets = points, list(features), n_targets
        self.bags, self.k = bags, k

    @classmethod
    def fit(
        cls, train: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str],
        bags: int = BAGS, k: int = NEIGHBOURS, seed: int = 42,
    ) -> "NearestModel":
        """One aggregate: equal points meet before the shuffle, however many rows they have."""
        at = [F.col(c).cast("long").alias(f"f{i}") for i, c in enumerate(features)]
        times = [_times_drawn(seed, b, keys) for b in range(bags)]
        values = [F.col(name_col(t)).cast("double") for t in targets]
        grouped = train.groupBy(*at).agg(
            F.count(F.lit(1)).alias("_rows"), F.array(*[F.sum(n) for n in times]).alias("_n"), F.array(*[F.max(v) for v in values]).alias("_one"),
            F.array(*[F.sum(n * v) for n in times for v in values]).alias("_sums"))
        points = grouped.select(
            *[f"f{i}" for i in range(len(features))], F.transform("_n", lambda n: n.cast("int")).alias("n"),
            F.when(F.col("_rows") == 1, F.col("_one")).otherwise(F.col("_sums")).alias("sums")).filter(F.exists("n", lambda n: n > 0))
        return cls(durable(points), features, len(targets), bags, k)

    def _by_bag(self) -> DataFrame:
        """(point, bag, n, sums): a line for each bag that has the point."""
        dims, k = [f"f{i}" for i in range(len(self.features))], self.n_targets
        own = F.when(F.size("sums") == k, F.transform("sums", lambda v: v * F.col("n"))).otherwise(
            F.slice("sums", F.col("bag") * k + 1, F.lit(k)))
        return self.points.select(*dims, "sums", F.posexplode("n").alias("bag", "n")).filter("n > 0").select(
            *dims, "bag", F.col("n").cast("double").alias("n"), own.alias("sums"))

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        """Adds an array with a prediction per target, the mean over the bags."""
        at = [f"f{i}" for i in range(len(self.features))]
        asked = df.select(*[
            F.col(c).cast("long").alias(f"q{i}") for i, c in enumerate(self.features)]).distinct()
        answers = self._answers(durable(asked)).select(
            *[F.col(f"q{i}").alias(f"_{a}") for i, a in enumerate(at)], F.col("mean").alias(output))
        same = [F.col(c) == F.col(f"_{a}") for c, a in zip(self.features, at)]
        return df.join(answers, same, "left").drop(*[f"_{a}" for a in at])

    def _answers(self, asked: DataFrame) -> DataFrame:
        """Asked points meet the training points of their block and around it, and a task finds the nearest of all bags: no pair
        reaches a shuffle. For those with too few rows within these radii the search goes on in blocks as wide as the radius, which
        doubles. Within a radius the answer is exact, so no point is compared with all others."""
        dims = range(len(self.features))
        spans = self.points.agg(*[F.min(f"f{i}") for i in dims], *[F.max(f"f{i}") for i in dims])
        asked_spans = asked.agg(*[F.min(f"q{i}") for i in dims], *[F.max(f"q{i}") for i in dims])
        here, there = spans.first(), asked_spans.first()
        n = len(self.features)
        if here[0] is None or there[0] is None:
            return self._mean(asked.withColumn("bag", F.lit(0)).withColumn(
                "sums", F.lit(None).cast("array<double>")).withColumn("rows", F.lit(0.0)))
        done = []
        for radius in BLOCK_RADII:
            found = durable(self._in_blocks(asked, radius, here, there))
            done.append(found.filter("mean is not null"))
            asked = found.filter("mean is null").drop("mean")
        if not asked.isEmpty():
            done.append(self._around(asked, here, there, 2 * BLOCK_RADII[-1]))
        return reduce(DataFrame.unionByName, done)

    def _in_blocks(self, asked: DataFrame, radius: int, here, there) -> DataFrame:
        """(asked point, mean): null where some bag has too few rows within the radius. Blocks cut the widest features first,
        until they have few points each."""
        n, k, n_targets, bags, width = len(self.features), self.k, self.n_targets, self.bags, 4 * radius
        total, cut, blocks = self.points.count(), [], 1
        for i in sorted(range(n), key=lambda i: here[i] - here[n + i]):
            if blocks * BLOCK_POINTS >= total or here[n + i] - here[i] < width:
                break
            cut.append(i)
            blocks *= (here[n + i] - here[i]) // width + 1
        group, stride = F.lit(0).cast("long"), 1
        for i in cut:
            low = min(here[i] - radius, there[i]) // width
            group = group + (F.col(f"_b{i}") - low) * F.lit(stride)
            stride *= max(here[n + i] + radius, there[n + i]) // width - low + 1
        at = [f"f{i}" for i in range(n)]
        points, asked = self.points.withColumn("asked", F.lit(False)), asked.select(
            *[F.col(f"q{i}").alias(f"f{i}") for i in range(n)], F.lit(True).alias("asked"))
        for i in cut:
            first, last = (F.floor((F.col(f"f{i}") + d) / width) for d in (-radius, radius))
            points = points.withColumn(f"_b{i}", F.explode(F.sequence(first, last)))
            asked = asked.withColumn(f"_b{i}", F.floor(F.col(f"f{i}") / width))
        rows = points.unionByName(asked, allowMissingColumns=True).select(group.alias("group"), "asked", *at, "n", "sums")

        def each(rows: pa.RecordBatch) -> pa.RecordBatch | None:
            place = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in at], axis=1)
            is_asked, keys = rows.column("asked").to_numpy(zero_copy_only=False), rows.column("group").to_numpy(zero_copy_only=False)
            known = rows.filter(pa.array(~is_asked))
            drawn = known.column("n").flatten().to_numpy(zero_copy_only=False).reshape(-1, bags).astype(np.float64)
            # Means by bag and target; a single row has the same in all bags.
            means, sizes = np.zeros((len(drawn), bags, n_targets)), known.column("sums").value_lengths().to_numpy(zero_copy_only=False)
            flat = known.column("sums").flatten().to_numpy(zero_copy_only=False)
            begins, one = np.cumsum(sizes) - sizes, sizes == n_targets
            means[one] = flat[begins[one][:, None] + np.arange(n_targets)][:, None, :]
            many = flat[begins[~one][:, None] + np.arange(bags * n_targets)].reshape(-1, bags, n_targets)
            means[~one] = many / np.maximum(drawn[~one], 1)[:, :, None]
            of_point = np.cumsum(~is_asked) - 1
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                q = place[a:b][is_asked[a:b]]
                p = np.flatnonzero(~is_asked[a:b]) + a
                if len(q):
                    p = p[np.lexsort(place[p].T[::-1])]  # ties go to the smaller point
                    found.append((q, *nearest(q, place[p], drawn[of_point[p]], means[of_point[p]], k, radius)))
            if not found:
                return None
            q, mean, whole = (np.concatenate(part) for part in zip(*found))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * n_targets), mean.reshape(-1), mask=pa.array(~whole))
            return pa.RecordBatch.from_arrays([*[pa.array(q[:, i]) for i in range(n)], lists], [*[f"q{i}" for i in range(n)], "mean"])

        return map_group_batches(rows, each, f"{', '.join(f'q{i} long' for i in range(n))}, mean array<double>")

    def _around(self, asked: DataFrame, here, there, radius: int) -> DataFrame:
        """The same in blocks as wide as the radius, for points with few rows around."""
        dims, n = range(len(self.features)), len(self.features)
        points = durable(self._by_bag())
        widest = sum((max(here[n + i], there[n + i]) - min(here[i], there[i])) ** 2 for i in dims)
        open_points = asked.withColumn("bag", F.explode(F.array(*[F.lit(b) for b in range(self.bags)])))
        done = []
        while True:
            found = durable(self._within(points, open_points, radius))
            last = radius * radius >= widest
            done.append(found if last else found.filter(F.col("rows") >= self.k))
            if last:
                break
            key = [*[f"q{i}" for i in dims], "bag"]
            open_points = durable(open_points.join(
                found.filter(F.col("rows") >= self.k).select(*key), key, "left_anti"))
            if open_points.isEmpty():
                break
            radius *= 2
        return self._mean(reduce(DataFrame.unionByName, done))

    def _within(self, points: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
        """(asked point, bag, rows taken, sums): the nearest rows not further than the radius."""
        dims = range(len(self.features))
        rows = asked
        for i in dims:
            block = F.floor(F.col(f"q{i}") / radius)
            rows = rows.withColumn(f"_b{i}", F.explode(F.array(block - 1, block, block + 1)))
        blocks = points.select(
            "*", *[F.floor(F.col(f"f{i}") / radius).alias(f"_b{i}") for i in dims])
        distance = sum((F.col(f"q{i}") - F.col(f"f{i}")) * (F.col(f"q{i}") - F.col(f"f{i}")) for i in dims)
        near = rows.join(blocks, ["bag", *[f"_b{i}" for i in dims]]).withColumn("_d", distance)
        key = [*[f"q{i}" for i in dims], "bag"]
        closest = W.partitionBy(*key).orderBy("_d", *[f"f{i}" for i in dims])
        taken = F.least(F.col("n"), self.k - (F.sum("n").over(closest) - F.col("n")))
        return (
            near.filter(F.col("_d") <= radius * radius)
            .withColumn("_take", taken).filter("_take > 0")
            .groupBy(*key).agg(
                F.sum("_take").alias("rows"),
                F.array(*[
                    F.sum(F.col("_take") * F.col("sums")[t] / F.col("n")) for t in range(self.n_targets)
                ]).alias("sums"))
        )

    def _mean(self, found: DataFrame) -> DataFrame:
        dims = range(len(self.features))
        return found.groupBy(*[f"q{i}" for i in dims]).agg(F.array(*[
            F.avg(F.col("sums")[t] / F.col("rows")) for t in range(self.n_targets)]).alias("mean"))

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        about = json.dumps({
            "features": self.features, "n_targets": self.n_targets, "bags": self.bags, "k": self.k})
        self.points.sparkSession.createDataFrame([(about,)], "value string").write.mode(
            "overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NearestModel":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        return cls(spark.read.parquet(f"{path}/points"), **about)


def nearest(q: np.ndarray, p: np.ndarray, n: np.ndarray, means: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean over the bags of the k nearest rows of each asked point, and whether all bags have so many within the radius.
    Points ``p`` stand in the order that ties go by."""
    out, whole = np.zeros((len(q), means.shape[2])), np.zeros(len(q), bool)
    rows = max(1, DISTANCES // max(1, len(p)))
    for begin in range(0, len(q), rows):
        left, most = np.arange(begin, min(begin + rows, len(q))), 8 * k
        while len(left) and len(p):
            distance = np.zeros((len(left), len(p)), np.int64)
            for i in range(q.shape[1]):
                distance += (q[left, i][:, None] - p[:, i]) ** 2
            order = np.where(distance <= radius * radius, distance, radius * radius + 1) * len(p) + np.arange(len(p))
            if most < len(p):
                order = np.partition(order, most - 1, axis=1)[:, :most]
            order.sort(axis=1)
            near, at = order // len(p) <= radius * radius, order % len(p)
            rows_of = np.where(near[:, :, None], n[at], 0.0)
            before = np.cumsum(rows_of, axis=1) - rows_of
            take = np.clip(k - before, 0, rows_of)
            full = (take.sum(axis=1) >= k).all(axis=1)
            ready = np.flatnonzero(full)
            out[left[ready]] = np.einsum("qpb,qpbt->qt", take[ready], means[at[ready]]) / (k * n.shape[1])
            whole[left[ready]] = True
            # Those that have more points within the radius go on with more of them.
            left = left[~full & near[:, -1]] if most < len(p) else left[:0]
            most *= 8
    return out, whole
