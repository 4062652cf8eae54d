"""Operators on seed, marker, cluster and run-log tables and on score columns."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxarbor.functions.storage import materialise


def trimmed(df: DataFrame, score: str, deviations: float = 2.0) -> DataFrame:
    """Rows within so many sample deviations of the mean."""
    s = df.agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    return df.crossJoin(F.broadcast(s)).where(F.abs(F.col(score) - F.col("_m")) <= deviations * F.col("_s")).drop("_m", "_s")


def t_statistic(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Two-sample t of rows where `first` holds against the others: pooled variance if the
    larger variance is under 4 times the smaller, else Welch's; with degrees of freedom."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = df.agg(F.count(a).alias("n"), F.count(b).alias("m"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    n, m, va, vb = F.col("n"), F.col("m"), F.col("va"), F.col("vb")
    ratio = F.greatest(va, vb) / F.least(va, vb)
    pooled = ((n - 1) * va + (m - 1) * vb) / (n + m - 2)
    sa, sb = va / n, vb / m
    equal = ratio < 4
    t = (F.col("ma") - F.col("mb")) / F.sqrt(F.when(equal, pooled * (1 / n + 1 / m)).otherwise(sa + sb))
    welch = (sa + sb) * (sa + sb) / (sa * sa / (n - 1) + sb * sb / (m - 1))
    return s.select(t.alias("t"), F.when(equal, (n + m - 2).cast("double")).otherwise(welch).alias("df"), equal.alias("equal_variance"))


def clusters_of(text: DataFrame, line: str = "line") -> DataFrame:
    """Cluster lines `zmin,zmax,ymin,ymax,xmin,xmax,n,[z,y,x,mass]*` as one row per soma."""
    f = F.split(F.col(line), ",")
    rows = text.where(~F.col(line).startswith("#")).withColumn("f", f).withColumn("n", F.col("f")[6].cast("int"))
    names = ("zmin", "zmax", "ymin", "ymax", "xmin", "xmax")
    rows = rows.withColumn("k", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))))
    soma = [F.element_at("f", F.col("k") * 4 + 8 + i).cast("int").alias(c) for i, c in enumerate(("z", "y", "x", "mass"))]
    return rows.select(*(F.col("f")[i].cast("int").alias(c) for i, c in enumerate(names)), "k", *soma)


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: IoU, precision and recall, by one grouped count of the confusion table."""
    c = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    e = c.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("pos"), F.lit(0).cast("long").alias("found"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("pos"), F.col("n").alias("found"), F.lit(0).cast("long").alias("tp")))).alias("r")).select("r.*")
    s = e.groupBy("class").agg(*(F.sum(x).alias(x) for x in ("pos", "found", "tp")))
    tp, pos, found = F.col("tp"), F.col("pos"), F.col("found")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return s.select("class", part(tp, pos + found - tp).alias("iou"), part(tp, found).alias("precision_"), part(tp, pos).alias("recall"))


def numbered(df: DataFrame, *by: str, name: str = "idx") -> DataFrame:
    """df with 0, 1, 2, ... in the order of `by`: ranges are dealt to tasks, ranked there, and
    moved by the counts of the ranges before."""
    placed = materialise(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    placed = placed.withColumn("_rank", rank).join(F.broadcast(counts.select("_part", "_before")), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_part", "_rank", "_before")


def merged_mass(parts: DataFrame) -> DataFrame:
    """(comp, mass, x, y, z) from partial masses and centres of chunks, weighted by mass."""
    mean = [(F.sum(F.col(a) * F.col("mass")) / F.sum("mass")).alias(a) for a in ("x", "y", "z")]
    return parts.groupBy("comp").agg(F.sum("mass").alias("mass"), *mean)


def cumulative_histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n, share): counts of bins of a width and the share of rows up to each bin."""
    bins = df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    total = Window.partitionBy(F.lit(0))
    return bins.select("bin", "n", (F.sum("n").over(upto) / F.sum("n").over(total)).alias("share"))


class PolynomialDistribution:
    """An angle's distribution on [0, pi]: a polynomial of the scaled angle, normalised; read
    from JSON entries {key: {coefficients, mean, std}}, coefficients from the highest power."""

    def __init__(self, coefficients: list[float], mean: float, std: float):
        self.mean, self.std = mean, std
        order = range(len(coefficients) - 1, -1, -1)
        whole = [c / (k + 1) for c, k in zip(coefficients, order, strict=True)] + [0.0]
        low, high = (self._at(whole, (v - mean) / std) for v in (0.0, math.pi))
        self.density = [c / (high - low) for c in coefficients]
        self.below = [c / (high - low) for c in whole]
        self.below[-1] = -low / (high - low)

    @classmethod
    def from_json(cls, text: str, key: str) -> PolynomialDistribution:
        entries = json.loads(text)
        if key not in entries:
            raise ValueError(f"no distribution for {key}")
        e = entries[key]
        return cls(e["coefficients"], e["mean"], e["std"])

    @staticmethod
    def _at(coefficients: list[float], x):
        out = x * 0.0
        for c in coefficients:
            out = out * x + c
        return out

    def scaled(self, angle: Column) -> Column:
        return (angle - self.mean) / self.std

    def pdf(self, angle: Column) -> Column:
        return self._at(self.density, self.scaled(angle))

    def cdf(self, angle: Column) -> Column:
        return self._at(self.below, self.scaled(angle))

    def tail(self, angle: Column) -> Column:
        """P(X >= angle)."""
        return F.lit(1.0) - self.cdf(angle)
