"""Chart arithmetic over points (chart, grp, ser, idx, v): stacks, shares, axes, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import nice_axis


def percent_stack(points: DataFrame, chart: list[str], category: str, value: str) -> DataFrame:
    """Adds share: a value over the absolute sum of its category."""
    total = F.sum(F.abs(value)).over(W.partitionBy(*chart, category))
    return points.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(F.col(value)))


def stack_bands(points: DataFrame, chart: list[str], category: str, series: str, value: str) -> DataFrame:
    """Adds v0 and v1: where a bar begins and ends on those of its sign below it."""
    side = W.partitionBy(*chart, category, F.col(value) >= 0).orderBy(series)
    below = F.coalesce(F.sum(value).over(side.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return points.where(F.col(value).isNotNull()).withColumns({"v0": below, "v1": F.sum(value).over(side.rowsBetween(W.unboundedPreceding, 0))})


def value_axis(points: DataFrame, chart: list[str], category: str, value: str, stacked: bool) -> DataFrame:
    """lo, hi and the nice axis of each chart; zero is always within."""
    if stacked:
        points = points.groupBy(*chart, category).agg(F.sum(F.when(F.col(value) >= 0, F.col(value)).otherwise(0.0)).alias("_hi"), F.sum(F.when(F.col(value) < 0, F.col(value)).otherwise(0.0)).alias("_lo"))
        extent = points.groupBy(*chart).agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    else:
        extent = points.groupBy(*chart).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    zero = F.lit(0.0)
    extent = extent.withColumns({"lo": F.least("lo", zero), "hi": F.greatest("hi", zero)})
    return extent.withColumn("_n", nice_axis(F.col("lo"), F.col("hi"))).select(*chart, "lo", "hi", "_n.*")


def trend(points: DataFrame, series: list[str], x: Column, value: str) -> DataFrame:
    """Slope and intercept of least squares; null with one point or one x."""
    return points.groupBy(*series).agg(F.regr_slope(F.col(value), x).alias("slope"), F.regr_intercept(F.col(value), x).alias("intercept"))


def pie(points: DataFrame, chart: list[str], order: str, value: str, first_angle: float = 0.0) -> DataFrame:
    """Slices of positive values: share, from and to in degrees."""
    alive = points.where(F.col(value) > 0)
    all_ = W.partitionBy(*chart)
    upto = all_.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(value).over(all_)
    to = F.sum(value).over(upto) / total * 360 + first_angle
    sweep = F.col(value) / total * 360
    return alive.withColumns({"share": F.col(value) / total, "angle_from": to - sweep, "angle_to": to})
