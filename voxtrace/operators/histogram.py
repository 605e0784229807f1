"""Equal-width histograms, Otsu thresholds and contrast stretching.

Where the bins are known beforehand, rows are binned map-side, so a task hands on at most one row
per bin and key. Where the range of a key sets the bins (Otsu), one pass takes the ranges and a
second one counts in bins: each half of a bin by itself, since the threshold is the centre of a
bin, so what lies above a threshold follows from those counts as well. Whole numbers with a bin
of their own are counted per (keys, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtrace.session import stage


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value within [low, high]; the last bin is closed on the right."""
    scaled = (value - low) / (high - low) * bins
    return F.least(F.floor(scaled), F.lit(bins - 1)).cast("bigint")


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """(bin, low_edge, high_edge, count, frequency) over the data range or a given one.

    Values outside a given range are dropped; a constant input widens the range by one half
    on each side.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    if (low is None) != (high is None):
        raise ValueError("give both ends of the range or neither")
    v = F.col(value).cast("double")
    if low is None:
        ends = df.agg(F.struct(F.min(v).alias("least"), F.max(v).alias("most"))).scalar()
    else:
        ends = F.struct(F.lit(float(low)).alias("least"), F.lit(float(high)).alias("most"))
    least, most = F.col("_ends.least"), F.col("_ends.most")
    half = F.when(least == most, 0.5).otherwise(0.0)
    ranged = (
        df.select(v.alias("value"))
        .where("value is not null")
        .withColumn("_ends", ends)
        .select("value", (least - half).alias("_lo"), (most + half).alias("_hi"))
        .where(F.col("value").between(F.col("_lo"), F.col("_hi")))
    )
    filled = (
        ranged.withColumn("bin", bin_number(F.col("value"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy("bin")
        .agg(F.count("*").alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    )
    # One row per bin from here on.
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    whole = Window.partitionBy()
    first, last = F.max("_lo").over(whole), F.max("_hi").over(whole)
    if low is not None:
        # the edges of a given range do not depend on what lies in it
        widened = 0.5 if low == high else 0.0
        first, last = F.lit(float(low) - widened), F.lit(float(high) + widened)
    width = (last - first) / bins
    total = F.sum("count").over(whole)
    share = F.try_divide(F.col("count").cast("double"), total)
    return (
        every.join(filled, "bin", "left")
        .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
        .withColumn("low_edge", first + F.col("bin") * width)
        .withColumn("high_edge", first + (F.col("bin") + 1) * width)
        .withColumn("frequency", share if low is None else F.coalesce(share, F.lit(0.0)))
        .select("bin", "low_edge", "high_edge", "count", "frequency")
    )


def binned_counts(
    df: DataFrame, keys: Sequence[str], value: str, bins: int | None = 256, eligible: Column | None = None
) -> DataFrame:
    """(keys, bin, upper, positive, n, low, high): counts of values by half of a bin.

    The range of a key is that of its ``eligible`` values (of column ``value``); others have no
    bin. ``upper`` marks values above the centre of their bin; with ``bins`` None a bin is one
    whole number, and none is above it.
    """
    names = list(keys)
    v = F.col("value")
    chosen = v.isNotNull() if eligible is None else v.isNotNull() & eligible
    rows = df.select(*names, F.col(value).cast("double").alias("value")).where("value is not null")
    if bins is None:
        rows = rows.groupBy(*names, "value").agg(F.count("*").alias("_n"))
    else:
        rows = rows.withColumn("_n", F.lit(1).cast("bigint"))
    ends = [F.min(F.when(chosen, v)).alias("low"), F.max(F.when(chosen, v)).alias("high")]
    if names:
        # written out, so that its size is known where the join with all rows is planned
        ranges = stage(rows.groupBy(*names).agg(*ends), "otsu_ranges")
        ranged = rows.join(ranges, names)
    else:
        one = rows.agg(F.struct(*ends)).scalar()
        ranged = rows.withColumn("_r", one).select("value", "_n", "_r.*")
    low, high = F.col("low"), F.col("high")
    if bins is None:
        number, upper = (v - low).cast("bigint"), F.lit(False)
    else:
        number = F.when(low == high, F.lit(0).cast("bigint")).otherwise(bin_number(v, low, F.nullif(high, low), bins))
        upper = (low < high) & (v > bin_centre(number, low, high, bins))
    return ranged.groupBy(
        *names,
        F.when(chosen, number).alias("bin"),
        F.when(chosen, upper).alias("upper"),
        (v > 0).alias("positive"),
        "low",
        "high",
    ).agg(F.sum("_n").alias("n"))


def bin_centre(number: Column, low: Column, high: Column, bins: int | None) -> Column:
    if bins is None:
        return number + low
    return F.when(low == high, low).otherwise(low + (number + 0.5) * (high - low) / bins)


def otsu_from_bins(counted: DataFrame, keys: Sequence[str], bins: int | None = 256) -> DataFrame:
    """Otsu threshold per key from ``binned_counts``: ``threshold``, its bin, ``min``, ``max``, ``n``.

    The threshold is the centre of the bin that maximises the between-class variance, the first
    one on ties; a constant input gives its own value.
    """
    names = list(keys)
    binned = counted.where("bin is not null").groupBy(*names, "low", "high", "bin").agg(F.sum("n").alias("n"))
    # One window per key over its bins: at most ``bins`` rows, or one per whole number.
    ordered = Window.partitionBy(*names).orderBy("bin")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*names)
    moments = (
        binned.withColumn("_w1", F.sum("n").over(up_to))
        .withColumn("_s1", F.sum(F.col("n") * F.col("bin")).over(up_to))
        .withColumn("_s", F.sum(F.col("n") * F.col("bin")).over(whole))
        .withColumn("total", F.sum("n").over(whole))
    )
    w1, s1 = F.col("_w1").cast("double"), F.col("_s1").cast("double")
    w2 = (F.col("total") - F.col("_w1")).cast("double")
    s2 = (F.col("_s") - F.col("_s1")).cast("double")
    gap = s1 / w1 - s2 / F.nullif(w2, F.lit(0.0))
    spread = F.coalesce(w1 * w2 * gap * gap, F.lit(-1.0))
    best = moments.groupBy(*names).agg(
        F.max_by("bin", F.struct(spread, -F.col("bin"))).alias("threshold_bin"),
        F.max("low").alias("min"),
        F.max("high").alias("max"),
        F.max("total").alias("n"),
    )
    centre = bin_centre(F.col("threshold_bin"), F.col("min"), F.col("max"), bins)
    return best.select(*names, centre.alias("threshold"), "threshold_bin", "min", "max", "n")


def otsu_threshold(
    df: DataFrame, keys: Sequence[str], value: str, bins: int | None = 256
) -> DataFrame:
    """threshold, min, max and n per key: ``bins`` equal bins, or None for one per whole number."""
    return otsu_from_bins(binned_counts(df, keys, value, bins), keys, bins).drop("threshold_bin")


def above_threshold() -> Column:
    """Whether the values of a row of ``split_counts`` exceed the threshold of their key."""
    number, best = F.col("bin"), F.col("threshold_bin")
    return F.coalesce((number > best) | ((number == best) & F.col("upper")), F.lit(False))


def split_counts(
    df: DataFrame, keys: Sequence[str], value: str, bins: int | None = 256, eligible: Column | None = None
) -> DataFrame:
    """``binned_counts`` with the Otsu threshold, its bin, min and max of their key beside them.

    The threshold is that of the ``eligible`` values; all others must lie below their range. What
    lies above a threshold follows from these rows, without going back to the data.
    """
    counted = binned_counts(df, keys, value, bins, eligible)
    if keys:
        counted = stage(counted, "otsu_counts")
    found = otsu_from_bins(counted, keys, bins).drop("n")
    return counted.drop("low", "high").join(found, list(keys))


# Fixed values of the contrast stretch: 255 unit bins over 0..255, one percent cut on each
# side, and 0.5 added before the cut at the top.
STRETCH_TOP = 255
STRETCH_TOLERANCE = 1


def stretch_limits(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lower and upper limit per key: first bin whose cumulative count reaches 1 % and 99 %."""
    v = F.col(value).cast("double")
    inside = F.when(v.between(0, STRETCH_TOP), F.least(F.floor(v), F.lit(STRETCH_TOP - 1)).cast("bigint"))
    # values outside the bins only count for the total: they are one more row per key, without a bin
    counted = (
        df.where(v.isNotNull()).groupBy(*keys, inside.alias("bin")).agg(F.count("*").alias("n"))
    )
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    bins = counted.where("bin is not null")
    up_to = (
        Window.partitionBy(*keys)
        .orderBy("bin")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = bins.withColumn("cum", F.sum("n").over(up_to)).join(totals, list(keys))
    low_bound = F.col("total") * STRETCH_TOLERANCE / 100
    high_bound = F.col("total") * (100 - STRETCH_TOLERANCE) / 100
    return reached.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("cum") >= low_bound, F.col("bin"))), F.lit(STRETCH_TOP))
        .cast("double")
        .alias("low_limit"),
        F.coalesce(F.min(F.when(F.col("cum") >= high_bound, F.col("bin"))), F.lit(STRETCH_TOP))
        .cast("double")
        .alias("high_limit"),
    )


def contrast_stretch(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Linear stretch between the limits; capped at the top only.

    Equal limits leave nothing to stretch: values above the limit go to the top.
    """
    low, high, v = F.col("low_limit"), F.col("high_limit"), F.col(value)
    span = F.nullif(high - low, F.lit(0.0))
    raised = F.when(v < low, 0.0).otherwise(v - low)
    stretched = F.when(
        span.isNull(), F.when(raised > 0, float(STRETCH_TOP)).otherwise(0.5)
    ).otherwise(raised * (F.lit(float(STRETCH_TOP)) / span) + 0.5)
    return (
        df.join(stretch_limits(df, keys, value), list(keys))
        .withColumn(out, F.least(stretched, F.lit(float(STRETCH_TOP))))
        .drop("low_limit", "high_limit")
    )
