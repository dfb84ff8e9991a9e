"""Timing, cost and two-sample statistics over trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.student import t_p_value, t_quantile

#: Dollars for each millisecond of a function of 128 MB, and the size of one over that.
RATE, MEMORY = 2.1e-9, 2.0

#: The largest problems that drivers take without a complaint.
LARGEST = {"mergesort": 32000, "fibonacci": 25}


def too_large(algorithm: Column, n: Column) -> Column:
    """Whether a trial's problem is larger than its algorithm should be given; it is reported, not refused. Others: false."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in LARGEST.items() for x in kv)), algorithm)
    return F.coalesce(n > limit, F.lit(False))


def micros(ts: Column) -> Column:
    """A timestamp, with or without a zone, as microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def cost_by_ms(seconds: Column) -> Column:
    return seconds * 1000 * RATE * MEMORY


def cost_by_minute(seconds: Column) -> Column:
    """The older formula; 60,000 times less."""
    return seconds / 60 * RATE * MEMORY


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, total, least, greatest and mean of task durations."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def described(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, population standard deviation and sample variance."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_samp(value).alias("var"))


def std_by_squares(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The sample standard deviation from the sum of squares; null for a single value."""
    v = F.col(value)
    got = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v * v).alias("squares"))
    return got.select(*by, "n", F.sqrt(F.try_divide(F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.col("n") - 1)).alias("std"))


def samples(df: DataFrame, system: str, value: str, first: str, second: str, *by: str) -> DataFrame:
    """n, mean and variance of two systems side by side, for each group that has both: one aggregation, no join of rows."""
    one, two = (F.when(F.col(system) == s, F.col(value)) for s in (first, second))
    aggs = [f(x).alias(f"{n}{i}") for i, x in ((1, one), (2, two)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))]
    return df.where(F.col(system).isin(first, second)).groupBy(*by).agg(*aggs).where("n1 > 1 AND n2 > 1")


def _a() -> Column:
    return F.col("s1") / F.col("n1")


def _b() -> Column:
    return F.col("s2") / F.col("n2")


def welch_df() -> Column:
    return F.try_divide((_a() + _b()) * (_a() + _b()), _a() * _a() / (F.col("n1") - 1) + _b() * _b() / (F.col("n2") - 1))


def unpaired_df() -> Column:
    """The older form: two less."""
    return welch_df() - 2


def welch_t() -> Column:
    return F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(_a() + _b()))


def pooled_std() -> Column:
    return F.sqrt(((F.col("n1") - 1) * F.col("s1") + (F.col("n2") - 1) * F.col("s2")) / (F.col("n1") + F.col("n2") - 2))


def intervals(both: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Test and confidence interval of the difference of means. The interval takes Welch's degrees of freedom and the pooled
    deviation, as the published figures do."""
    got = both.withColumn("df", welch_df()).withColumn("t", welch_t()).withColumn("t_crit", t_quantile(1 - alpha / 2, F.col("df")))
    half = F.col("t_crit") * F.sqrt(1 / F.col("n1") + 1 / F.col("n2")) * pooled_std()
    diff = F.col("m1") - F.col("m2")
    got = got.withColumn("p", t_p_value(F.col("t"), F.col("df"))).withColumn("low", diff - half).withColumn("high", diff + half)
    return got.withColumn("ci", F.format_string("[%.3f,%.3f]", "low", "high"))


def unpaired(both: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The interval from unpooled deviations, and whether it contains zero: then the systems don't differ."""
    got = both.withColumn("df", unpaired_df()).withColumn("t_crit", t_quantile(1 - alpha / 2, F.col("df")))
    half, diff = F.col("t_crit") * F.sqrt(_a() + _b()), F.col("m1") - F.col("m2")
    got = got.withColumn("low", diff - half).withColumn("high", diff + half)
    return got.withColumn("contains_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


def pivot_wide(df: DataFrame, row: str, column: str, values: list, cell: Column) -> DataFrame:
    """One column for each of the values that are given, so that no pass looks for them."""
    return df.groupBy(row).pivot(column, values).agg(cell)


def union_trials(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
