"""The data behind charts: histograms, quantiles, fits and thinned series; drawing is left to others."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewright.functions.safe import finite
from tidewright.operators.portfolio import drawdown
from tidewright.operators.quantiles import exact_quantiles


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal bins between the least and the largest finite value, empty bins too.

    The largest value belongs to the last bin; one distinct value fills the first bin of width 0.
    """
    v = finite(F.col(value).cast("double"))
    rows = df.select(v.alias("v")).where("v is not null")
    span = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(F.broadcast(span)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(span)).where("a is not null")
    step = (F.col("b") - F.col("a")) / bins
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("a") + F.col("bin") * step).alias("low"), (F.col("a") + (F.col("bin") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def quartiles(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, q1, q2, q3, low, high) of the finite values of each group, exact."""
    found = exact_quantiles(df, groups, value, (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.select(*groups, "n", *[F.col("quantiles")[i].alias(c) for i, c in ((1, "q1"), (2, "q2"), (3, "q3"), (0, "low"), (4, "high"))])


def moments(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, sample deviation, population skewness and excess kurtosis."""
    v = finite(F.col(value))
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))


def every_kth(df: DataFrame, order: str, k: int) -> DataFrame:
    """Every k-th row of a short series (one row for a period), from the first."""
    return df.withColumn("_n", F.row_number().over(Window.orderBy(order))).where((F.col("_n") - 1) % k == 0).drop("_n")


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def trade_summary(trades: DataFrame) -> DataFrame:
    """By book and period: the last cash, counts of buys and sells, distinct tickers, costs."""
    return trades.groupBy("book", "period").agg(
        F.max_by("cash_after", "seq").alias("cash"), F.count_if(F.col("action") == "buy").alias("buys"),
        F.count_if(F.col("action") == "sell").alias("sells"), F.count_distinct("ticker").alias("tickers"), F.sum("cost").alias("cost"))


def correlations(df: DataFrame, columns: Sequence[str], guarded) -> DataFrame:
    """(x, y, r) of every pair of columns over complete pairs, in one aggregation; null for a constant one."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[guarded(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    cells: list[Column] = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def coefficient_bars(spark: SparkSession, fit: dict) -> DataFrame:
    """(term, coef, se, t, p, low, high, significant) of a regression: coefficients with their 95 % ranges; one row a term."""
    rows = list(zip(fit["names"], fit["coef"], fit["se"], fit["t"], fit["p"], fit["significant"]))
    made = spark.createDataFrame(rows, "term string, coef double, se double, t double, p double, significant boolean")
    return made.withColumns({"low": F.col("coef") - 1.96 * F.col("se"), "high": F.col("coef") + 1.96 * F.col("se")})


def label_counts(df: DataFrame, labelled: str, order: Sequence[str]) -> DataFrame:
    """(place, label, n) of the labels in a fixed order, those without rows too."""
    places = df.sparkSession.createDataFrame(list(enumerate(order)), "place int, label string")
    counts = df.groupBy(F.col(labelled).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return places.join(counts, "label", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("n"))


def tails(df: DataFrame, value: str, outer: float = 0.001) -> DataFrame:
    """One row: n, mean, sample deviation and the outer quantiles of the finite values."""
    m = moments(df, value).select("n", "mean", "sd")
    q = exact_quantiles(df, (), value, (outer, 1 - outer)).select(F.col("quantiles")[0].alias("low_tail"), F.col("quantiles")[1].alias("high_tail"))
    return m.join(F.broadcast(q))


def normal_points(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """(point, theoretical, observed): quantiles of the values against those of a normal distribution, at evenly spaced shares."""
    shares = [(i + 1) / (points + 1) for i in range(points)]
    theory = df.sparkSession.createDataFrame([(i, NormalDist().inv_cdf(q)) for i, q in enumerate(shares)], "point int, theoretical double")
    found = exact_quantiles(df, (), value, shares).select(F.posexplode("quantiles").alias("point", "observed"))
    return theory.join(F.broadcast(found), "point")


def share_positive(df: DataFrame, value: str) -> DataFrame:
    """One row: n, median, quartiles and the share over 0 of the finite values."""
    v = finite(F.col(value).cast("double"))
    over = df.agg(F.avg((v > 0).cast("double")).alias("share_over_0"))
    q = exact_quantiles(df, (), value, (0.25, 0.5, 0.75))
    return q.select("n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))]).join(F.broadcast(over))


def overview(df: DataFrame, columns: Sequence[str], bins: int = 30, few: int = 3) -> DataFrame:
    """(column, bin, low, high, n): a histogram of each column, or its values where there are at most ``few`` different ones.

    All columns share the passes: one for their ranges, one for the counts, which combine before their shuffle.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("v")) for c in columns])).alias("x"))
    long = long.select("x.*").where("v is not null")
    spans = long.groupBy("column").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("_kinds"))
    width = (F.col("b") - F.col("a")) / bins
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0)
    single = F.col("_kinds") <= few
    low = F.when(single, F.col("v")).otherwise(F.col("a") + place * width)
    high = F.when(single, F.col("v")).otherwise(F.col("a") + (place + 1) * width)
    binned = long.join(F.broadcast(spans), "column").groupBy("column", low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("n"))
    return binned.withColumn("bin", F.row_number().over(Window.partitionBy("column").orderBy("low")) - 1).select("column", "bin", "low", "high", "n")


def compared(curves: DataFrame, method: str, order: str, value: str, first: str) -> DataFrame:
    """(method, periods, final_pct, max_drawdown, ann_ret, place) of each method's value curve, by final value.

    Percentages are relative to the first value of the method named ``first``, as curves drawn together are.
    """
    base = curves.where(F.col(method) == first).agg(F.min_by(value, order).alias("_base"))
    falls = drawdown(curves, method, order, value)
    ends = curves.groupBy(method).agg(F.count(F.lit(1)).alias("periods"), F.max_by(value, order).alias("_last"), F.min_by(value, order).alias("_first"))
    growth = F.pow(F.try_divide("_last", "_first"), F.lit(12.0) / F.greatest(F.col("periods") - 1, F.lit(1))) - 1
    rows = ends.join(F.broadcast(base)).join(falls, method).select(
        method, "periods", ((F.try_divide("_last", "_base") - 1) * 100).alias("final_pct"), "max_drawdown", growth.alias("ann_ret"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("final_pct"), method)))
