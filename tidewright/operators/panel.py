"""News and prices to (ticker, period) panels: returns, lags, rolling windows, splits and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions import wordlists as W
from tidewright.functions.safe import log_return, pct_change, share, sum0
from tidewright.operators.quantiles import exact_quantiles
from tidewright.runtime import cut_lineage, require_columns

#: Columns of the monthly panel, in order (fixed values).
MONTHLY_COLUMNS = ("sent_sum_mean", "sent_sum_std", "sent_mean_avg", "sent_std_avg", "n_articles_total", "pct_pos_avg",
                   "pct_neg_avg", "sentiment_balance", "sent_lag1", "ret_lag1", "ret_lag2", "monthly_vol", "vol_lag1",
                   "n_trading_days")


def series(key: str, order: str) -> Window:
    """Rows of a key in order; keys of a panel have at most one row for each period, so groups are bounded."""
    return Window.partitionBy(key).orderBy(order)


def daily_sentiment(news: DataFrame, day: str = "day", ticker: str = "ticker", score: str = "sentiment_score",
                    labelled: str = "sentiment_label") -> DataFrame:
    """Sum (0 for nulls only), mean, sample deviation (null for one), count of scores and label shares by day and ticker."""
    require_columns(news, day, ticker, score, labelled)
    s, lab = F.col(score), F.col(labelled)
    return news.groupBy(day, ticker).agg(
        sum0(s).alias("sentiment_sum"), F.avg(s).alias("sentiment_mean"), F.stddev_samp(s).alias("sentiment_std"),
        F.count(s).alias("n_articles"), share(lab == W.POSITIVE).alias("pct_positif"), share(lab == W.NEGATIVE).alias("pct_negatif"))


def log_returns(prices: DataFrame, ticker: str = "ticker", day: str = "day", price: str = "close_price") -> DataFrame:
    """Adds log_return to the previous row of the ticker; 0 for the first row and where a price isn't positive."""
    require_columns(prices, ticker, day, price)
    return prices.withColumn("log_return", log_return(F.col(price), F.lag(price).over(series(ticker, day))))


def latest_change(prices: DataFrame, ticker: str = "ticker", day: str = "day", price: str = "close_price") -> DataFrame:
    """The relative change of each ticker's last row; null where there is only one."""
    change = pct_change(F.col(price), F.lag(price).over(series(ticker, day)))
    return prices.withColumn("_c", change).groupBy(ticker).agg(F.max_by("_c", day).alias("latest_change"))


def monthly_features(panel: DataFrame, ticker: str = "ticker", day: str = "day") -> DataFrame:
    """Monthly aggregates of a daily panel with lags of one and two rows and the next month's return as target.

    Lags are by row, not by calendar; deviations of a single day are null.  Rows without target, either lagged return, lagged
    sentiment sum or lagged volatility are left out.
    """
    require_columns(panel, ticker, day, "sentiment_sum", "sentiment_mean", "sentiment_std", "n_articles", "pct_positif", "pct_negatif", "log_return")
    d = F.date_from_unix_date(F.col(day).cast("int"))
    months = panel.groupBy(F.col(ticker), F.year(d).alias("year"), F.month(d).alias("month")).agg(
        F.avg("sentiment_sum").alias("sent_sum_mean"), F.stddev_samp("sentiment_sum").alias("sent_sum_std"),
        F.avg("sentiment_mean").alias("sent_mean_avg"), F.avg("sentiment_std").alias("sent_std_avg"),
        F.sum("n_articles").alias("n_articles_total"), F.avg("pct_positif").alias("pct_pos_avg"), F.avg("pct_negatif").alias("pct_neg_avg"),
        F.sum("log_return").alias("monthly_return"), F.stddev_samp("log_return").alias("monthly_vol"), F.count(F.lit(1)).alias("n_trading_days"),
    ).withColumns({"ym": F.col("year") * 100 + F.col("month"), "sentiment_balance": F.col("pct_pos_avg") - F.col("pct_neg_avg")})
    w = series(ticker, "ym")
    return months.withColumns({
        "sent_lag1": F.lag("sent_sum_mean").over(w), "ret_lag1": F.lag("monthly_return").over(w), "ret_lag2": F.lag("monthly_return", 2).over(w),
        "vol_lag1": F.lag("monthly_vol").over(w), "target_return": F.lead("monthly_return").over(w),
    }).withColumn("target_class", (F.col("target_return") > 0).cast("int")).where(
        "target_return is not null and ret_lag1 is not null and ret_lag2 is not null and sent_lag1 is not null and vol_lag1 is not null")


def lag_columns(panel: DataFrame, columns: Sequence[str], ticker: str, period: str, rows: int = 1) -> DataFrame:
    """The panel with each named column replaced by its value some rows before; one window for all."""
    w = series(ticker, period)
    return panel.withColumns({c: F.lag(c, rows).over(w) for c in columns})


def rolling_deviation(value: str, ticker: str, period: str, rows: int = 20) -> Column:
    """Sample deviation of the last rows; null until so many values are present."""
    w = series(ticker, period).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= rows, F.stddev_samp(value).over(w))


def forward_fill(value: str, ticker: str, period: str) -> Column:
    return F.last(value, ignorenulls=True).over(series(ticker, period).rowsBetween(Window.unboundedPreceding, 0))


def first_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most so many rows of each group, by a stable order (a limit that is the feature: articles for a ticker and day)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def top_keys(df: DataFrame, key: str, most: int) -> DataFrame:
    """The keys with the most rows (key, n); equal counts by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(most)


def extremes(df: DataFrame, value: str, name: str, most: int) -> DataFrame:
    """The rows with the largest and those with the smallest values, with ``side``; equal values by name, nulls and NaN never."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sides = [known.orderBy(order, name).limit(most).select(F.lit(side).alias("side"), *df.columns)
             for side, order in (("largest", F.desc(value)), ("smallest", F.asc(value)))]
    return sides[0].unionByName(sides[1])


def maps_of(df: DataFrame, groups: Sequence[str], key: str, value: str) -> DataFrame:
    """(groups, values): a map from key to value of each group; of a repeated key the largest value, null keys are left out.

    A map is one value of one row, so a group must fit a row: one entry a key, as prices of a day.
    """
    single = df.where(F.col(key).isNotNull()).groupBy(*groups, key).agg(F.max(value).alias(value))
    return single.groupBy(*groups).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("values"))


def split_name(period: Column, train_to, validate_to) -> Column:
    return F.when(period <= train_to, "train").when(period <= validate_to, "validation").otherwise("test")


def standardised(df: DataFrame, columns: Sequence[str], fit_on: Column) -> DataFrame:
    """(x - mean) / population deviation by the rows of ``fit_on``; null and NaN are 0 first, a constant keeps scale 1."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    fit = df.where(fit_on).agg(*[f(zero(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    out = df.join(F.broadcast(fit))
    return out.withColumns({c: (zero(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).select(*df.columns)


def robust_scaled(df: DataFrame, columns: Sequence[str], fit_on: Column) -> DataFrame:
    """(x - median) / (Q3 - Q1) by the rows of ``fit_on``; null and NaN are 0 first, no spread keeps scale 1.

    Quantiles are exact, with no task that holds all values; without a row to fit on the result is empty.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    long = df.where(fit_on).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), zero(c).alias("v")) for i, c in enumerate(columns)])).alias("x"))
    found = exact_quantiles(long.select("x.*"), ("i",), "v", (0.25, 0.5, 0.75))
    fit = found.agg(*[F.max(F.when(F.col("i") == i, F.col("quantiles"))).alias(f"_q_{c}") for i, c in enumerate(columns)]).where(f"`_q_{columns[0]}` is not null")
    spread = lambda c: F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
    out = df.join(F.broadcast(fit))
    return out.withColumns({c: (zero(c) - F.col(f"_q_{c}")[1]) / F.when(spread(c) > 0, spread(c)).otherwise(1.0) for c in columns}).select(*df.columns)


@dataclass(frozen=True)
class Splits:
    """A panel cut by time and scaled by its training rows.

    ``scaled`` holds all rows with ``split`` (train, validation, test), the feature columns scaled for a classifier, and
    under ``robust`` names once more, scaled for a regressor; ``rising`` those of class 1 outside the test part, which a
    regressor is fitted on; ``test_frame`` the test rows' ticker, period and fwd_log_ret, as portfolios need them.
    """

    features: tuple[str, ...]
    robust: tuple[str, ...]
    scaled: DataFrame
    rising: DataFrame
    test_frame: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.scaled.where(F.col("split") == name)


def prepare_splits(panel: DataFrame, features: Sequence[str] = MONTHLY_COLUMNS, train_to: int = 201612, validate_to: int = 201812,
                   ticker: str = "ticker", period: str = "ym", target: str = "target_return", labelled: str = "target_class") -> Splits:
    """Splits of a monthly panel by period, bounds included; null and NaN features count as 0."""
    require_columns(panel, ticker, period, target, labelled, *features)
    again = tuple(f"robust_{c}" for c in features)
    rows = panel.withColumn("split", split_name(F.col(period), train_to, validate_to)).withColumns({r: F.col(c) for r, c in zip(again, features)})
    train = F.col("split") == "train"
    scaled = cut_lineage(standardised(robust_scaled(rows, again, train), features, train))  # written once, as models read their parts many times
    frame = rows.where("split = 'test'").select(F.col(ticker).alias("ticker"), F.col(period).alias("period"), F.col(target).alias("fwd_log_ret"))
    return Splits(tuple(features), again, scaled, scaled.where((F.col(labelled) == 1) & (F.col("split") != "test")), frame)
