"""Sentiment features of (ticker, period) cells, market betas and abnormal returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewright.functions import wordlists as W
from tidewright.functions.safe import finite, skew0, std0
from tidewright.runtime import cut_lineage, require_columns

#: Feature columns of a cell, in order (fixed values).
SENTIMENT_COLUMNS = ("n_articles", "n_positive_articles", "n_negative_articles", "n_neutral_articles", "news_burst", "mean_score",
                     "median_score", "std_score", "score_range", "score_skew", "pct_positive", "pct_negative", "sentiment_balance")


def sentiment_features(news: DataFrame, ticker: str = "ticker", period: str = "period", score: str = "sentiment_score",
                       labelled: str = "sentiment_label", burst_quantile: float = 0.75) -> DataFrame:
    """Counts, centre, spread, skewness and balance of the scores of each cell, in one aggregation.

    ``news_burst`` marks cells with more articles than the quantile over all cells (over the aggregated
    table); a threshold of 0 or none counts as 1.  The cells are written once: both the threshold and the result
    need them, and what made the scores isn't run twice.
    """
    require_columns(news, ticker, period, score, labelled)
    s, lab = F.col(score), F.col(labelled)
    cells = cut_lineage(news.groupBy(ticker, period).agg(
        F.count(F.lit(1)).alias("n_articles"),
        *[F.count_if(lab == v).cast("int").alias(f"n_{n}_articles") for n, v in (("positive", W.POSITIVE), ("negative", W.NEGATIVE), ("neutral", W.NEUTRAL))],
        F.avg(s).alias("mean_score"), F.median(s).alias("median_score"), std0(s).alias("std_score"),
        F.coalesce(F.max(s) - F.min(s), F.lit(0.0)).alias("score_range"), skew0(s).alias("score_skew")))
    threshold = cells.agg(F.percentile("n_articles", burst_quantile).alias("_q")).select(F.coalesce(F.nullif("_q", F.lit(0.0)), F.lit(1.0)).alias("_q"))
    part = lambda n: F.col(f"n_{n}_articles") / F.col("n_articles")
    return cells.join(F.broadcast(threshold)).withColumns({
        "news_burst": (F.col("n_articles") > F.col("_q")).cast("int"), "pct_positive": part("positive"), "pct_negative": part("negative"),
        "sentiment_balance": part("positive") - part("negative")}).select(ticker, period, *SENTIMENT_COLUMNS)


def market_betas(panel: DataFrame, ticker: str = "ticker", ret: str = "ret", market: str = "mkt_ret", least: int = 24) -> DataFrame:
    """alpha, beta and n_obs of each ticker's regression on the market over rows with both, by least squares.

    Under ``least`` rows alpha is 0 and beta 1.  A constant market gives the solution of smallest norm.
    Null tickers and rows with a null, NaN or infinite return are left out.
    """
    require_columns(panel, ticker, ret, market)
    rows = panel.select(F.col(ticker), finite(F.col(ret)).alias("y"), finite(F.col(market)).alias("x")).where(F.col(ticker).isNotNull())
    rows = rows.withColumns({"y": F.when(F.col("x").isNotNull(), F.col("y")), "x": F.when(F.col("y").isNotNull(), F.col("x"))})
    fit = rows.groupBy(ticker).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("y").alias("n_obs"),
                                   F.avg("y").alias("my"), F.avg("x").alias("mx"))
    enough, norm = F.col("n_obs") >= least, F.lit(1.0) + F.col("mx") * F.col("mx")
    return fit.select(ticker, F.when(enough, F.coalesce("a", F.col("my") / norm)).otherwise(0.0).alias("alpha"),
                      F.when(enough, F.coalesce("b", F.col("mx") * F.col("my") / norm)).otherwise(1.0).alias("beta"), "n_obs")


def abnormal_returns(panel: DataFrame, betas: DataFrame, ticker: str = "ticker", ret: str = "ret", market: str = "mkt_ret") -> DataFrame:
    """Adds abnormal_ret = ret - (alpha + beta * market); tickers without an estimate have alpha 0, beta 1.

    One row of betas for each ticker, so the join is left to Spark to broadcast while that table is small.
    """
    require_columns(betas, ticker, "alpha", "beta")
    known = betas.select(F.col(ticker).alias("_t"), F.col("alpha").alias("_a"), F.col("beta").alias("_b"))
    expected = F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(1.0)) * F.col(market)
    return panel.join(known, F.col(ticker) == F.col("_t"), "left").withColumn("abnormal_ret", F.col(ret) - expected).drop("_t", "_a", "_b")


def full_features(news: DataFrame, returns: DataFrame, market: DataFrame, ticker: str = "ticker", period: str = "period", least: int = 24) -> DataFrame:
    """Sentiment features left-joined with returns, the market's return of the period and abnormal returns."""
    panel = returns.select(ticker, period, "ret").join(market.select(period, "mkt_ret"), period, "left")
    marked = abnormal_returns(panel, market_betas(panel, ticker, least=least), ticker)
    return sentiment_features(news, ticker, period).join(marked, [ticker, period], "left")
