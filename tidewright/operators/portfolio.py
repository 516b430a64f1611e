"""Choosing, weighting and measuring portfolios; a ledger that is folded over periods."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.safe import pearson
from tidewright.runtime import require_columns

#: Periods in a year by name (fixed values).
PERIODS_A_YEAR = {"monthly": 12, "weekly": 52, "daily": 252, "hourly": 1512, "30min": 3276, "15min": 6552, "5min": 19656, "1min": 98280}


def periods_a_year(freq: int | str) -> int:
    if isinstance(freq, int):
        return freq
    if freq not in PERIODS_A_YEAR:
        raise ValueError(f"unknown frequency {freq}; known: {sorted(PERIODS_A_YEAR)}")
    return PERIODS_A_YEAR[freq]


def choose(df: DataFrame, period: str, item: str, score: str, n: int) -> DataFrame:
    """The n rows of highest score of each period with their ``place``; ties by item, null and NaN scores never."""
    require_columns(df, period, item, score)
    w = Window.partitionBy(period).orderBy(F.desc(score), F.asc(item))
    return df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


WEIGHTINGS = ("equal", "score", "softmax", "rank")


def weighted(chosen: DataFrame, kind: str, period: str, score: str = "score") -> DataFrame:
    """Adds ``weight``, which sums to 1 in a period of chosen rows: equal, score (min-max), softmax or rank (by ``place``).

    Scores are taken relative to the period's least or largest one first, so large ones neither overflow nor cancel;
    a period of equal scores is weighted equally by "score".
    """
    w = Window.partitionBy(period)
    s, equal = F.col(score).cast("double"), F.lit(1.0) / F.count(F.lit(1)).over(w)
    raw = {"equal": F.lit(1.0), "score": s - F.min(s).over(w), "softmax": F.exp(s - F.max(s).over(w)), "rank": F.lit(1.0) / F.col("place")}
    if kind not in raw:
        raise ValueError(f"unknown weighting {kind}; known: {sorted(raw)}")
    total = F.sum("_raw").over(w)
    share = F.when(total > 0, F.col("_raw") / total).otherwise(equal)
    return chosen.withColumn("_raw", raw[kind]).withColumn("weight", share).drop("_raw")


def custom_weights(chosen: DataFrame, period: str, score: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds ``weight`` by a function from a period's scores, ordered by place, to weights; a group has at most n rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return group.assign(weight=np.asarray(fn(group[score].to_numpy()), float))

    schema = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes if c != "weight") + ", weight double"
    return chosen.groupBy(period).applyInPandas(run, schema)


Weighting = str | Callable[[np.ndarray], np.ndarray]


def build(df: DataFrame, period: str, item: str, n: int, weighting: Weighting = "equal", score: str = "score") -> DataFrame:
    """The n best rows of each period by a column of scores, with ``place`` and ``weight``.

    ``weighting`` names one of ``WEIGHTINGS`` or is a function from a period's scores, best first, to weights.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    if not callable(weighting) and weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting}; known: {WEIGHTINGS}")
    chosen = choose(df, period, item, score, n)
    return custom_weights(chosen, period, score, weighting) if callable(weighting) else weighted(chosen, weighting, period, score)


def combined(probability: Column, predicted: Column) -> Column:
    """The usual score of a row: the probability of a rise times the predicted return."""
    return probability * predicted


def build_by_models(df: DataFrame, classifier, regressor, period: str, item: str, n: int, weighting: Weighting = "equal",
                    combine: Callable[[Column, Column], Column] = combined) -> DataFrame:
    """``build`` by the score that ``combine`` makes of a fitted classifier's probability and a fitted regressor's prediction.

    The result also has pred_prob, pred_ret and score.  Both models read their own feature columns of ``df``; a missing
    model raises ValueError.
    """
    if classifier is None or regressor is None:
        raise ValueError("give a classifier and a regressor, or use build with a column of scores")
    require_columns(df, period, item)
    likely = classifier.predict(df).withColumnRenamed("probability_1", "pred_prob").drop("prediction")
    both = regressor.predict(likely).withColumnRenamed("prediction", "pred_ret")
    return build(both.withColumn("score", combine(F.col("pred_prob"), F.col("pred_ret"))), period, item, n, weighting)


def performance(portfolio: DataFrame, universe: DataFrame, period: str, ret: str) -> DataFrame:
    """Return of portfolio and benchmark, excess and compounded returns of every period; one row for a period."""
    chosen = F.sum(F.col(ret) * F.col("weight")) if "weight" in portfolio.columns else F.avg(ret)
    both = portfolio.groupBy(period).agg(chosen.alias("port_ret")).join(universe.groupBy(period).agg(F.avg(ret).alias("bench_ret")), period)
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"excess": F.col("port_ret") - F.col("bench_ret"), "cum_port": F.product(F.col("port_ret") + 1).over(w) - 1,
                             "cum_bench": F.product(F.col("bench_ret") + 1).over(w) - 1})


def metrics(perf: DataFrame, portfolio: DataFrame, ret: str, score: str = "score", freq: int | str = 12) -> DataFrame:
    """One row: annual returns, Sharpe ratio of the portfolio's own return (0 without spread) and information coefficient."""
    k = periods_a_year(freq)
    sd = F.stddev_samp("port_ret")
    a = perf.agg((F.avg("port_ret") * k).alias("ann_port"), (F.avg("bench_ret") * k).alias("ann_bench"),
                 F.when(sd > 0, F.avg("port_ret") / sd * float(np.sqrt(k))).otherwise(0.0).alias("sharpe"))
    return a.join(F.broadcast(portfolio.agg(pearson(F.col(score), F.col(ret)).alias("ic"))))


def drawdown(curve: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The largest fall from a running peak of each key's curve."""
    peak = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("_d", F.try_divide(F.col(value), peak) - 1).groupBy(key).agg(F.min("_d").alias("max_drawdown"))


def frictionless_value(targets: DataFrame, prices: DataFrame, book: str = "book", period: str = "period", item: str = "ticker") -> DataFrame:
    """Growth of every book from period to period without costs, in expressions: (book, period, growth, value).

    ``targets`` has book, period, item, weight and ``prices`` period, item, price of every held item; periods follow
    in the order of the books' own periods.  A position without a price at the next period counts as worth 0.
    """
    steps = targets.select(book, period).distinct()
    steps = steps.withColumn("_next", F.lead(period).over(Window.partitionBy(book).orderBy(period)))
    p = prices.select(F.col(item).alias("_i"), F.col(period).alias("_p"), F.col("price").alias("_price"))
    held = targets.join(steps, [book, period]).join(p, (F.col(item) == F.col("_i")) & (F.col(period) == F.col("_p"))).select(
        book, period, item, "weight", "_next", F.col("_price").alias("_from"))
    then = held.join(p, (F.col(item) == F.col("_i")) & (F.col("_next") == F.col("_p")), "left")
    growth = then.groupBy(book, period).agg((F.lit(1.0) - F.sum("weight") + F.sum(F.col("weight") * F.coalesce(F.try_divide("_price", "_from"), F.lit(0.0)))).alias("growth"),
                                            F.max("_next").alias("_next")).where("_next is not null").select(book, F.col("_next").alias(period), "growth")
    w = Window.partitionBy(book).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return growth.withColumn("value", F.product("growth").over(w))


TRADES = "book string, period string, seq bigint, ticker string, action string, shares double, price double, cost double, cash_after double, value double"


def rebalance(targets: DataFrame, prices: DataFrame, cash: float, cost: float = 0.0, close: bool = False) -> DataFrame:
    """Trades of each book as its weights are traded to, period by period: a fold whose state is cash and shares.

    ``targets`` has book, period, ticker, weight and ``prices`` period, ticker, price.  Within a period the value
    is taken first (a missing price counts 0), then tickers in order: steps under 1e-6 and items without a
    positive price are passed over, cost is paid on what is traded.  ``close`` sells all at the last known prices.
    Of an item a book's task gets the periods in which it is wanted and the first priced one after each of these, in
    which what is left of it is sold; nothing else can change the outcome.  A book's state can't be split, so its rows, at
    most twice its target rows, go to one task; books are independent.
    """
    require_columns(targets, "book", "period", "ticker", "weight")
    require_columns(prices, "period", "ticker", "price")
    wanted = targets.select("book", "period", "ticker", "weight")
    names = wanted.select("book", "ticker").distinct()
    quoted = prices.select("period", "ticker", "price").join(names, "ticker").join(wanted.select("book", "period").distinct(), ["book", "period"])
    both = quoted.join(wanted, ["book", "period", "ticker"], "full")
    before = F.lag(F.col("weight").isNotNull()).over(Window.partitionBy("book", "ticker").orderBy("period"))
    rows = both.withColumn("_due", F.col("weight").isNotNull() | before).where("_due").select(
        "book", F.col("period").cast("string").alias("period"), "ticker", "price", "weight")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        book, money, shares, last, out = group["book"].iloc[0], float(cash), {}, {}, []

        def trade(period: Any, ticker: str, goal: float, price: float, value: float) -> None:
            nonlocal money
            step = goal - shares.get(ticker, 0.0) * price
            if price <= 0 or abs(step) < 1e-6:
                return
            paid = abs(step) * cost
            money -= step + paid
            shares[ticker] = shares.get(ticker, 0.0) + step / price
            if abs(shares[ticker]) < 1e-10:
                del shares[ticker]
            out.append((book, period, len(out) + 1, ticker, "buy" if step > 0 else "sell", abs(step) / price, price, paid, money, value))

        for period, rows in group.sort_values(["period", "ticker"]).groupby("period", sort=True):
            quote = {t: float(p) for t, p in zip(rows["ticker"], rows["price"]) if p == p and p is not None}
            last.update(quote)
            value = money + sum(n * quote.get(t, 0.0) for t, n in shares.items())
            wanted = {t: float(w) for t, w in zip(rows["ticker"], rows["weight"]) if w == w and w is not None}
            for t in sorted(set(shares) | set(wanted)):
                trade(period, t, value * wanted.get(t, 0.0), quote.get(t, 0.0), value)
        if close:
            value = money + sum(n * last.get(t, 0.0) for t, n in shares.items())
            for t in sorted(shares):
                trade("close", t, 0.0, last.get(t, 0.0), value)
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")])

    return rows.groupBy("book").applyInPandas(fold, TRADES)
