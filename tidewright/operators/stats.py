"""Hypothesis tests and regression: sums on the executors, a few numbers on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewright.functions.distributions import f_upper, t_two_sided, t_upper
from tidewright.functions.safe import finite, pearson


def mean_test(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, sample deviation and t of the mean being over 0; t is null without spread."""
    v = finite(F.col(value))
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                  F.try_divide(F.avg(v), F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v)))).alias("t"))


def one_sided(df: DataFrame, value: str) -> dict:
    """The mean test with its p value for a mean over 0."""
    r = mean_test(df, value).first().asDict()
    p = t_upper(r["t"], r["n"] - 1) if r["t"] is not None and r["n"] > 1 else math.nan
    return r | {"p": p, "significant": p < 0.05}


def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n complete pairs, r and t = r * sqrt((n - 2) / (1 - r^2))."""
    a, b = finite(F.col(x)), finite(F.col(y))
    r = pearson(a, b)
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    out = df.agg(n.alias("n"), r.alias("r"))
    return out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.greatest(F.col("n") - 2, F.lit(0)).cast("double"), 1 - F.col("r") * F.col("r"))))


def correlation_p(df: DataFrame, x: str, y: str) -> dict:
    r = correlation_test(df, x, y).first().asDict()
    p = t_two_sided(r["t"], r["n"] - 2) if r["t"] is not None and r["n"] > 2 else math.nan
    return r | {"p": p, "significant": p < 0.05}


def forecast_gain(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean test of the squared error saved against a forecast of 0 (Diebold-Mariano)."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    return mean_test(df.withColumn("_gain", y * y - e * e), "_gain")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall and F1 of class 1; 0 where nothing is there to divide by."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp = F.col("tp").cast("double")
    return c.select("*", ratio(tp, F.col("tp") + F.col("fp")).alias("precision"), ratio(tp, F.col("tp") + F.col("fn")).alias("recall"),
                    ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rmse, mae and r2."""
    e, y = F.col(actual) - F.col(predicted), F.col(actual)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"))


def permutation_f1(df: DataFrame, actual: str, predicted: str, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """F1 of shuffled labels: (permutation, f1).  Only the true positives vary, and they are hypergeometric in the
    margins, so a permutation costs one draw whatever the number of rows; draws are made on the executors, each seeded
    by its own number, so they don't depend on how they are dealt over tasks."""
    c = confusion(df, actual, predicted).first()
    rows, ones, said = c.tp + c.fp + c.fn + c.tn, c.tp + c.fn, c.tp + c.fp

    def draw(frames):
        for f in frames:
            tp = np.array([np.random.default_rng([seed, i]).hypergeometric(ones, rows - ones, said) if said else 0 for i in f["id"]], float)
            yield f.assign(permutation=f["id"], f1=2 * tp / max(ones + said, 1))[["permutation", "f1"]]

    return df.sparkSession.range(permutations).mapInPandas(draw, "permutation bigint, f1 double")


def permutation_p(df: DataFrame, actual: str, predicted: str, permutations: int = 10_000, seed: int = 42) -> dict:
    """Observed F1, the share of permutations that reach it, and the exact probability of reaching it."""
    c = confusion(df, actual, predicted).first()
    rows, ones, said = c.tp + c.fp + c.fn + c.tn, c.tp + c.fn, c.tp + c.fp
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    exact = sum(math.exp(choose(ones, k) + choose(rows - ones, said - k) - choose(rows, said))
                for k in range(c.tp, min(ones, said) + 1) if said - k <= rows - ones)
    p = permutation_f1(df, actual, predicted, permutations, seed).agg(F.avg((F.col("f1") >= c.f1 - 1e-12).cast("double"))).first()[0]
    return {"f1": c.f1, "p": p, "exact_p": min(1.0, exact)}


def correlation_tests(df: DataFrame, xs: Sequence[str], y: str) -> dict:
    """n rows with all of xs and y, r and p of each x with y, and whether any p is under 0.05."""
    whole = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in (*xs, y)]).na.drop()
    each = {x: correlation_p(whole, x, y) for x in xs}
    return {"n": next(iter(each.values()))["n"], **{f"r_{x}": e["r"] for x, e in each.items()}, **{f"p_{x}": e["p"] for x, e in each.items()},
            "significant": any(e["significant"] for e in each.values())}


def all_tests(performance: DataFrame, panel: DataFrame, xs: Sequence[str], y: str, classified: DataFrame, regressed: DataFrame,
              permutations: int = 10_000, seed: int = 42) -> dict:
    """The four tests together: excess over 0, sentiment with return, permuted labels, and forecasts against 0.

    ``classified`` has actual and predicted classes as a and p, ``regressed`` actual and predicted values as y and e.
    """
    gain = forecast_gain(regressed, "y", "e").first().asDict()
    p = t_upper(gain["t"], gain["n"] - 1) if gain["t"] is not None and gain["n"] > 1 else math.nan
    shuffled = permutation_p(classified, "a", "p", permutations, seed)
    return {"alpha": one_sided(performance, "excess"), "correlation": correlation_tests(panel, xs, y),
            "permutation": shuffled | {"significant": shuffled["p"] < 0.05}, "diebold_mariano": gain | {"p": p, "significant": p < 0.05}}


def confusion_by(df: DataFrame, split: str, actual: str, predicted: str) -> DataFrame:
    """(split, actual, predicted, n): a confusion matrix of each split, cells without rows left out."""
    return df.groupBy(split, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, nulls, mean, sd, least, largest) of number columns, in one aggregation; NaN and infinite values count as null."""
    v = {c: finite(F.col(c).cast("double")) for c in columns}
    cells = [F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("nulls"), F.avg(x).alias("mean"),
                      F.stddev_samp(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("largest")) for c, x in v.items()]
    return df.agg(F.array(*cells).alias("_all")).select(F.explode("_all").alias("_c")).select("_c.*")


def drift(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: n rows with both scores, their mean absolute difference, and the largest one."""
    d = F.abs(F.col(after) - F.col(before))
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_abs"), F.max(d).alias("largest"))


def ols_hc3(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = False) -> dict:
    """Least squares with HC3 errors: coefficients, errors, t, p, R2 (centred), F and its p.

    Rows with a null, NaN or infinite value are left out; fewer than len(xs) + 2 rows raise ValueError.  One
    aggregation gives X'X and X'y (k x k numbers to the driver), a second the leverages' weighted X'X.
    """
    names = (["_intercept"] if intercept else []) + list(xs)
    rows = df.select(finite(F.col(y).cast("double")).alias("_y"), *[finite(F.col(x).cast("double")).alias(f"_x{i}") for i, x in enumerate(xs)])
    rows = rows.na.drop()
    cols = ([F.lit(1.0)] if intercept else []) + [F.col(f"_x{i}") for i in range(len(xs))]
    k = len(cols)
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.coalesce(F.var_pop("_y") * F.count("_y"), F.lit(0.0)).alias("sst"),
                     *[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)],
                     *[F.sum(cols[i] * F.col("_y")).alias(f"b{i}") for i in range(k)]).first()
    n = first["n"]
    if n < len(xs) + 2:
        raise ValueError(f"{n} complete rows are too few for {len(xs)} columns")
    a = np.array([[first[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(a)
    beta = inverse @ np.array([first[f"b{i}"] for i in range(k)])
    dot = lambda m: sum((c * float(v) for c, v in zip(cols, m)), F.lit(0.0))
    leverage = sum((cols[i] * dot(inverse[i]) for i in range(k)), F.lit(0.0))
    e = F.col("_y") - dot(beta)
    scaled = e / F.greatest(F.lit(1.0) - leverage, F.lit(1e-10))
    second = rows.withColumns({"_e": e, "_u": scaled * scaled}).agg(
        F.sum(F.col("_e") * F.col("_e")).alias("ssr"), *[F.sum(F.col("_u") * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[second[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    t = np.divide(beta, se, out=np.zeros(k), where=se > 0)
    r2 = 1 - second["ssr"] / first["sst"] if first["sst"] > 0 else 0.0
    f = (r2 / k) / ((1 - r2) / (n - k)) if r2 < 1 else math.inf
    p = [t_two_sided(float(v), n - k) for v in t]
    return {"n": n, "names": names, "coef": beta.tolist(), "se": se.tolist(), "t": t.tolist(), "p": p, "r2": r2, "f": f,
            "f_p": f_upper(f, k, n - k) if math.isfinite(f) else 0.0, "significant": [q < 0.05 for q in p]}
