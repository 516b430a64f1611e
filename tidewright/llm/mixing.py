"""Mixing sources to target shares by Poisson replication.

Every document draws one uniform number from a hash of its id and a seed, and its number of copies is the
inverse of a Poisson distribution at that number, at most ``max_repeats``.  The mean of the distribution is
the source's repetition rate.  Since the draws are fixed by the hash, the mean is tuned to them: one
aggregation sums the tokens of each source by small intervals of the draw, and of this histogram the mean is
found at which the copies sum up to the source's target.  So the shares hold without the noise of a draw, as
far as the cap allows: a source too small for its share gives every document ``max_repeats`` times, and the
reached share says so.

Scale: token counts cost one pass over the texts; then one aggregation that combines before its shuffle to at
most sources x INTERVALS rows, and the broadcast of one row for each source.  A source with a third of all
rows needs no task of its own.  The only shuffle of texts is the wanted one, the global shuffle of the mix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewright.llm.tokens import token_counts
from tidewright.runtime import cut_lineage, require_columns

#: Intervals of the uniform draw that the means are tuned on.
INTERVALS = 65_536


def draw(row_id: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the id and the seed."""
    return (F.shiftrightunsigned(F.xxhash64(row_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def _thresholds(rate: float, cap: int) -> list[float]:
    """Draws above the k-th threshold give more than k copies."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def _tuned(histogram: pd.DataFrame) -> pd.DataFrame:
    """Of one source's tokens by interval: the thresholds at which its copies sum up to its target."""
    source, cap, target = histogram["source"].iloc[0], int(histogram["max_repeats"].iloc[0]), float(histogram["target"].iloc[0])
    tokens = np.zeros(INTERVALS)
    known = histogram["interval"].notna()
    tokens[histogram.loc[known, "interval"].astype(int)] = histogram.loc[known, "tokens"]
    above = np.concatenate([np.cumsum(tokens[::-1])[::-1], [0.0]])  # tokens of draws from this interval on
    grid = np.arange(INTERVALS + 1) / INTERVALS
    size = lambda rate: sum(np.interp(_thresholds(rate, cap), grid, above))
    if cap <= 0 or target <= 0:
        limits = [1.0] * max(cap, 0)
    elif above[0] * cap <= target:
        limits = [0.0] * cap
    else:
        low, high = 0.0, 1.0
        while size(high) < target and high < 600:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if size(middle) < target else (low, middle)
        limits = _thresholds(high, cap)
    return pd.DataFrame({"source": [source], "limits": [limits]})


def mix_plan(documents: DataFrame, targets: DataFrame, *, row_id: str, text: str, source: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sizes, limits): token sizes of all documents of listed sources, and a row for each listed source.

    ``targets`` has source, target_share and max_repeats, one row for each source.
    """
    require_columns(documents, row_id, text, source)
    require_columns(targets, "source", "target_share", "max_repeats")
    wanted = targets.where("source is not null").select(F.col("source").alias("_source"), "target_share", "max_repeats")
    listed = documents.join(F.broadcast(wanted.select("_source")), F.col(source) == F.col("_source"), "left_semi")
    listed = listed.select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sizes = cut_lineage(token_counts(listed, ["row_id", "source"], "text"))
    by_interval = sizes.groupBy("source", F.floor(draw(F.col("row_id"), seed) * INTERVALS).cast("int").alias("interval")).agg(
        F.sum("n_tokens").alias("tokens"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    histogram = wanted.withColumnRenamed("_source", "source").join(by_interval, "source", "left").join(F.broadcast(total)).select(
        "source", "interval", "tokens", "max_repeats", (F.col("target_share") * F.col("total")).alias("target"))
    limits = cut_lineage(histogram.groupBy("source").applyInPandas(_tuned, "source string, limits array<double>"))
    return sizes, limits


def _copies(row_id: Column, seed: int) -> Column:
    u = draw(row_id, seed)
    return F.size(F.filter("limits", lambda x: u > x))


def mixed(documents: DataFrame, targets: DataFrame, *, row_id: str, text: str, source: str, seed: int = 0) -> DataFrame:
    """The documents of the mix in shuffled order, with ``copy_no`` from 1 and the ``shuffle_key`` they are sorted by.

    Documents of sources that aren't listed, or of none, are left out; a listed source without documents gives
    nothing; null and empty texts have size 0 and are drawn like others; rows alike count each for themselves.
    All columns of the documents are kept.  The same seed gives the same mix.
    """
    _, limits = mix_plan(documents, targets, row_id=row_id, text=text, source=source, seed=seed)
    limits = F.broadcast(limits.withColumnRenamed("source", "_source"))
    copies = documents.join(limits, F.col(source) == F.col("_source")).withColumn("_n", _copies(F.col(row_id), seed)).where("_n > 0")
    key = F.xxhash64(F.col(row_id), F.col("copy_no"), F.lit(seed + 1))
    return copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("shuffle_key", key).drop(
        "_n", "_source", "limits").orderBy("shuffle_key", row_id, "copy_no")


def reached_shares(documents: DataFrame, targets: DataFrame, *, row_id: str, text: str, source: str, seed: int = 0) -> DataFrame:
    """For each listed source the wanted and the reached share and size of the mix that ``mixed`` gives."""
    sizes, limits = mix_plan(documents, targets, row_id=row_id, text=text, source=source, seed=seed)
    n = _copies(F.col("row_id"), seed)
    used = sizes.join(F.broadcast(limits), "source").withColumn("_n", n).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("source_tokens"), F.sum("_n").alias("copies"),
        F.max("_n").alias("most_copies"), F.sum(F.col("_n") * F.col("n_tokens")).alias("mix_tokens"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("wanted_total"))
    table = targets.where("source is not null").join(used, "source", "left").na.fill(0, ["documents", "source_tokens", "copies", "most_copies", "mix_tokens"])
    reached = table.agg(F.sum("mix_tokens").alias("reached_total"))
    return table.join(F.broadcast(total)).join(F.broadcast(reached)).select(
        "source", "target_share", "max_repeats", "documents", "source_tokens", "copies", "most_copies", "mix_tokens",
        F.coalesce(F.try_divide("mix_tokens", "wanted_total"), F.lit(0.0)).alias("share_of_wanted_size"),
        F.coalesce(F.try_divide("mix_tokens", "reached_total"), F.lit(0.0)).alias("reached_share"))
