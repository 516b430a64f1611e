"""Texts that end before their writer's text did.

Two kinds of evidence are put together by Bayes' rule.

* Lengths.  Of each source the lengths, in characters, in bytes and in characters without a mark such as
  "[+700 chars]", are counted over all distinct texts.  For each kind of text a log-normal distribution is fitted
  by maximum likelihood, with texts at a candidate limit as right-censored: all that is known of them is that
  they were at least so long.  A limit is a length, or a narrow band below one (cuts at a word's end), that
  holds clearly more texts than the fit allows.  The excess share is a text's censoring posterior there.
* Endings.  A logistic regression tells endings of texts from endings made by cutting texts at random places;
  it sees the last characters and words, digits masked, with marks of continuation taken off.  It is fitted on
  a sample of about ``SAMPLE`` documents (the bound of the labelled rows) and applied to all.

Away from limits the prior is each source's share of stray cuts, found by averaging the posteriors once.

Scale: copies of a text are put together by one shuffle of its hash, lengths and ending; histograms combine before
their shuffle to one row for each source, kind, measure and length; a fit sees one
source's histogram of one measure, bounded by its distinct lengths; limits and priors, a row for each source and kind, are
broadcast.  Everything else is a projection of the documents; the whole text counts for its length, the
last characters for its ending.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.text import WHITESPACE
from tidewright.runtime import cut_lineage, partitions, require_columns

#: Documents whose endings are learned from, about; random cuts of each.
SAMPLE, CUTS = 20_000, 2
#: Characters of the ending that are looked at.
ENDING = 160
#: Examples that a feature must occur in to count, and features that count at most.
RARE, FEATURES = 2, 1 << 17
#: Weight of the penalty and iterations in the two rounds of the fit; the first only finds whole texts that look cut.
ROUNDS = ((2e-4, 40), (5e-6, 60))
#: Width of the band in which cuts at a word's end fall.
BAND = 14
#: Marks that publishers and broken transfers leave behind a cut (fixed values).
MARKS = (
    r"\[\+?\d+ chars\]", r"\((?:more|continued|cont\.?|cont'd)\)", r">{2,}", r"»+", r"\[(?:…|\.\.\.)\]",
    r"(?:…|\.\.\.)?\s*(?:Read on|Read more|Continue reading)", r"…", r"\.\.\.", r"<\/?\w*", "�+", r"&\w{0,6}",
)
_MARK = r"\s*(?:" + "|".join(MARKS) + r")\s*$"
_CLOSERS = "\"'”’»)\\]｣」』“"
_TERMINATOR = rf"[.!?。！？…][{_CLOSERS}]*$"


def _marked(text: Column) -> Column:
    """Length of the mark at the end, with the whitespace around it; whatever whitespace follows the text doesn't count."""
    last = F.right(F.rtrim(text, F.lit(WHITESPACE)), F.lit(ENDING))
    return F.length(last) - F.length(F.regexp_replace(last, _MARK, ""))


def _unmarked(text: Column) -> Column:
    """The text without whitespace and mark at the end."""
    whole = F.rtrim(text, F.lit(WHITESPACE))
    return F.rtrim(F.substring(whole, F.lit(1), F.length(whole) - _marked(text)), F.lit(WHITESPACE))


def _ending(text: Column) -> Column:
    """The last characters without whitespace and mark at the end, digits as 0."""
    return F.regexp_replace(F.right(_unmarked(text), F.lit(ENDING)), r"\d", "0")


def _with_features(df: DataFrame) -> DataFrame:
    """Adds ``_names``, the names of what is seen of an ending: its last characters and words, its shape, its last sentence.

    ``alone`` tells that the text has no line and no full stop before.  Steps that serve several features are columns of
    their own, so each is made once, and none looks at a character more often than a few times.
    """
    ending, stops = F.col("ending"), ".!?。！？…\n"
    line = F.substring_index(ending, "\n", -1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[ \t]+", " ")
    alone = F.when(F.col("alone"), "1").otherwise("n")
    df = df.withColumns({
        "_shape": shape, "_words": F.reverse(F.split(ending, r"[\s]+")),
        "_open": F.floor(F.log2(F.length(F.substring_index(F.translate(ending, stops, "." * len(stops)), ".", -1)) + 1)).cast("string"),
        "_stop": F.when(F.length(ending) == 0, "empty").when(ending.rlike(_TERMINATOR), "stop").otherwise("open"),
        "_of": F.concat(F.coalesce("_kind", F.lit("")), alone)})
    back = lambda n: F.array_join(F.reverse(F.slice("_words", 1, n)), " ")
    marks = F.regexp_replace(F.regexp_extract(F.right(ending, F.lit(40)), r"0*[^\w\s]*$", 0), "0{4,}", "0+")
    df = df.withColumns({f"_back{n}": back(n) for n in (1, 2, 3)})
    named = {f"s{n}": F.right(ending, F.lit(n)) for n in range(1, 13)} | {f"w{n}": F.col(f"_back{n}") for n in (1, 2, 3)} | {
        "l3": F.right("_shape", F.lit(3)), "l6": F.right("_shape", F.lit(6)), "shape": F.substring("_shape", 1, 24), "stop": F.col("_stop"), "z": marks,
        "k": F.concat("_of", "_stop"), "kw": F.concat("_of", F.lit(":"), "_back1"), "ks": F.concat("_of", F.right("_shape", F.lit(2))),
        "kw2": F.concat("_of", F.lit(":"), "_back2"), "o": F.col("_open"), "ko": F.concat("_of", "_open")}
    kept = [c for c in df.columns if c not in ("_shape", "_words", "_open", "_stop", "_of", "_back1", "_back2", "_back3")]
    return df.select(*kept, F.array(*[F.concat(F.lit(f"{n}:"), c) for n, c in named.items()]).alias("_names"))


def _alone(text: Column) -> Column:
    return ~F.rtrim(text, F.lit(WHITESPACE)).rlike(r"(?s)[.!?。！？…]\s|[。！？]|\n")


def _log_normal(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of the logarithm by maximum likelihood, censored lengths taken as "at least" (EM)."""
    x = np.log(np.maximum(lengths, 1) + 0.5)
    total = counts.sum()
    mean = (x * counts).sum() / total
    dev = max(0.05, math.sqrt(((x - mean) ** 2 * counts).sum() / total))
    if not censored.any():
        return mean, dev
    seen, seen2 = (x * counts)[~censored].sum(), (x**2 * counts)[~censored].sum()
    x, counts = x[censored], counts[censored]  # at most the lengths of a few limits
    for _ in range(60):
        z = (x - mean) / dev
        tail = np.array([max(0.5 * math.erfc(v / math.sqrt(2)), 1e-12) for v in z])
        hazard = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / tail
        ex, ex2 = mean + dev * hazard, mean**2 + dev**2 + dev * (x + mean) * hazard
        mean = (seen + (ex * counts).sum()) / total
        dev = max(0.05, math.sqrt(max((seen2 + (ex2 * counts).sum()) / total - mean**2, 0)))
    return mean, dev


def _expected(lengths: np.ndarray, n: float, mean: float, dev: float) -> np.ndarray:
    x = np.maximum(lengths, 1) + 0.5
    return n * np.exp(-0.5 * ((np.log(x) - mean) / dev) ** 2) / (dev * math.sqrt(2 * math.pi) * x)


def _near(values: np.ndarray, held: np.ndarray, shifts: range) -> np.ndarray:
    """For each sorted value and each shift what is held at value + shift, 0 where nothing is."""
    wanted = values[:, None] + np.array(shifts)
    spot = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[spot] == wanted, held[spot], held.dtype.type(0))


def _limits(h: pd.DataFrame) -> pd.DataFrame:
    """Limits of one source in one measure from its histogram (source, kind, measure, length, n, endings, open).

    A length is a limit when ``5 + 3 m`` texts or more have it, m being the larger of what the fits and what its
    neighbours expect; a band when ``8 + 3 m`` have a length in it.  Were counts Poisson with mean m, a length would reach
    that by chance with a probability below 1.2e-5, a band below 1e-7, whatever m is.  A limit's excess must for the most
    part end without a full stop (``open``).  ``endings`` has a bit for each of 64 classes of endings that occur: texts of
    one pattern share a length without any limit, but then they end alike, so half the classes must occur that so many
    texts of different endings would show.  This holds for spikes and bands.
    """
    enough = lambda n: 0.5 * 64 * (1 - np.exp(-n / 64))
    measure, m = h["measure"].iloc[0], h[h["length"] > 0]
    out, found = [], {}
    by = m.groupby("length").agg(n=("n", "sum"), open=("open", "sum"))
    values, counts, opened = by.index.to_numpy(np.int64), by["n"].to_numpy(float), by["open"].to_numpy(float)
    bits, place = np.zeros(len(values), np.uint64), np.searchsorted(values, m["length"].to_numpy())
    np.bitwise_or.at(bits, place, m["endings"].to_numpy(np.int64).view(np.uint64))
    kinds = [(k, g["length"].to_numpy(np.int64), g["n"].to_numpy(float)) for k, g in m.groupby("kind")]
    low, high = np.searchsorted(values, values - BAND, "right"), np.searchsorted(values, values + BAND, "right")
    upto = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    band = lambda x: upto(x)[1:] - upto(x)[low]
    for _ in range(3 if len(values) else 0):
        inside = lambda v: np.any([(v >= a) & (v <= b) for a, b in found], axis=0) if found else np.zeros(len(v), bool)
        fits = {k: _log_normal(v.astype(float), n, inside(v)) for k, v, n in kinds}
        fit = sum(_expected(values.astype(float), n.sum(), *fits[k]) for k, _, n in kinds)
        around = np.sort(_near(values, counts, [d for d in range(-8, 9) if d]), axis=1)[:, :-2].mean(axis=1)
        local = np.maximum(fit, around)
        spiked = (counts >= 5 + 3 * local) & (opened >= 0.5 * (counts - local)) & (np.bitwise_count(bits) >= enough(counts))
        again = {(v, v): x for v, x in zip(values[spiked].tolist(), ((counts - local) / counts)[spiked].tolist())}
        rest = band(np.where(spiked, 0, counts))
        expected = np.maximum(band(fit), BAND * fit)
        after = upto(counts)[high] - upto(counts)[1:]
        endings = np.bitwise_or.reduce(_near(values, np.where(spiked, np.uint64(0), bits), range(1 - BAND, 1)), axis=1)
        ok = ((rest >= 8 + 3 * expected) & (rest >= 3 * after) & (band(np.where(spiked, 0, opened)) >= 0.5 * (rest - expected))
              & (np.bitwise_count(endings) >= enough(rest)) & (measure != "bytes"))
        while ok.any():
            i = int(np.argmax(np.where(ok, rest - expected, -1)))
            again[int(values[i]) - BAND + 1, int(values[i])] = float((rest[i] - expected[i]) / rest[i])
            ok &= np.abs(values - values[i]) >= 2 * BAND
        if again.keys() == found.keys():
            break
        found = again
    for (a, b), share in found.items():
        for k, v, n in kinds:
            met = n[(v >= a) & (v <= b)].sum()
            if met:
                e = _expected(np.arange(a, b + 1, dtype=float), n.sum(), *fits[k]).sum()
                own = (met - e) / met if met >= 5 else share
                out.append((h["source"].iloc[0], k, measure, a, b, float(min(0.95, max(0.02, own)))))
    return pd.DataFrame(out, columns=["source", "kind", "measure", "low", "high", "posterior"])


def _prepared(documents: DataFrame) -> DataFrame:
    """One pass over the texts: lengths and ending of each that isn't blank, a narrow table of bounded rows."""
    text = F.col("_text")
    rows = documents.where(F.length(F.btrim(text, F.lit(WHITESPACE))) > 0).withColumns({
        "chars": F.length(text).cast("long"), "bytes": F.octet_length(text).cast("long"), "_mark": _marked(text),
        "ending": _ending(text), "alone": _alone(text), "_hash": F.xxhash64(text), "_unmarked": F.length(_unmarked(text)).cast("long")})
    return cut_lineage(rows.select("_id", "_hash", "_source", "_kind", "chars", "bytes", F.when(F.col("_mark") > 0, F.col("_unmarked"))
                                   .alias("unmarked"), "ending", "alone"))


def length_limits(prepared: DataFrame) -> DataFrame:
    """Limits at which texts of a source were cut: (source, kind, measure, low, high, posterior).

    ``measure`` is chars, bytes or unmarked; posterior is the share of texts of that length that the fitted
    distribution doesn't explain.  Copies of a text within a source and kind count once: they share a length without
    any limit.
    """
    lengths = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes", "unmarked")])
    place = F.pmod(F.xxhash64(F.right("ending", F.lit(8))), F.lit(64)).cast("int")
    texts = prepared.select("_source", "_kind", "_hash", "chars", "bytes", "unmarked", "ending").distinct()
    histogram = (texts.select(F.col("_source").alias("source"), F.col("_kind").alias("kind"),
                                 F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit"),
                                 (~F.col("ending").rlike(_TERMINATOR)).alias("open"), F.explode(lengths).alias("x"))
                 .select("source", "kind", "bit", "open", "x.*").where("length is not null")
                 .groupBy("source", "kind", "measure", "length").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("endings"), F.count_if("open").alias("open")))
    return histogram.groupBy("source", "measure").applyInPandas(
        _limits, "source string, kind string, measure string, low bigint, high bigint, posterior double")


def _with_censoring(prepared: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with ``_at``, the largest posterior of the limits that their lengths meet, else null."""
    held = limits.groupBy("source", "kind").agg(F.collect_list(F.struct("measure", "low", "high", "posterior")).alias("_limits"))
    joined = prepared.join(F.broadcast(held), (F.col("_source") == F.col("source")) & (F.col("_kind") == F.col("kind")), "left")
    size = lambda x: F.when(x["measure"] == "chars", F.col("chars")).when(x["measure"] == "bytes", F.col("bytes")).otherwise(F.col("unmarked"))
    met = F.filter("_limits", lambda x: size(x).between(x["low"], x["high"]))
    return joined.withColumn("_at", F.array_max(F.transform(met, lambda x: x["posterior"]))).drop("source", "kind", "_limits")


def _examples(documents: DataFrame, seen: DataFrame, rows: int) -> DataFrame:
    """Endings of a bounded sample of texts (label 0) and of random cuts of them (label 1)."""
    part = min(1.0, SAMPLE / max(rows, 1))
    sampled = lambda df: df.where(F.pmod(F.xxhash64("_id", F.lit(99)), F.lit(1 << 20)) < part * (1 << 20))
    text, size, at = F.col("_text"), F.length("_text"), F.col("_at")
    cut = F.lit(8) + F.pmod(F.xxhash64("_id", F.col("_j")), F.greatest(size - 9, F.lit(1)))
    pieces = sampled(documents).where(size > 12).withColumn("_j", F.explode(F.array(*map(F.lit, range(CUTS))))).withColumn("_at", cut.cast("int"))
    pieces = pieces.withColumns({"_piece": F.substring(text, F.lit(1), at), "_next": F.substring(text, at + 1, F.lit(1)),
                                 "_rest": F.rtrim(F.substring(text, at + 1, F.lit(ENDING)), F.lit(WHITESPACE))})
    natural = ((F.rtrim("_piece", F.lit(WHITESPACE)).rlike(_TERMINATOR) & ~F.col("_next").rlike("^[0-9]"))
               | F.col("_next").isin("\n", "\r") | (F.length("_rest") == 0))
    ones = pieces.where(~natural).select("_kind", F.lit(1.0).alias("label"), _ending(F.col("_piece")).alias("ending"), _alone(F.col("_piece")).alias("alone"))
    zeros = sampled(seen).where((F.coalesce("_at", F.lit(0.0)) < 0.5) | F.col("ending").rlike(_TERMINATOR)).select(
        "_kind", F.lit(0.0).alias("label"), "ending", "alone")
    return _with_features(ones.unionByName(zeros)).select("label", "_names")


def _fit(examples: DataFrame) -> tuple[PipelineModel | None, float]:
    """Two rounds, the second less smooth and without whole texts that the first holds for cut; also the log odds of label 1."""
    examples = cut_lineage(examples.coalesce(partitions(examples.sparkSession)))
    named = CountVectorizer(inputCol="_names", outputCol="features", minDF=RARE, vocabSize=FEATURES, binary=True).fit(examples)
    rows = cut_lineage(named.transform(examples).select("label", "features"))
    model, odds = None, 0.0
    for smoothing, most in ROUNDS:
        if model is not None:
            rows = model.transform(rows).where("label = 1 or prediction = 0").select("label", "features")
        n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < ones < n:
            return None, 0.0
        odds = math.log(ones / (n - ones))
        model = LogisticRegression(maxIter=most, regParam=smoothing, elasticNetParam=0.0, standardization=False).fit(rows)
    return PipelineModel([named, model]), odds


def truncation_scores(documents: DataFrame, *, row_id: str, text: str, source: str, kind: str | None = None) -> DataFrame:
    """How likely each text was cut inside a word or sentence: (row_id, source, at_limit, ending, score).

    ``at_limit`` is the censoring posterior where the text's length meets a limit of its source, ``ending`` the
    log odds of a cut by its ending alone, ``score`` the posterior probability of both.

    Defined cases: null, empty and blank texts have no row, as nothing was cut inside them; a null source or kind is a source or kind of its
    own; rows alike get the same score; with too few texts to learn from (no cut or no whole one) ``ending``
    is 0, so only limits speak; an empty table gives an empty result; other columns are ignored.
    """
    require_columns(documents, row_id, text, source, *([kind] if kind else []))
    rows = documents.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"),
                            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
                            F.coalesce(F.col(kind).cast("string") if kind else F.lit(""), F.lit("")).alias("_kind"))
    prepared = _prepared(rows)
    seen = _with_censoring(prepared, cut_lineage(length_limits(prepared)))
    model, odds = _fit(_examples(rows, seen, documents.count()))
    seen = _with_features(seen.select("_id", "_source", "_kind", "_at", "ending", "alone")).select("_id", "_source", "_at", "_names")
    if model is None:
        scored = seen.select("_id", "_source", "_at", F.lit(0.0).alias("ending"))
    else:
        scored = model.transform(seen).select("_id", "_source", "_at", (vector_to_array("rawPrediction")[1] - odds).alias("ending"))
    scored = cut_lineage(scored)

    def posterior(prior: Column) -> Column:
        log_odds = F.ln(prior / (F.lit(1.0) - prior)) + F.col("ending")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(log_odds, F.lit(700.0)), F.lit(-700.0))))

    stray = F.coalesce("_at", F.lit(0.02))
    shares = scored.where("_at is null").groupBy("_source").agg(
        F.least(F.greatest((F.sum(posterior(stray)) + 0.02) / (F.count(F.lit(1)) + 1), F.lit(0.002)), F.lit(0.5)).alias("_stray"))
    final = scored.join(F.broadcast(shares), "_source", "left").select(
        F.col("_id").alias(row_id), F.col("_source").alias(source), F.col("_at").alias("at_limit"), "ending", posterior(F.coalesce("_at", "_stray", F.lit(0.02))).alias("score"))
    return final
