"""Vocabulary hints by cosine similarity, and routing of texts to a rewriting model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewright.operators.sentiment import Scorer, annotate, annotate_articles, explain_scores, label, parse_reasoning
from tidewright.runtime import cut_lineage, require_columns, with_known


def unit(v: Column) -> Column:
    """The vector at length 1; null for a zero vector.  The norm stands beside the elements: within the function of an
    element it would be summed up anew for each of them."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n))


#: Queries that are shipped to the terms at a time, and terms that are multiplied with them at a time.
BLOCK, SLICE = 2048, 1024


def _best_terms(shipped, wanted: int, least: float):
    """For mapInPandas over terms in term order: the ``wanted`` terms of a partition most similar to each query of the block.

    Kept are at most ``wanted`` terms a query and the products of one slice.  Similarities are ranked by 12 digits;
    of equal ones the earlier term stays.  The block is its vectors and, by term, the queries that pass it over.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, own = shipped.value
        empty = np.zeros(0)
        query, rank, similarity, valence, names = np.zeros(0, np.int64), empty, empty, empty, np.zeros(0, object)
        floor = np.full(len(matrix), -np.inf)
        for f in frames:
            for start in range(0, len(f), SLICE):
                part = f.iloc[start:start + SLICE]
                products = matrix @ np.stack(part["e"].to_numpy()).T
                ranks = products.round(12)
                for j, name in enumerate(part["t"]) if own else ():
                    ranks[own.get(name, []), j] = -np.inf
                q, t = np.nonzero((ranks > floor[:, None]) & (ranks >= round(least, 12)))
                if not len(q):
                    continue
                query, rank = np.concatenate([query, q]), np.concatenate([rank, ranks[q, t]])
                similarity, valence = np.concatenate([similarity, products[q, t]]), np.concatenate([valence, part["v"].to_numpy()[t]])
                names = np.concatenate([names, part["t"].to_numpy(object)[t]])
                order = np.lexsort((-rank, query))  # stable, so equal ones keep the order of terms
                place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                order = order[place < wanted]
                query, rank, similarity, valence, names = query[order], rank[order], similarity[order], valence[order], names[order]
                full = np.flatnonzero(np.bincount(query, minlength=len(floor)) >= wanted)
                floor[full] = rank[np.searchsorted(query, full, "right") - 1]
        yield pd.DataFrame({"_i": query, "_t": names, "_v": valence, "similarity": similarity, "_rank": rank})

    return run


def nearest_terms(queries: DataFrame, terms: DataFrame, *, query_id: str, term: str, embedding: str, valence: str, k: int = 8,
                  least: float = 0.4, skip_own: bool = False) -> DataFrame:
    """Hints of each query: (query_id, term, valence, similarity, polarity place).

    Of the 3k most similar terms those of similarity ``least`` or more, at most k/2 positive and k/2 negative.
    Terms of valence 0 or without a vector don't count; equal similarities by term; queries without a vector have no
    hints.  With ``skip_own`` the term that equals a query's id is passed over by this query alone.

    Scale: terms stay distributed.  Queries come to the driver a partition at a time and are shipped in blocks of
    ``BLOCK``; a task keeps the 3k best terms of its partition for each query of a block, and these are ranked
    together.  A block's hints are written before the next is shipped.  Every query meets every term, so the work is
    their product.
    """
    require_columns(queries, query_id, embedding)
    require_columns(terms, term, embedding, valence)
    spark = queries.sparkSession
    id_type, term_type = dict(queries.dtypes)[query_id], dict(terms.dtypes)[term]
    vectors = with_known(terms.where(F.col(valence) != 0).select(F.col(term).alias("t"), F.col(valence).cast("double").alias("v"),
                                                                 unit(F.col(embedding)).alias("e")), "e")
    vocabulary = cut_lineage(vectors.sortWithinPartitions("t"))
    ordered = (F.desc("_rank"), F.asc("_t"))
    near = F.row_number().over(Window.partitionBy("_i").orderBy(*ordered))
    place = F.row_number().over(Window.partitionBy("_i", F.col("_v") > 0).orderBy(*ordered))
    asked = with_known(queries.select(F.col(query_id).alias("q"), unit(F.col(embedding)).alias("e")), "e").toLocalIterator(prefetchPartitions=True)
    found = []
    while block := list(islice(asked, BLOCK)):
        own: dict = {}
        for i, r in enumerate(block) if skip_own else ():
            if r["q"] is not None:
                own.setdefault(r["q"], []).append(i)
        shipped = spark.sparkContext.broadcast((np.array([r["e"] for r in block]), own))
        ids = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(block)], f"_i bigint, `{query_id}` {id_type}")
        best = vocabulary.mapInPandas(_best_terms(shipped, 3 * k, least), f"_i bigint, _t {term_type}, _v double, similarity double, _rank double")
        hints = best.withColumn("_near", near).where((F.col("_near") <= 3 * k) & (F.col("similarity") >= least)).withColumn("place", place)
        found.append(cut_lineage(hints.where(F.col("place") <= max(1, k // 2)).join(F.broadcast(ids), "_i").select(
            query_id, F.col("_t").alias(term), F.col("_v").alias(valence), "similarity", "place")))
        shipped.destroy()
    schema = f"`{query_id}` {id_type}, `{term}` {term_type}, `{valence}` double, similarity double, place int"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


Embed = Callable[[list[str]], np.ndarray]


def trigram_embedding(texts: list[str], size: int = 256) -> np.ndarray:
    """Counts of hashed character trigrams, a row for each text: an embedding that needs no model."""
    out = np.zeros((len(texts), size))
    for row, t in zip(out, texts):
        padded = f" {t.lower()} "
        for i in range(len(padded) - 2):
            row[zlib.crc32(padded[i:i + 3].encode()) % size] += 1
    return out


def embedded(df: DataFrame, text: str, embed: Embed, embedding: str = "embedding") -> DataFrame:
    """Adds a vector for each text, made on the executors a batch at a time; a null text has a null vector."""
    require_columns(df, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = f[text].notna()
            made = iter(np.asarray(embed(f.loc[known, text].tolist()), float) if known.any() else ())
            yield f.assign(**{embedding: pd.Series([next(made) if k else None for k in known], index=f.index, dtype=object)})

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{embedding}` array<double>")


def hint_corpus(spark: SparkSession, scorer: Scorer, embed: Embed) -> DataFrame:
    """(term, valence, embedding) of a scorer's words and phrases that have a valence; phrases decide over words."""
    terms = {k: v for k, v in {**scorer.words, **scorer.phrases}.items() if v}
    return embedded(spark.createDataFrame(sorted(terms.items()), "term string, valence double"), "term", embed)


def hint_lists(hints: DataFrame, query_id: str, term: str = "term", valence: str = "valence") -> DataFrame:
    """(query_id, positive, negative): the terms that ``nearest_terms`` gives a query, nearest first; lists of at most k / 2."""
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", term)))), lambda x: x[term])
    return hints.groupBy(query_id).agg(listed(F.col(valence) > 0).alias("positive"), listed(F.col(valence) < 0).alias("negative"))


class Backend(Protocol):
    """A model behind the rewriting: prompts to replies, a batch at a time; it must pickle."""

    name: str

    def batch(self, prompts: list[str]) -> list[str]: ...


class FactsBackend:
    """Needs no model: replies with the sentences of the prompt's text that hold a figure, or with the whole text."""

    name = "facts"

    def batch(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            text = p.split("Text: ", 1)[-1]
            facts = [s for s in re.split(r"(?<=[.!?])[ \t\n\x0b\x0c\r]+", text) if re.search("[0-9]", s)]
            out.append(f"<reasoning>{len(facts)} sentences with figures</reasoning><output>{' '.join(facts) or text}</output>")
        return out


#: Prompts by mode; ``{text}`` is replaced.
PROMPTS: Mapping[str, str] = {
    "extract": "List the financial facts of this text, without opinion or style. Text: {text}",
    "summarize": "Sum this text up in two or three neutral, factual sentences. Text: {text}",
    "rewrite": "Restate this text as one literal sentence, sarcasm and double negation resolved. Text: {text}",
}
#: The prompt of a rewrite with hints; ``{positive}`` and ``{negative}`` are lists of terms.
HINTED = ("Restate this text as one literal sentence, sarcasm and double negation resolved. Where they fit, use these terms for good news: "
          "{positive}; and these for bad news: {negative}. Text: {text}")


def normalise(df: DataFrame, text: str, backend: Backend, mode: str = "extract", threshold: int = 300, batch: int = 256,
              hints: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """Adds normalized_text, reasoning_trace, llm_used, backend, mode and prompt_used.

    Texts shorter than the threshold, and null ones, pass through unasked; an empty reply leaves the text.  Whole
    texts are sent.  The model is called with at most ``batch`` prompts at a time, on the executors.  In mode "rewrite"
    rows with ``hints``, as ``hint_lists`` gives them by ``row_id``, are asked with these terms in the prompt, others without.
    """
    require_columns(df, text, *([row_id] if hints is not None and row_id else []))
    if mode not in PROMPTS:
        raise ValueError(f"unknown mode {mode}; known: {sorted(PROMPTS)}")
    if hints is not None and row_id is None:
        raise ValueError("hints need row_id")
    given, filled = df.columns, lambda prompt, **parts: reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), parts.items(), F.lit(prompt))
    prompt = filled(PROMPTS[mode], text=F.col(text))
    if hints is not None and mode == "rewrite":
        known = hints.select(F.col(row_id).alias("_hinted"), "positive", "negative")
        df = df.join(known.withColumnsRenamed({"positive": "_positive", "negative": "_negative"}), F.col(row_id) == F.col("_hinted"), "left")
        terms = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")
        some = F.coalesce(F.size("_positive") + F.size("_negative"), F.lit(0)) > 0
        prompt = F.when(some, filled(HINTED, positive=terms("_positive"), negative=terms("_negative"), text=F.col(text))).otherwise(prompt)
    prompts = df.withColumn("_prompt", F.when(F.length(text) >= threshold, prompt)).select(*given, "_prompt")
    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", _reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = pd.Series([None] * len(f), index=f.index, dtype=object)
            due = f.index[f["_prompt"].notna()]
            for start in range(0, len(due), batch):
                part = due[start:start + batch]
                replies.loc[part] = backend.batch(list(f.loc[part, "_prompt"]))
            yield f.assign(_reply=replies)

    replied = prompts.mapInPandas(run, schema)
    parsed = parse_reasoning(F.col("_reply"))
    return replied.select(*given, F.coalesce(F.nullif(parsed["output"], F.lit("")), F.col(text)).alias("normalized_text"),
                          parsed["reasoning"].alias("reasoning_trace"), F.col("_prompt").isNotNull().alias("llm_used"),
                          F.when(F.col("_prompt").isNotNull(), F.lit(backend.name)).alias("backend"), F.lit(mode).alias("mode"),
                          F.col("_prompt").alias("prompt_used"))


def annotate_news(df: DataFrame, text: str, scorer: Scorer = Scorer(), backend: Backend | None = None, mode: str = "extract",
                  threshold: int = 300) -> DataFrame:
    """The table with sentiment_score and sentiment_label of a text, or of what a backend makes of it.

    With a backend also normalized_text and reasoning_trace, null where the backend wasn't asked.
    """
    if backend is None:
        return annotate(df, text, scorer)
    done = normalise(df, text, backend, mode, threshold)
    scored = annotate(done, "normalized_text", scorer)
    asked = lambda c: F.when(F.col("llm_used"), F.col(c)).alias(c)
    return scored.select(*df.columns, "sentiment_score", "sentiment_label", asked("normalized_text"), asked("reasoning_trace"))


@dataclass(frozen=True)
class Annotator:
    """A scorer with, if wished, a backend that texts of ``threshold`` characters or more pass first."""

    scorer: Scorer = Scorer()
    backend: Backend | None = None
    mode: str = "rewrite"
    threshold: int = 80

    def annotate(self, df: DataFrame, text: str) -> DataFrame:
        return annotate_news(df, text, self.scorer, self.backend, self.mode, self.threshold)

    def articles(self, df: DataFrame, row_id: str, text: str, decay: float = 0.9) -> DataFrame:
        if self.backend is not None:
            df = normalise(df.select(row_id, text), text, self.backend, self.mode, self.threshold).select(row_id, F.col("normalized_text").alias(text))
        return annotate_articles(df, row_id, text, self.scorer, decay)

    def explain(self, df: DataFrame, row_id: str, text: str) -> DataFrame:
        return explain_scores(df, row_id, text, self.scorer)


def ensemble(df: DataFrame, scores: Sequence[str], score: str = "ensemble_score", label_as: str = "ensemble_label") -> DataFrame:
    """Adds the mean of several score columns, nulls left out, and its label; null where all are null."""
    require_columns(df, *scores)
    known = F.array_compact(F.array(*[F.col(c).cast("double") for c in scores]))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
    return df.withColumn(score, mean).withColumn(label_as, F.when(F.col(score).isNotNull(), label(F.col(score))))


def agreement(df: DataFrame, *labels: str) -> DataFrame:
    """One row: shares of rows in which two or all of the label columns agree."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1:]]
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"{a}_{b}")
    every = F.avg(F.when(F.lit(True), F.array_size(F.array_distinct(F.array(*labels))) == 1).cast("double")).alias("all_agree")
    return df.agg(*[same(a, b) for a, b in pairs], every)

