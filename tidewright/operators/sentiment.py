"""Scoring texts by words, ordered context phrases and negation, in expressions only.

A ``Scorer`` is an immutable set of choices; ``annotate`` adds columns to a table.  Nothing is shuffled and no
Python runs.  The lexicon is a constant of the plan, dealt into small maps by a hash of the word, so a token costs
the same with a hundred words as with the ``MOST_WORDS`` that a lexicon may have; a join would shuffle every token of
every text to bring the texts together again.  Phrases that a text contains are picked first, and only texts with one
are folded over theirs, each phrase hit blanking its place for those after it.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewright.functions import wordlists as W
from tidewright.functions.text import strip
from tidewright.runtime import require_columns


#: Words that a lexicon may have, and phrases: they travel inside the plan.
MOST_WORDS, MOST_PHRASES = 200_000, 2_000
#: So many phrases are looked for by compiled code before any list of them is walked.
FEW_PHRASES = 64


def default_words() -> dict[str, float]:
    """Headline words under words of clear direction; neutral words are 0 unless they have a direction."""
    words = {w: 0.0 for w in W.NEUTRAL_WORDS} | W.HEADLINE_WORDS
    words |= {w: 2.0 for w in W.POSITIVE_WORDS} | {w: -2.0 for w in W.NEGATIVE_WORDS}
    return words


def tiered_lexicon(entries: DataFrame) -> DataFrame:
    """(word, valence) of a dictionary with flag columns: the first set flag of the tiers decides.

    ``entries`` has word and the numbers positive, negative, litigious, uncertainty, constraining (a year, or 0
    or null for unset).  "no" is left out; neutral words without a flag are 0; headline words fill gaps.
    """
    require_columns(entries, "word", "positive", "negative", "litigious", "uncertainty", "constraining")
    tiers = {"positive": 2.5, "negative": -2.5, "litigious": -1.0, "uncertainty": -0.5, "constraining": -0.3}
    value = F.coalesce(*[F.when(F.col(c) > 0, F.lit(v)) for c, v in tiers.items()])
    known = entries.select(F.lower(strip(F.col("word"))).alias("word"), value.alias("valence")).where(
        "valence is not null and word <> 'no'").withColumn("_rank", F.lit(0))
    more = {w: 0.0 for w in W.NEUTRAL_WORDS} | W.HEADLINE_WORDS
    gaps = entries.sparkSession.createDataFrame(list(more.items()), "word string, valence double").withColumn("_rank", F.lit(1))
    return known.unionByName(gaps).groupBy("word").agg(F.min_by("valence", F.struct("_rank", "valence")).alias("valence"))


@dataclass(frozen=True)
class Scorer:
    """What a score depends on.  ``rules`` turns on negation, intensity, capitals, "but" and punctuation."""

    words: Mapping[str, float] = field(default_factory=default_words)
    phrases: Mapping[str, float] = field(default_factory=lambda: dict(W.CONTEXT_PHRASES))
    positive_from: float = 0.05
    negative_to: float = -0.05
    phrase_weight: float = 0.3
    blank: bool = True
    negate: bool = True
    rules: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.positive_from < 1:
            raise ValueError("positive_from must lie in (0, 1)")
        if not -1 < self.negative_to < 0:
            raise ValueError("negative_to must lie in (-1, 0)")
        if not 0 < self.phrase_weight <= 1:
            raise ValueError("phrase_weight must lie in (0, 1]")
        if len(self.words) > MOST_WORDS or len(self.phrases) > MOST_PHRASES:
            raise ValueError(f"at most {MOST_WORDS} words and {MOST_PHRASES} phrases")

    def with_words(self, words: Mapping[str, float]) -> Scorer:
        return replace(self, words={**self.words, **{k.lower(): float(v) for k, v in words.items()}})

    def without_words(self, words: Sequence[str]) -> Scorer:
        gone = {w.lower() for w in words}
        return replace(self, words={k: v for k, v in self.words.items() if k not in gone})

    def with_phrases(self, phrases: Mapping[str, float]) -> Scorer:
        return replace(self, phrases={**self.phrases, **{k.lower(): float(v) for k, v in phrases.items()}})

    @classmethod
    def from_table(cls, lexicon: DataFrame, word: str = "word", valence: str = "valence", **choices) -> Scorer:
        """A scorer of the words of a table, as ``tiered_lexicon`` gives one; more than ``MOST_WORDS`` rows raise ValueError.

        Words are lower-cased; of a word that occurs twice the smallest valence counts; null words and valences don't.
        """
        require_columns(lexicon, word, valence)
        known = lexicon.select(F.lower(strip(F.col(word))).alias("w"), F.col(valence).cast("double").alias("v")).where("w <> '' and v is not null")
        rows = known.groupBy("w").agg(F.min("v").alias("v")).limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError(f"a lexicon may have {MOST_WORDS} words")
        return cls(words={r.w: r.v for r in rows}, **choices)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.words.items()), "word string, valence double")


def label(score: Column, positive_from: float = 0.05, negative_to: float = -0.05) -> Column:
    return F.when(score >= positive_from, W.POSITIVE).when(score <= negative_to, W.NEGATIVE).otherwise(W.NEUTRAL)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def _lookup(values: Mapping[str, float]) -> Callable[[Column], Column]:
    """A function from a word to its value, 0 for an unknown one: the word's checksum picks one of many small maps."""
    size = max(1, len(values))
    maps: list[dict[str, float]] = [{} for _ in range(size)]
    for w, v in values.items():
        maps[zlib.crc32(w.encode()) % size][w] = float(v)
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")
    return lambda w: F.coalesce(F.try_element_at(F.get(table, (F.crc32(w) % size).cast("int")), w), F.lit(0.0))


def phrase_hits(text: Column, low: Column, scorer: Scorer) -> Column:
    """struct(text, hits): the text with hit phrases blanked, and array of struct(phrase, adj, negated) in table order.

    ``low`` is the text in lower case, a column of its own, so that it is made once.
    """
    pairs = json.dumps([{"p": p, "v": v} for p, v in scorer.phrases.items()])
    table = F.from_json(F.lit(pairs), "array<struct<p:string,v:double>>")
    negators = F.from_json(F.lit(json.dumps(W.NEGATORS)), "array<string>")
    hit = "struct<phrase:string,adj:double,negated:boolean>"
    nothing = F.struct(text.alias("text"), F.array().cast(f"array<{hit}>").alias("hits"))
    # blanking only takes phrases away, so those of the whole text are all that can be hit
    held = F.filter(table, lambda x: F.contains(low, x["p"]))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(acc["text"])
        before = F.regexp_extract_all(F.split_part(low, x["p"], F.lit(1)), F.lit("[a-z]+"), F.lit(0))
        negated = F.arrays_overlap(F.slice(F.reverse(before), 1, 6), negators) if scorer.negate else F.lit(False)
        cleared = (F.regexp_replace(acc["text"], F.concat(F.lit(r"(?i)\Q"), x["p"], F.lit(r"\E")), F.repeat(F.lit(" "), F.length(x["p"])))
                   if scorer.blank else acc["text"])
        found = F.struct(x["p"].alias("phrase"), F.when(negated, -x["v"]).otherwise(x["v"]).alias("adj"), negated.alias("negated"))
        return F.when(F.contains(low, x["p"]), F.struct(cleared.alias("text"), F.concat(acc["hits"], F.array(found)).alias("hits"))).otherwise(acc)

    folded = F.aggregate(held, nothing, step)
    if len(scorer.phrases) > FEW_PHRASES:
        return folded
    return F.when(reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in scorer.phrases], F.lit(False)), folded).otherwise(nothing)


def _tokens(text: Column) -> Column:
    """Words without punctuation at their ends, unless at most two characters would be left; as struct(w, its lower case l)."""
    words = F.transform(F.split(strip(text), r"\s+"), lambda w: F.struct(w.alias("w"), F.btrim(w, F.lit(string.punctuation)).alias("b")))
    kept = F.transform(words, lambda x: F.when(F.length(x["b"]) <= 2, x["w"]).otherwise(x["b"]))
    return F.transform(F.filter(kept, lambda w: w != ""), lambda w: F.struct(w.alias("w"), F.lower(w).alias("l")))


def _plain_sum(text: Column, scorer: Scorer) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), _lookup(scorer.words))
    return F.aggregate(found, F.lit(0.0), lambda a, v: a + v)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column by a generator, so that its steps aren't repeated in each expression that uses it."""
    return df.withColumn(name, F.explode(F.array(value)))


#: Marks of a word that turns what follows, beside the scales of intensifiers and dampeners.
_TURNS = 9.0


def _with_rules(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Adds _sum, the valence sum by the published rules, of the column _blanked."""
    marks = {w: W.INTENSITY for w in W.INTENSIFIERS} | {w: -W.INTENSITY for w in W.DAMPENERS} | {w: _TURNS for w in W.NEGATORS}
    valence_of, mark_of = _lookup(scorer.words), _lookup(marks)
    upper = lambda t: (t["w"] == F.upper(t["w"])) & (t["w"] != t["l"])
    word = lambda t: F.struct(t["w"].alias("w"), t["l"].alias("l"), valence_of(t["l"]).alias("v"),
                              F.when(t["l"].endswith("n't"), _TURNS).otherwise(mark_of(t["l"])).alias("m"))
    df = _once(df, "_t", F.transform(_tokens(F.col("_blanked")), word))
    caps = F.exists("_t", upper) & F.exists("_t", lambda t: ~upper(t))
    sign = lambda v: F.when(v > 0, 1.0).otherwise(-1.0)

    def valence(t: Column, i: Column) -> Column:
        v = t["v"]
        back = [F.coalesce(F.get("_t", i - k)["m"], F.lit(0.0)) for k in (1, 2, 3)]
        scaled = v + F.when(F.col("_caps") & upper(t), sign(v) * W.CAPITALS).otherwise(0.0)
        for m, damp in zip(back, (1.0, 0.95, 0.9)):
            scaled = scaled + F.when(m == _TURNS, 0.0).otherwise(m) * damp * sign(v)
        flips = (back[0] == _TURNS) | (back[1] == _TURNS) | (back[2] == _TURNS)
        side = F.when((F.col("_but") == 0) | (i + 1 == F.col("_but")), 1.0).when(i + 1 < F.col("_but"), 0.5).otherwise(1.5)
        return F.when(v == 0, 0.0).otherwise(scaled * F.when(flips, W.NEGATION).otherwise(1.0) * side)

    speaks = F.exists("_t", lambda t: t["v"] != 0)
    df = df.withColumns({"_caps": speaks & caps, "_but": F.when(speaks, F.array_position(F.transform("_t", lambda t: t["l"]), "but")).cast("int")})
    marks_in = F.least(F.regexp_count("_blanked", F.lit("!")), F.lit(4)) * W.EXCLAMATION
    asks = F.regexp_count("_blanked", F.lit(r"\?"))
    loud = marks_in + F.when(asks > 3, W.QUESTIONS).when(asks > 1, asks * W.QUESTION).otherwise(0.0)
    df = _once(df, "_total", F.when(F.col("_but").isNotNull(), F.aggregate(F.transform("_t", valence), F.lit(0.0), lambda a, v: a + v)).otherwise(0.0))
    return df.withColumn("_sum", F.col("_total") + F.when(F.col("_total") > 0, loud).when(F.col("_total") < 0, -loud).otherwise(0.0))


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + F.lit(W.ALPHA))


def annotate(df: DataFrame, text: str, scorer: Scorer = Scorer(), score: str = "sentiment_score",
             label_as: str | None = "sentiment_label", keep_hits: bool = False) -> DataFrame:
    """The table with the score in [-1, 1] and its label; an empty or null text scores 0.

    With ``keep_hits`` also ``phrase_hits``, ``base``, ``adjustment`` and ``blanked``.  Columns starting with "_" that
    it uses are dropped.
    """
    require_columns(df, text)
    given = [c for c in df.columns if c not in (score, label_as)]
    df = df.withColumn("_given", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", F.lower("_given"))
    df = _once(df, "_hit", phrase_hits(F.col("_given"), F.col("_low"), scorer)).withColumn("_blanked", F.col("_hit.text"))
    df = _with_rules(df, scorer) if scorer.rules else df.withColumn("_sum", _plain_sum(F.col("_blanked"), scorer))
    n = F.size("_hit.hits")
    adjust = F.when(n > 0, F.aggregate("_hit.hits", F.lit(0.0), lambda a, h: a + h["adj"]) / n * scorer.phrase_weight).otherwise(0.0)
    df = _once(df, "_base", compound(F.col("_sum"))).withColumn("_adjust", adjust).withColumn(score, clamp(F.col("_base") + F.col("_adjust")))
    if label_as:
        df = df.withColumn(label_as, label(F.col(score), scorer.positive_from, scorer.negative_to))
    hits = [F.col("_hit.hits").alias("phrase_hits"), F.col("_base").alias("base"), F.col("_adjust").alias("adjustment"),
            F.col("_blanked").alias("blanked")] if keep_hits else []
    return df.select(*given, score, *([label_as] if label_as else []), *hits)


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of at least ``least`` characters; the whole text where at most one is so long."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) >= least)
    return F.when(F.size(parts) <= 1, F.array(text)).otherwise(parts)


def annotate_articles(df: DataFrame, row_id: str, text: str, scorer: Scorer = Scorer(), decay: float = 0.9) -> DataFrame:
    """(row_id, n_sentences, score, label): sentence scores weighted by decay ** position.

    Sentences are scored as rows, so a long article is no long task; they meet again in one aggregation that
    combines before its shuffle.  A null text scores 0; ids are taken as unique.
    """
    require_columns(df, row_id, text)
    rows = df.select(F.col(row_id).alias("_id"), F.posexplode(sentences(F.coalesce(F.col(text), F.lit("")))).alias("_i", "_sentence"))
    scored = annotate(rows, "_sentence", scorer, "_score", None)
    weight = F.pow(F.lit(decay), F.col("_i"))
    out = scored.groupBy("_id").agg(F.count(F.lit(1)).alias("n_sentences"), clamp(F.sum(F.col("_score") * weight) / F.sum(weight)).alias("score"))
    return out.select(F.col("_id").alias(row_id), "n_sentences", "score", label(F.col("score"), scorer.positive_from, scorer.negative_to).alias("label"))


def explain_scores(df: DataFrame, row_id: str, text: str, scorer: Scorer = Scorer()) -> DataFrame:
    """What a score is made of: (row_id, base, adjustment, score, label, hits).

    ``hits`` is an array of struct(place, source, token, valence, negated): every word of the blanked text that has a
    valence, once, and every phrase hit, by the size of the valence from large to small; equal sizes: words first, as they
    come in the text.  An empty or null text has base, adjustment and score 0 and no hits.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    scored = annotate(rows, "_text", scorer, "score", "label", keep_hits=True)
    known = _lookup(scorer.words)
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower("blanked"), F.lit("[a-z]+"), F.lit(0))),
                        lambda w: F.struct(F.lit("word").alias("source"), w.alias("token"), known(w).alias("valence"), F.lit(False).alias("negated")))
    phrases = F.transform("phrase_hits", lambda h: F.struct(F.lit("phrase").alias("source"), h["phrase"].alias("token"),
                                                            h["adj"].alias("valence"), h["negated"].alias("negated")))
    both = F.concat(F.filter(words, lambda w: w["valence"] != 0), phrases)
    keyed = F.array_sort(F.transform(both, lambda h, i: F.struct((-F.abs(h["valence"])).alias("size"), i.alias("i"), h.alias("h"))))
    placed = F.transform(keyed, lambda k, i: F.struct((i + 1).alias("place"), k["h"]["source"].alias("source"), k["h"]["token"].alias("token"),
                                                      k["h"]["valence"].alias("valence"), k["h"]["negated"].alias("negated")))
    return _once(scored, "hits", placed).select(F.col("row_id").alias(row_id), "base", "adjustment", "score", "label", "hits")


def explain(df: DataFrame, row_id: str, text: str, scorer: Scorer = Scorer(), most: int | None = None) -> DataFrame:
    """One row for each word and phrase that speaks in a text, at most ``most`` a text: (row_id, place, source, token, valence, negated)."""
    rows = explain_scores(df, row_id, text, scorer).select(row_id, F.explode("hits").alias("x")).select(row_id, "x.*")
    return rows if most is None else rows.where(F.col("place") <= most)


def parse_model_score(reply: Column) -> Column:
    """The first number of a model's reply, clamped; else the value of the first group with a keyword in it; else 0."""
    number = F.regexp_extract(reply, r"[-+]?\d*\.?\d+", 0)
    low = F.lower(reply)
    return (F.when(number != "", clamp(number.try_cast("double"))).when(low.rlike("|".join(W.REPLY_POSITIVE)), 0.7)
            .when(low.rlike("|".join(W.REPLY_NEGATIVE)), -0.7).otherwise(0.0))


def parse_reasoning(reply: Column) -> Column:
    """struct(output, reasoning) of a reply with <output> and <reasoning> tags; without output the whole reply."""
    part = lambda tag: F.nullif(strip(F.regexp_extract(reply, rf"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    return F.struct(F.coalesce(part("output"), strip(reply)).alias("output"), part("reasoning").alias("reasoning"))
