"""Operators for training data against brute force, the public tokenizers and in every defined case."""

import base64
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewright.llm")

from tidewright.llm import nearest_time as N, tokens as T  # noqa: E402
from tidewright.llm.mixing import mixed, reached_shares  # noqa: E402
from tidewright.llm.nearest_time import nearest_in_time  # noqa: E402
from tidewright.llm.tokens import compile_lexicon, look_up, merge, read_ranks, token_counts, token_ids  # noqa: E402
from tidewright.llm.top_n import top_items  # noqa: E402
from tidewright.llm.truncation import truncation_scores  # noqa: E402
from tidewright.sources.tables import table  # noqa: E402

# --------------------------------------------------------------------------------------- nearest in time

ROW = "i long, k string, t long"
NEAR = dict(left_id="i", right_id="i", entity="k", at="t", tolerance=3)


def nearest(left, right, tolerance):
    out = {}
    for i, k, t in left:
        best = min(((abs(rt - t), rt, ri) for ri, rk, rt in right if None not in (i, k, t, ri, rk, rt) and rk == k), default=None)
        if best and best[0] <= tolerance:
            out[i] = (best[2], best[1] - t)
    return out


@pytest.mark.parametrize("count, held, batch", [(1, 50, 10), (3, 10**6, 10_000), (3, 5, 3), (40, 0, 7)])
def test_nearest_over_partition_edges(spark, monkeypatch, count, held, batch):
    """One entity far larger than a task, a crowded moment, and stretches of batches and partitions without any right row."""
    monkeypatch.setattr(N, "HELD", held)
    rng = random.Random(count)
    left = [(i, "hot" if i % 3 else rng.choice("abc"), rng.randrange(400)) for i in range(700)] + [(2000 + i, "hot", 77) for i in range(200)]
    right = [(i, "hot" if i % 2 else rng.choice("abc"), rng.choice([rng.randrange(40), 300 + rng.randrange(100)])) for i in range(60)]
    left += [(5000, None, 3), (5001, "a", None), left[0]]
    right += [(900, None, 3), (901, "a", None), right[0]]
    left += left[:300]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    for tolerance in (0, 3, 1000):
        got = nearest_in_time(spark.createDataFrame(left, ROW).repartition(3), spark.createDataFrame(right, ROW), **{**NEAR, "tolerance": tolerance}, count=count)
        rows = [(r[0], (r[1], r.gap)) for r in got.toDF("left", "right", "gap").collect()]
        assert len(rows) == len(dict(rows)) and dict(rows) == nearest(left, right, tolerance)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nearest_empty_sides_and_ties(spark):
    none, one = spark.createDataFrame([], ROW), spark.createDataFrame([(1, "a", 5)], ROW)
    assert nearest_in_time(none, one, **NEAR).count() == nearest_in_time(one, none, **NEAR).count() == nearest_in_time(none, none, **NEAR).count() == 0
    right = spark.createDataFrame([(9, "a", 4), (8, "a", 4), (7, "a", 6)], ROW).withColumns({"side": F.lit("x"), "pid": F.lit(1)})
    assert [tuple(r) for r in nearest_in_time(one, right, **NEAR).collect()] == [(1, 8, -1)]


# ------------------------------------------------------------------------------------------------ top n

def test_top_items_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", None, "y"]), rng.choice([1, 2]), rng.choice(["a", "b", "c", "d", "e", "f", "g", None]), rng.choice([None, math.nan, -1.0, 0.0, -0.0, 0.5, 2.0, math.inf])) for _ in range(300)]
    want = {}
    for g, h, item, s in rows:
        if item is not None and s is not None and s == s:
            best = want.setdefault((g, h), {})
            best[item] = max(best.get(item, -math.inf), s)
    want = {k: [i for i, _ in sorted(v.items(), key=lambda x: (-x[1], x[0]))[:3]] for k, v in want.items()}
    df = spark.createDataFrame(rows, "g string, h int, i string, s double").withColumns({"place": F.lit(7), "_item": F.lit("clash")})
    got = {}
    for r in top_items(df, ("g", "h"), "i", "s", 3, salts=4).orderBy("place").collect():
        got.setdefault((r.g, r.h), []).append(r.i)
    assert got == want
    assert top_items(df.limit(0), ("g", "h"), "i", "s", 3).count() == 0


# ----------------------------------------------------------------------------------------------- tokens

TEXTS = ["", None, " ", "\n\n  \t", "Hello world", "it's we'll DON'T", "naïve café — 東京の株価 🚀🤷‍♀️", "a" * 5000, "=-" * 3000, "<|endoftext|> is text",
         "x  y   z 　q", "﻿\x00\x81�", "12345 67,890.12", "   trailing   ", "Á̈̃" * 50, "\r\n\r\n", "é" * 400]


def reference():
    import tiktoken

    ranks = read_ranks(f"{T.TOKENIZERS}/{T.VOCABULARY}")
    return tiktoken.Encoding("check", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_both_public_implementations(spark, data):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = reference()
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()] + [(10**6 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for words in (0, 300):
        got = {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text", words).collect()}
        for i, t in docs:
            assert got[i] == enc.encode_ordinary(t or "") == other.encode(t or "", add_special_tokens=False).ids
    counts = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "text", 50).collect()}
    assert counts == {i: len(enc.encode_ordinary(t or "")) for i, t in docs}


def test_token_ids_of_empty_table_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.ids for r in token_ids(df, "doc_id", "text").collect()] == [[64, 275]] * 3
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_transducer_is_minimal_and_exact():
    rng = random.Random(0)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 7))): [rng.randrange(99)] * rng.randrange(1, 3) for _ in range(90)}
    lexicon = compile_lexicon(words)

    def found(lexicon, asked):
        ends = np.cumsum([0, *map(len, asked)])
        places = look_up(lexicon, np.frombuffer(b"".join(asked), np.uint8), ends[:-1], ends[1:])
        return [lexicon["ids"][lexicon["start"][p]:lexicon["start"][p + 1]].tolist() if p >= 0 else None for p in places]

    assert found(lexicon, list(words)) == list(words.values())
    others = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 8))) for _ in range(500)]
    assert found(lexicon, others) == [words.get(w) for w in others]
    # minimal: no two states accept the same set of endings
    edges, final = list(zip(lexicon["edge"].tolist(), lexicon["target"].tolist())), lexicon["final"].tolist()
    language = []
    for s in range(len(final)):
        language.append(frozenset(({b""} if final[s] else set()) | {bytes([e % 256]) + rest for e, t in edges if e // 256 == s for rest in language[t]}))
    assert len(set(language)) == len(language)
    assert found(compile_lexicon({}), [b"a", b""]) == [None, None]


def test_words_are_cut_where_the_tokenizer_cuts(spark):
    """Runs and kinds of whitespace at every place, with and without a lexicon that holds the words."""
    rng, enc = random.Random(3), reference()
    parts = ["a", "the", "'s", "x's", "12", "3a", ",", "...", "é", "京", " ", "  ", "   ", "\n", " \n", "\n ", "\t", "\u3000", "\xa0", "\x85", "\x1c", "\x1f ", "\u200b", "\r\n", ""]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (0, 500):
        got = {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text", words).collect()}
        assert [(i, got[i]) for i, t in docs] == [(i, enc.encode_ordinary(t)) for i, t in docs]


def test_merge_of_long_words():
    ranks, enc = read_ranks(f"{T.TOKENIZERS}/{T.VOCABULARY}"), reference()
    for w in ["a" * 3001, "ab" * 900, "東京" * 300, "the", "antidisestablishmentarianism"]:
        assert merge(w.encode(), ranks) == enc.encode_ordinary(w)


# ----------------------------------------------------------------------------------------------- mixing

MIX = dict(row_id="doc_id", text="text", source="source", seed=3)


def test_mix_reaches_shares_and_keeps_caps(spark):
    docs = [(i, "word " * (1 + i % 9), ("big", "mid", "small", "tiny", None, "other")[i % 6 if i % 5 else 0]) for i in range(3000)]
    docs += [(9000, "", "mid"), (9001, None, "mid")]
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 3), ("small", 0.2, 5), ("tiny", 0.1, 0), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    shares = {r.source: r for r in reached_shares(df, targets, **MIX).collect()}
    mix = mixed(df, targets, **MIX).collect()
    assert {r.source for r in mix} <= {"big", "mid", "small"} and shares["tiny"].copies == 0 and shares["absent"].reached_share == 0.0
    for s, cap, share in (("big", 1, 0.3), ("mid", 3, 0.3), ("small", 5, 0.2)):
        own = [r for r in mix if r.source == s]
        counts = {}
        for r in own:
            counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
        assert max(counts.values()) <= cap and len(own) == shares[s].copies and sorted({r.copy_no for r in own})[0] == 1
        assert shares[s].share_of_wanted_size == pytest.approx(min(share, cap * shares[s].source_tokens / (shares["big"].source_tokens + sum(
            shares[x].source_tokens for x in ("mid", "small", "tiny")))), rel=0.02)
    keys = [r.shuffle_key for r in mix]
    assert keys == sorted(keys) and [r.doc_id for r in mix] == [r.doc_id for r in mixed(df, targets, **MIX).collect()]


def test_shares_are_those_of_the_mix_and_a_seed_is_kept(spark):
    docs = [(i, "word " * (1 + i % 9), ("big", "mid", "small")[i % 3]) for i in range(900)]
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.2, 5)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    told = {r.source: (r.copies, r.mix_tokens, r.most_copies) for r in reached_shares(df, targets, **MIX).collect()}
    mix = mixed(df.repartition(7), targets, **MIX)
    counted = token_counts(mix.select("doc_id", "source", "copy_no", "text"), ["source", "copy_no"], "text").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("copy_no").alias("m"))
    assert {r.source: (r.n, r.t, r.m) for r in counted.collect()} == told
    pairs = lambda m: {(r.doc_id, r.copy_no) for r in m.select("doc_id", "copy_no").collect()}
    assert pairs(mix) == pairs(mixed(df, targets, **MIX)) != pairs(mixed(df, targets, **{**MIX, "seed": 4}))


def test_mix_of_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([(1, "x y", "a")], "doc_id long, text string, source string")
    assert mixed(docs.limit(0), targets, **MIX).count() == 0 and mixed(docs, targets.limit(0), **MIX).count() == 0
    row = reached_shares(docs.limit(0), targets, **MIX).first()
    assert (row.copies, row.reached_share) == (0, 0.0)
    assert reached_shares(docs.withColumn("max_repeats", F.lit(9)), targets, **MIX).first().mix_tokens == 2


# ------------------------------------------------------------------------------------------- truncation

def sentence(rng):
    a, v, b = (rng.choice(w.split()) for w in ("shares profit margin output demand", "rose fell slipped gained stalled", "sharply again slightly twice strongly"))
    return f"The {a} of the company {v} {b} in {rng.choice('March April May June'.split())}."


def test_limits_and_endings_find_cuts(spark):
    rng = random.Random(0)
    rows, cut = [], set()
    for i in range(1500):
        t = " ".join(sentence(rng) for _ in range(rng.randrange(2, 14)))
        source = "limited" if i % 2 else "free"
        if source == "limited" and len(t) > 300:
            t, natural = t[:300], t[299:301] in (". ",) or t[299] == "."
            if not natural and not t.endswith(". "):
                cut.add(i)
        elif i % 40 == 0:
            t = t[: len(t) - rng.randrange(8, 30)]
            if not t.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, t, source))
    rows += [(5000, None, "free"), (5001, "", "free"), (5002, "  \n", None), (5003, "The profit of the company rose again in May.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"score": F.lit(1), "chars": F.lit(2), "_at": F.lit(3)})
    got = {r.doc_id: r for r in truncation_scores(df, row_id="doc_id", text="text", source="source").collect()}
    assert set(got) == {r[0] for r in rows} - {5000, 5001, 5002}
    found = {i for i, r in got.items() if r.score > 0.5}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.03 * len(cut) + 2
    at = [got[i].at_limit for i in cut if i % 2 and rows[i][2] == "limited"]
    assert np.mean([a is not None and a > 0.5 for a in at]) > 0.9 and 5003 not in found


def test_copies_and_patterns_are_no_limit(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(sentence(rng) for _ in range(n))
    rows = [(i, prose(rng.randrange(2, 14)), "copies" if i % 2 else "pattern") for i in range(1200)]
    whole = prose(9)[:260] + " Shares of the company in demand again"
    rows += [(10_000 + i, whole, "copies") for i in range(300)]  # a third of the source: one text without a full stop, again and again
    rows += [(20_000 + i, f"{i:05d} {prose(9)[:260]} Shares of the company in demand again", "pattern") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = truncation_scores(df, row_id="doc_id", text="text", source="source").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.at_limit is not None] == []
    assert not [r for r in got if r.score > 0.5 and 10_000 <= r.doc_id < 20_000]


def test_padding_after_a_cut_hides_nothing(spark):
    from tidewright.llm.truncation import _prepared

    cut, pad = "Output rose again. The profit of the comp", " " * 200
    texts = [cut, cut + pad, cut + "\n" * 160, cut + "... [+700 chars]", cut + "... [+700 chars]" + pad, cut + pad + "[+700 chars]" + pad]
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], "_id int, _text string, _source string, _kind string")
    got = {r._id: r for r in _prepared(df).collect()}
    assert [got[i].ending for i in (0, 1, 2, 5)] == [cut] * 4 and got[4].ending == got[3].ending == cut + "..."
    assert [got[i].unmarked for i in range(6)] == [None, None, None, len(cut) + 3, len(cut) + 3, len(cut)]


def test_truncation_of_tiny_tables(spark):
    df = spark.createDataFrame([(1, "A whole text.", "s")], "doc_id long, text string, source string")
    assert truncation_scores(df.limit(0), row_id="doc_id", text="text", source="source").count() == 0
    only = truncation_scores(df, row_id="doc_id", text="text", source="source").first()
    assert only.doc_id == 1 and 0 <= only.score < 0.5
    long = spark.createDataFrame([(i, "word " * 40_000 + "end.", "s") for i in range(3)], df.schema)
    assert truncation_scores(long, row_id="doc_id", text="text", source="source").count() == 3
