"""Sentiment, panel, feature, portfolio, statistics, retrieval, chart and model operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.errors import MissingColumnsError
from tidewright.functions.distributions import f_upper, t_two_sided, t_upper
from tidewright.functions.safe import log_return, pearson
from tidewright.operators import charts, features, panel, portfolio, retrieval, sentiment, stats
from tidewright.operators.models import Classifier, Regressor
from tidewright.operators.quantiles import exact_quantiles


def scores(spark, texts, scorer=sentiment.Scorer()):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.sentiment_score for r in sentiment.annotate(df, "t", scorer).orderBy("i").collect()]


def test_signs_bounds_and_negation(spark):
    texts = ["Record profit and strong growth", "Fraud probe deepens losses", "", None, "did not issue a profit warning", "issues a profit warning",
             "shipowner reports", "record earnings beat", "GREAT growth!!!", "growth", "not strong", "very strong", "weak but strong"]
    s = scores(spark, texts)
    assert all(-1 <= x <= 1 for x in s) and s[0] > 0.3 > 0 > s[1] and s[2] == s[3] == 0.0
    assert s[4] > 0 > s[5]  # the negator turns the phrase
    assert s[6] == pytest.approx(0.3)  # "ipo" inside a word counts
    assert s[8] > s[9] > 0 and s[10] < 0 and s[11] > scores(spark, ["strong"])[0] and s[12] > 0
    df = spark.createDataFrame([(1, "record earnings beat and weak strong growth"), (2, None)], "i int, t string")
    hits = sentiment.explain(df, "i", "t").orderBy("place").collect()
    assert [(h.place, h.token, h.valence) for h in hits] == [(1, "earnings beat", 2.5), (2, "record", 2.0), (3, "weak", -2.0), (4, "strong", 2.0), (5, "growth", 2.0)]
    assert [h.token for h in sentiment.explain(df, "i", "t", most=1).collect()] == ["earnings beat"]
    made = {r.i: r for r in sentiment.explain_scores(df, "i", "t").collect()}
    assert made[1].adjustment == pytest.approx(0.75) and made[1].score == pytest.approx(min(1, made[1].base + 0.75)) and made[2].hits == [] and made[2].score == 0.0


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [1e-3] * 5000)], "i int, e array<double>")
    got = {r.i: r.u for r in df.select("i", retrieval.unit(F.col("e")).alias("u")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is got[3] is got[4] is got[5] is None
    assert len(got[6]) == 5000 and sum(x * x for x in got[6]) == pytest.approx(1.0)


#: Headlines with the labels they should get; all but one must.
GOLDEN = (("Apple beats earnings estimates, raises guidance", "positif"), ("The company announced record revenue and a dividend hike", "positif"),
          ("Stock buyback programme worth $10 billion approved", "positif"), ("The company reported a loss and issued a profit warning", "négatif"),
          ("Chapter 11 bankruptcy protection filing announced", "négatif"), ("Credit downgrade from investment grade to junk", "négatif"),
          ("Analysts do not expect the firm to file for bankruptcy", "neutre"), ("The board met to discuss quarterly operational matters", "neutre"))


def test_golden_headlines(spark):
    got = sentiment.annotate(spark.createDataFrame(GOLDEN, "t string, want string"), "t").where("sentiment_label = want").count()
    assert got >= len(GOLDEN) - 1


def test_a_lexicon_of_real_size_from_a_table(spark):
    made = spark.range(4000).select(F.concat(F.lit("Word"), "id").alias("word"), (F.col("id") % 7 - 3).cast("double").alias("valence"))
    odd = spark.createDataFrame([("word5", -9.0), (None, 1.0), ("x", None)], "word string, valence double")
    scorer = sentiment.Scorer.from_table(made.unionByName(odd), phrases={f"p{i} q": 1.0 for i in range(200)} | {"b c": -2.0})
    assert len(scorer.words) == 4000 and scorer.words["word5"] == -9.0 and scorer.words["word6"] == 3.0
    plain = lambda v: v / math.sqrt(v * v + 15)
    assert scores(spark, ["word6", "not word6", "word3999", "p7 q", "a b c"], scorer) == pytest.approx([plain(3), plain(3 * -0.74), plain(3999 % 7 - 3), 0.3, -0.6])
    with pytest.raises(ValueError):
        sentiment.Scorer(words={f"w{i}": 1.0 for i in range(sentiment.MOST_WORDS + 1)})


def test_scorer_is_immutable_and_validated(spark):
    base = sentiment.Scorer()
    more = base.with_words({"Zork": 3.0}).without_words(["beat"]).with_phrases({"Moon shot": 2.0})
    assert "zork" in more.words and "zork" not in base.words and "beat" not in more.words and "moon shot" in more.phrases
    for bad in (dict(positive_from=0), dict(negative_to=0.1), dict(phrase_weight=2)):
        with pytest.raises(ValueError):
            sentiment.Scorer(**bad)
    assert base.snapshot(spark).count() == len(base.words)


def test_articles_are_decayed_sentence_means(spark):
    text = "Profit growth was strong this year. Fraud was found in the fund. Ok. The rest is neutral text here."
    one, flat = (sentiment.annotate_articles(spark.createDataFrame([(1, text), (2, None), (3, "strong")], "i int, t string"), "i", "t", decay=d) for d in (0.9, 1.0))
    parts = scores(spark, ["Profit growth was strong this year.", "Fraud was found in the fund.", "The rest is neutral text here."])
    got = {r.i: r for r in flat.collect()}
    assert got[1].n_sentences == 3 and got[1].score == pytest.approx(np.mean(parts)) and got[2].score == 0.0 and got[3].score > 0
    w = 0.9 ** np.arange(3)
    assert {r.i: r.score for r in one.collect()}[1] == pytest.approx((parts * w).sum() / w.sum())


def test_replies(spark):
    df = spark.createDataFrame([("0.4 I think",), ("-7",), ("quite bullish",), ("a weak one",), ("hm",), ("<reasoning>r</reasoning> <output> o </output>",)], "r string")
    got = [x.s for x in df.select(sentiment.parse_model_score(F.col("r")).alias("s")).collect()]
    assert got[:5] == [0.4, -1.0, 0.7, -0.7, 0.0]
    last = df.select(sentiment.parse_reasoning(F.col("r")).alias("p")).collect()
    assert (last[5].p.output, last[5].p.reasoning, last[4].p.output, last[4].p.reasoning) == ("o", "r", "hm", None)


def test_tiered_lexicon(spark):
    rows = [("GAIN", 2009, 0, 0, 0, 0), ("no", 0, 2009, 0, 0, 0), ("sue", 0, 0, 1, 1, 0), ("market", 0, 0, 0, 0, 0), ("beat", 0, 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "word string, positive int, negative int, litigious int, uncertainty int, constraining int")
    got = {r.word: r.valence for r in sentiment.tiered_lexicon(df).collect()}
    assert (got["gain"], got["sue"], got["market"], got["beat"], got["surges"]) == (2.5, -1.0, 0.0, -2.5, 1.5) and "no" not in got


def test_daily_sentiment_of_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, "a", None, None), (1, "b", 0.5, "positif")], "day int, ticker string, sentiment_score double, sentiment_label string")
    got = {r.ticker: r for r in panel.daily_sentiment(df).collect()}
    assert (got["a"].sentiment_sum, got["a"].sentiment_mean, got["a"].n_articles, got["b"].sentiment_std) == (0.0, None, 0, None)
    with pytest.raises(MissingColumnsError):
        panel.daily_sentiment(df.drop("day"))


def test_returns_never_raise(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, -1.0), ("a", 4, 4.0), ("a", 5, 8.0)], "ticker string, day int, close_price double")
    assert [r.log_return for r in panel.log_returns(df).orderBy("day").collect()] == [0, 0, 0, 0, pytest.approx(math.log(2))]
    assert panel.latest_change(df).first().latest_change == 1.0
    assert spark.range(1).select(log_return(F.lit(1.0), F.lit(None).cast("double")).alias("x")).first().x == 0.0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_features_of_small_and_constant_cells(spark):
    rows = [("a", 1, 0.5, "positif")] * 3 + [("b", 1, -0.2, "négatif"), ("b", 1, 0.6, "positif")]
    got = {r.ticker: r for r in features.sentiment_features(spark.createDataFrame(rows, "ticker string, period int, sentiment_score double, sentiment_label string")).collect()}
    assert got["a"].score_skew == 0.0 and got["a"].std_score == 0.0 and got["b"].score_range == pytest.approx(0.8)
    assert got["a"].news_burst == 1 and got["b"].news_burst == 0 and got["b"].sentiment_balance == 0.0


def test_betas(spark):
    rng = np.random.default_rng(1)
    rows = [("y", float(2 * m + 0.01), float(m)) for m in rng.normal(size=30)] + [("x", 0.1, 0.2)] * 5 + [("c", 0.3, 0.5)] * 30 + [(None, 1.0, 1.0), ("y", None, 1.0), ("y", math.nan, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, ret double, mkt_ret double")
    got = {r.ticker: (r.alpha, r.beta, r.n_obs) for r in features.market_betas(df).collect()}
    assert got["y"] == (pytest.approx(0.01), pytest.approx(2.0), 30) and got["x"] == (0.0, 1.0, 5) and set(got) == {"x", "y", "c"}
    assert got["c"][:2] == (pytest.approx(0.3 / 1.25), pytest.approx(0.5 * 0.3 / 1.25))
    one = features.abnormal_returns(df, features.market_betas(df)).where("ticker = 'x'").first()
    assert one.abnormal_ret == pytest.approx(0.1 - 0.2)


@pytest.mark.parametrize("kind", ["equal", "score", "softmax", "rank"])
def test_weights_sum_to_one(spark, kind):
    rows = [(p, f"t{i}", float(s)) for p, ss in ((1, [3, 1, 2, 2]), (2, [5, 5, 5]), (3, [1])) for i, s in enumerate(ss)] + [(1, "n", None), (1, "m", math.nan)]
    chosen = portfolio.choose(spark.createDataFrame(rows, "period int, ticker string, score double"), "period", "ticker", "score", 3)
    got = portfolio.weighted(chosen, kind, "period").collect()
    for p in (1, 2, 3):
        assert sum(r.weight for r in got if r.period == p) == pytest.approx(1.0)
    assert {r.ticker for r in got if r.period == 1} == {"t0", "t2", "t3"}
    if kind in ("equal", "score"):
        assert all(r.weight == pytest.approx(1 / 3) for r in got if r.period == 2)


def test_large_scores_keep_their_weights(spark):
    df = spark.createDataFrame([(1, "a", 800.0), (1, "b", 799.0), (2, "a", 1e300), (2, "b", -1e300)], "period int, ticker string, score double")
    soft = {(r.period, r.ticker): r.weight for r in portfolio.build(df, "period", "ticker", 5, "softmax").collect()}
    assert soft[1, "a"] == pytest.approx(1 / (1 + math.exp(-1))) and soft[1, "b"] == pytest.approx(1 - soft[1, "a"]) and soft[2, "b"] == 0.0
    own = portfolio.build(df.where("period = 1"), "period", "ticker", 5, lambda s: np.array([0.9, 0.1])).collect()
    assert {r.ticker: r.weight for r in own} == {"a": 0.9, "b": 0.1}


def test_built_by_models(spark):
    class Says:
        def __init__(self, name):
            self.name = name

        def predict(self, df):
            return df.withColumn("prediction", F.col(self.name)).withColumn("probability_1", F.col(self.name)) if self.name == "p" else df.withColumn("prediction", F.col(self.name))

    df = spark.createDataFrame([(1, "a", 0.9, 0.1), (1, "b", 0.5, 0.4), (1, "c", 0.1, 0.9), (1, "d", 0.9, -1.0)], "period int, ticker string, p double, r double")
    got = portfolio.build_by_models(df, Says("p"), Says("r"), "period", "ticker", 2).collect()
    assert {r.ticker: (round(r.score, 6), r.weight) for r in got} == {"b": (0.2, 0.5), "a": (0.09, 0.5)}
    other = portfolio.build_by_models(df, Says("p"), Says("r"), "period", "ticker", 1, combine=lambda p, r: r - p).collect()
    assert [r.ticker for r in other] == ["c"]
    with pytest.raises(ValueError):
        portfolio.build_by_models(df, None, Says("r"), "period", "ticker", 2)


def test_frequencies_and_unknown_weighting():
    assert portfolio.periods_a_year("daily") == 252 and portfolio.periods_a_year(7) == 7
    for bad in (lambda: portfolio.periods_a_year("x"), lambda: portfolio.build(None, "p", "i", 3, "x"), lambda: portfolio.build(None, "p", "i", 0)):
        with pytest.raises(ValueError):
            bad()


def test_ledger_without_costs_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    prices = [(f"{p}", t, float(rng.uniform(5, 20))) for p in range(1, 8) for t in "abc"]
    targets = [("B", f"{p}", t, w) for p in range(1, 8) for t, w in zip("abc", rng.dirichlet([1, 1, 1]).tolist())]
    px = spark.createDataFrame(prices, "period string, ticker string, price double")
    tg = spark.createDataFrame(targets, "book string, period string, ticker string, weight double")
    fold = portfolio.rebalance(tg, px, 1000.0).groupBy("period").agg(F.max("value").alias("v")).collect()
    closed = {r.period: r.value for r in portfolio.frictionless_value(tg, px).collect()}
    for r in fold:
        assert r.v == pytest.approx(1000.0 * closed.get(r.period, 1.0))
    ended = portfolio.rebalance(tg, px, 1000.0, 0.001, close=True).orderBy("seq").collect()
    shares = {}
    for r in ended:
        shares[r.ticker] = shares.get(r.ticker, 0) + (r.shares if r.action == "buy" else -r.shares)
    assert all(abs(v) < 1e-9 for v in shares.values()) and ended[-1].cash_after > 0
    assert charts.trade_summary(portfolio.rebalance(tg, px, 1000.0)).where("period = '1'").first().buys == 3


def test_unpriced_position_is_frozen(spark):
    px = spark.createDataFrame([("1", "a", 10.0), ("2", "b", 5.0), ("3", "a", 20.0), ("3", "b", 5.0)], "period string, ticker string, price double")
    tg = spark.createDataFrame([("B", "1", "a", 1.0), ("B", "2", "b", 1.0), ("B", "3", "b", 1.0)], "book string, period string, ticker string, weight double")
    got = [(r.period, r.ticker, r.action, round(r.shares, 6), round(r.value, 6)) for r in portfolio.rebalance(tg, px, 100.0).orderBy("seq").collect()]
    assert got == [("1", "a", "buy", 10.0, 100.0), ("3", "a", "sell", 10.0, 200.0), ("3", "b", "buy", 40.0, 200.0)]


def test_compounding_keeps_signs_and_drawdown(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 1.0), (2, "a", -1.5, 1.0), (3, "a", 0.2, 1.0)], "period int, ticker string, ret double, weight double")
    perf = portfolio.performance(df, df, "period", "ret").orderBy("period").collect()
    assert [round(r.cum_port, 9) for r in perf] == [0.5, -1.75, -1.9]
    curve = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 1.5), ("b", 1, 1.0)], "k string, o int, v double")
    assert {r.k: r.max_drawdown for r in portfolio.drawdown(curve, "k", "o", "v").collect()} == {"a": -0.25, "b": 0.0}


def test_tail_probabilities():
    assert t_upper(1.812, 10) == pytest.approx(0.05, abs=1e-4) and t_upper(-1.812, 10) == pytest.approx(0.95, abs=1e-4)
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4) and f_upper(3.326, 5, 10) == pytest.approx(0.05, abs=1e-3) and f_upper(-1, 2, 2) == 1.0


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = x @ [0.5, -0.2] + rng.normal(size=80) * (0.1 + abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0), (math.nan, 1.0, 1.0)], "a double, b double, y double")
    got = stats.ols_hc3(df, "y", ["a", "b"], intercept=True)
    m = np.column_stack([np.ones(80), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    e, h = y - m @ beta, np.einsum("ij,jk,ik->i", m, inv, m)
    se = np.sqrt(np.diag(inv @ (m.T * (e / (1 - h)) ** 2) @ m @ inv))
    assert got["coef"] == pytest.approx(beta.tolist()) and got["se"] == pytest.approx(se.tolist()) and got["n"] == 80
    assert got["p"] == [t_two_sided(t, 77) for t in got["t"]] and got["t"] == pytest.approx((beta / se).tolist())
    with pytest.raises(ValueError):
        stats.ols_hc3(df.limit(2), "y", ["a", "b"])


def test_mean_and_correlation_tests(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 7 + (i % 3)), 1.0) for i in range(60)], "x double, y double, c double")
    assert stats.one_sided(df, "x")["significant"] and stats.correlation_p(df, "x", "y")["p"] < 1e-6
    assert stats.mean_test(df, "c").first().t is None and math.isnan(stats.correlation_p(df, "x", "c")["p"])
    assert stats.forecast_gain(df, "y", "x").first().t > 0


def test_permutations(spark):
    df = spark.createDataFrame([(int(i % 2 == 0), int(i % 2 == 0)) for i in range(40)], "a int, p int")
    good = stats.permutation_p(df, "a", "p", 2000)
    assert good["f1"] == 1.0 and good["p"] < 0.01 and good["exact_p"] < 1e-6
    noise = spark.createDataFrame([(int(i % 2 == 0), int(i % 3 == 0)) for i in range(60)], "a int, p int")
    r = stats.permutation_p(noise, "a", "p", 4000)
    assert abs(r["p"] - r["exact_p"]) < 0.05
    empty = stats.confusion(df.where("a > 5"), "a", "p").first()
    assert (empty.tp, empty.f1, empty.precision) == (0, 0.0, 0.0)


def test_permutations_do_not_depend_on_tasks(spark):
    df = spark.createDataFrame([(int(i % 2 == 0), int(i % 3 == 0)) for i in range(60)], "a int, p int")
    whole = stats.permutation_f1(df, "a", "p", 40)
    single = {r.permutation: r.f1 for r in whole.collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {r.permutation: r.f1 for r in stats.permutation_f1(df, "a", "p", 40).collect()} == single
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(set(single.values())) > 1


def test_joint_tests_and_descriptions(spark):
    rows = [(float(i % 7), float(i % 7 + (i % 3)), float(i % 5), None if i % 11 else 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "x double, y double, z double, hole double")
    pair = stats.correlation_tests(df, ("x", "z"), "y")
    assert pair["n"] == 80 and pair["r_x"] == pytest.approx(np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1]) and pair["significant"]
    classes = df.select((F.col("x") > 3).cast("int").alias("a"), (F.col("y") > 3).cast("int").alias("p"))
    found = stats.all_tests(df.select(F.col("x").alias("excess")), df, ("x", "z"), "y", classes, df.select("y", F.col("x").alias("e")), 200)
    assert set(found) == {"alpha", "correlation", "permutation", "diebold_mariano"} and all("significant" in f for f in found.values())
    told = {r.column: r for r in stats.described(df, ("x", "hole")).collect()}
    assert (told["hole"].n, told["hole"].nulls, told["hole"].sd, told["x"].largest) == (8, 72, 0.0, 6.0)
    far = stats.drift(spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert (far.n, far.mean_abs, far.largest) == (2, 1.5, 2.0)
    cells = {tuple(r) for r in stats.confusion_by(spark.createDataFrame([("t", 1, 0), ("t", 1, 0), ("v", 0, 0)], "s string, a int, p int"), "s", "a", "p").collect()}
    assert cells == {("t", 1, 0, 2), ("v", 0, 0, 1)}


def test_monthly_features_follow_their_rules(spark):
    def row(month, day, total, ret):
        return ("a", (np.datetime64(f"2015-{month:02d}-{day:02d}") - np.datetime64("1970-01-01")).astype(int).item(), total, total / 2, 0.1, 2, 0.6, 0.2, ret)

    rows = [row(m, d, float(m * 10 + d), 0.01 * m * (-1) ** d) for m in range(1, 7) for d in (1, 2)] + [row(7, 1, 5.0, 0.1), row(8, 1, 6.0, 0.1), row(8, 2, 7.0, 0.2), row(9, 1, 1.0, -0.1)]
    df = spark.createDataFrame(rows, "ticker string, day int, sentiment_sum double, sentiment_mean double, sentiment_std double, n_articles int, pct_positif double, pct_negatif double, log_return double")
    got = {r.ym: r for r in panel.monthly_features(df).collect()}
    assert sorted(got) == [201503, 201504, 201505, 201506, 201507]  # 8 has no lagged deviation, 9 no target, 1 and 2 too short a past
    assert got[201504].sent_lag1 == pytest.approx(31.5) and got[201507].sent_sum_std is None and got[201507].monthly_vol is None
    assert got[201505].ret_lag2 == pytest.approx(0.0) and got[201507].target_return == pytest.approx(0.3) and got[201507].target_class == 1
    assert set(panel.MONTHLY_COLUMNS) <= set(got[201503].asDict())


def test_exact_quantiles_of_huge_small_and_odd_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"big": rng.normal(size=4000).round(2).tolist(), "one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 50, None: [5.0, -0.0, 0.0], "none": [None, math.nan, math.inf]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7).withColumn("_n", F.lit(1)).withColumn("n", F.lit("clash"))
    shares = (0.0, 0.001, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r for r in exact_quantiles(df, ("g",), "v", shares).collect()}
    assert set(got) == {"big", "one", "two", "same", None}
    for g, r in got.items():
        assert r.n == len(groups[g]) and r.quantiles == pytest.approx(np.quantile(groups[g], shares).tolist())
    assert exact_quantiles(df.where("g = 'none'"), (), "v", (0.5,)).count() == 0
    assert exact_quantiles(df.where("g = 'two'"), (), "v", (0.5,)).first().quantiles == [1.5]
    with pytest.raises(ValueError):
        exact_quantiles(df, (), "v", (1.5,))


def test_hinted_and_audited_rewrites(spark):
    news = spark.createDataFrame([(1, "record revenue and profit of 5 bn. Weather was fine."), (2, "zzz qqq " * 9), (3, None)], "i int, t string")
    corpus = retrieval.hint_corpus(spark, sentiment.Scorer(words={"profit": 2.0, "loss": -2.0, "market": 0.0}, phrases={"record revenue": 2.0}), retrieval.trigram_embedding)
    assert {r.term for r in corpus.collect()} == {"profit", "loss", "record revenue"}
    near = retrieval.nearest_terms(retrieval.embedded(news, "t", retrieval.trigram_embedding), corpus, query_id="i", term="term", embedding="embedding", valence="valence", least=0.2)
    hints = retrieval.hint_lists(near, "i")
    assert {r.i: (r.positive, r.negative) for r in hints.collect()} == {1: (["record revenue", "profit"], [])}
    got = {r.i: r for r in retrieval.normalise(news, "t", retrieval.FactsBackend(), "rewrite", 10, hints=hints, row_id="i").collect()}
    assert "record revenue, profit" in got[1].prompt_used and "bad news: none" in got[1].prompt_used and got[1].normalized_text == "record revenue and profit of 5 bn."
    assert got[2].prompt_used == retrieval.PROMPTS["rewrite"].replace("{text}", "zzz qqq " * 9) and got[3].prompt_used is None and not got[3].llm_used
    scored = {r.i: r for r in retrieval.Annotator(backend=retrieval.FactsBackend(), threshold=10).annotate(news, "t").collect()}
    assert scored[1].sentiment_score > 0.3 and scored[1].normalized_text and scored[3].normalized_text is None and scored[3].sentiment_score == 0.0
    assert retrieval.Annotator(backend=retrieval.FactsBackend(), threshold=10).articles(news, "i", "t").count() == 3
    mean = retrieval.ensemble(spark.createDataFrame([(0.5, 0.1), (None, -0.2), (None, None)], "a double, b double"), ("a", "b")).collect()
    assert [(r.ensemble_score, r.ensemble_label) for r in mean] == [(0.3, "positif"), (-0.2, "négatif"), (None, None)]


def test_chart_data(spark):
    df = spark.createDataFrame([(float(i), i % 2 * 1.0, "a" if i < 30 else "b") for i in range(101)], "v double, flag double, l string")
    t = charts.tails(df, "v", 0.1).first()
    assert (t.n, t.mean, t.low_tail, t.high_tail) == (101, 50.0, 10.0, 90.0)
    points = charts.normal_points(df, "v", 3).orderBy("point").collect()
    assert [p.observed for p in points] == [25.0, 50.0, 75.0] and points[1].theoretical == pytest.approx(0.0)
    s = charts.share_positive(df, "v").first()
    assert (s.q1, s.median, s.q3, round(s.share_over_0, 6)) == (25.0, 50.0, 75.0, round(100 / 101, 6))
    bars = charts.overview(df, ("v", "flag"), 10).collect()
    assert sum(b.n for b in bars if b.column == "v") == 101 and sorted((b.low, b.n) for b in bars if b.column == "flag") == [(0.0, 51), (1.0, 50)]
    assert [(r.label, r.n) for r in charts.label_counts(df, "l", ("b", "a", "c")).orderBy("place").collect()] == [("b", 71), ("a", 30), ("c", 0)]
    curve = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("x", 3, 1.0), ("y", 1, 2.0), ("y", 2, 3.0), ("y", 3, 4.0)], "m string, p int, v double")
    assert [(r.m, r.final_pct, r.max_drawdown, r.place) for r in charts.compared(curve, "m", "p", "v", "x").orderBy("place").collect()] == [("y", 300.0, 0.0, 1), ("x", 0.0, -0.5, 2)]
    ends = {(r.side, r.l) for r in panel.extremes(spark.createDataFrame([(1.0, "a"), (2.0, "b"), (math.nan, "c"), (None, "d")], "v double, l string"), "v", "l", 1).collect()}
    assert ends == {("largest", "b"), ("smallest", "a")}
    maps = panel.maps_of(spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (1, None, 9.0), (2, "b", 1.0)], "d int, k string, v double"), ("d",), "k", "v").collect()
    assert {r.d: r["values"] for r in maps} == {1: {"a": 3.0}, 2: {"b": 1.0}}


def test_hints_against_numpy(spark):
    rng = np.random.default_rng(5)
    vocabulary = [(f"t{i:02d}", rng.normal(size=6).tolist(), float(rng.choice([-1, 0, 1]))) for i in range(40)] + [("zero", [0.0] * 6, 1.0)]
    queries = [(i, rng.normal(size=6).tolist()) for i in range(8)] + [(99, None)]
    terms = spark.createDataFrame(vocabulary, "term string, e array<double>, v double")
    got = retrieval.nearest_terms(spark.createDataFrame(queries, "q int, e array<double>"), terms, query_id="q", term="term", embedding="e", valence="v", k=4, least=0.2)
    found = {}
    for r in got.collect():
        found.setdefault(r.q, set()).add(r.term)
    for q, e in queries[:-1]:
        sims = sorted(((-np.dot(e, x) / np.linalg.norm(e) / np.linalg.norm(x), t, v) for t, x, v in vocabulary if v and any(x)))[:12]
        close = [(t, v) for s, t, v in sims if -s >= 0.2]
        want = {t for t, v in [c for c in close if c[1] > 0][:2] + [c for c in close if c[1] < 0][:2]}
        assert found.get(q, set()) == want
    assert 99 not in found


def test_hints_of_many_blocks_without_collecting_terms(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = [(i, rng.integers(-1, 2, size=4).astype(float).tolist(), float(rng.choice([-1, 1]))) for i in range(300)]  # many equal similarities
    queries = [(i, rng.integers(-1, 2, size=4).astype(float).tolist()) for i in range(11)]
    queries = [(i, e) for i, e in queries if any(e)]
    terms = spark.createDataFrame(vocabulary, "term long, e array<double>, v double").repartition(5)
    monkeypatch.setattr(retrieval, "BLOCK", 4, raising=False)
    monkeypatch.setattr(retrieval, "SLICE", 16, raising=False)
    with monkeypatch.context() as m:
        m.setattr(type(terms), "toPandas", lambda *_: pytest.fail("the terms came to the driver"))
        got = retrieval.nearest_terms(spark.createDataFrame(queries, "q int, e array<double>"), terms, query_id="q", term="term", embedding="e", valence="v", k=4, least=0.2)
        found = {(r.q, r.term, r.v, r.place) for r in got.collect()}
    want = set()
    for q, e in queries:
        sims = sorted((-round(np.dot(e, x) / np.linalg.norm(e) / np.linalg.norm(x), 12), t, v) for t, x, v in vocabulary if any(x))[:12]
        for side in (1, -1):
            want |= {(q, t, v, n + 1) for n, (_, t, v) in enumerate([s for s in sims if s[2] == side and -s[0] >= 0.2][:2])}
    assert found == want


def test_registered_hints_search_all_rows_but_the_own(spark, tmp_path):
    from tidewright.plans.news_panel import catalogue

    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(90, 5))
    vectors[[20, 40, 61]] = vectors[0] + rng.normal(size=(3, 5)) * 0.01  # related vectors, two of them queries themselves
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r.term, r.valence) for r in catalogue.queries["cosine_hints"](spark, str(tmp_path)).collect()}
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 90, 20):
        best = [t for t in np.argsort(-(x @ x[q]), kind="stable").tolist() if t != q][:24]
        for sign in (0, 1):
            want |= {(q, t, (1.0, -1.0)[sign]) for t in [t for t in best if t % 2 == sign and x[t] @ x[q] >= 0.2][:4]}
    assert got == want and {(0, 20, 1.0), (20, 0, 1.0)} <= got


def test_normaliser_routes_by_length(spark):
    df = spark.createDataFrame([(1, "short"), (2, "long " * 100), (3, None)], "i int, t string")
    got = {r.i: r for r in retrieval.normalise(df, "t", retrieval.FactsBackend(), batch=1).collect()}
    assert (got[1].llm_used, got[1].normalized_text, got[2].llm_used, got[2].reasoning_trace, got[3].normalized_text) == (False, "short", True, "0 sentences with figures", None)
    with pytest.raises(ValueError):
        retrieval.normalise(df, "t", retrieval.FactsBackend(), mode="x")


def test_charts(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,), (math.nan,)], "v double")
    assert [r.n for r in charts.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    assert [r.n for r in charts.histogram(df.where("v = 1"), "v", 3).orderBy("bin").collect()] == [1, 0, 0]
    assert charts.histogram(df.where("v > 99"), "v", 3).count() == 0


def test_scalers_and_splits(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 3.0, 7.0), (3, None, 7.0)], "p int, a double, b double")
    got = panel.standardised(df, ("a", "b"), F.col("p") <= 2).orderBy("p").collect()
    assert [(r.a, r.b) for r in got] == [(-1.0, 0.0), (1.0, 0.0), (-2.0, 0.0)]
    robust = panel.robust_scaled(df, ("a", "b"), F.col("p") <= 2).orderBy("p").collect()
    assert [(r.a, r.b) for r in robust] == [(-1.0, 0.0), (1.0, 0.0), (-2.0, 0.0)]
    months = spark.createDataFrame([("a", m, float(m), 0.1 * (m - 2), int(m > 2)) for m in range(1, 6)], "ticker string, ym int, x double, target_return double, target_class int")
    cut = panel.prepare_splits(months, ("x",), 3, 4)
    assert [(r.split, round(r.x, 6), r.robust_x) for r in cut.scaled.orderBy("ym").collect()] == [
        ("train", -1.224745, -1.0), ("train", 0.0, 0.0), ("train", 1.224745, 1.0), ("validation", 2.44949, 2.0), ("test", 3.674235, 3.0)]
    assert [r.ym for r in cut.rising.orderBy("ym").collect()] == [3, 4] and cut.part("validation").count() == 1
    assert [r.asDict() for r in cut.test_frame.collect()] == [{"ticker": "a", "period": 5, "fwd_log_ret": pytest.approx(0.3)}]
    assert [r.s for r in df.select(panel.split_name(F.col("p"), 1, 2).alias("s")).collect()] == ["train", "validation", "test"]


def test_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(a > 0), float(2 * a)) for a, b in rng.normal(size=(120, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int, z double")
    clf = Classifier(["a", "b"], "y")
    with pytest.raises(RuntimeError):
        clf.fit(df)
    with pytest.raises(RuntimeError):
        clf.save(str(tmp_path / "m"))
    clf.optimise(df, df, lambda rng: {"maxIter": rng.choice([2, 3]), "maxDepth": 2}, trials=1)
    assert clf.fit(df).evaluate(df).first().f1 > 0.9 and clf.importances()[0][0] == "a"
    assert {"prediction", "probability_1"} <= set(clf.predict(df).columns)
    clf.save(str(tmp_path / "m"))
    again = Classifier(["a", "b"], "y").load(str(tmp_path / "m"))
    assert again.evaluate(df).first().f1 > 0.9 and again.best == clf.best and again.fit(df).model is not None
    worst = Classifier(["a", "b"], "y")
    worst.optimise(df, df, lambda rng: {"maxIter": rng.choice([1, 2]), "maxDepth": 1}, trials=2, measure=lambda p: -p.count())
    assert worst.best_score == -120
    with pytest.raises(TypeError):
        Regressor(["a", "b"], "z").load(str(tmp_path / "m"))
    assert Regressor(["a", "b"], "z").fit(df, {"maxIter": 3, "maxDepth": 3}).evaluate(df).first().r2 > 0.5
