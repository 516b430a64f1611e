"""Queries of models and built portfolios, of joint tests, and of the data behind further charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.functions import wordlists as W
from tidewright.functions.safe import pearson
from tidewright.operators import charts, features as feat, panel, portfolio as pf, retrieval, sentiment, stats
from tidewright.operators.models import Classifier, Regressor
from tidewright.plans import news_panel as N
from tidewright.plans.news_panel import FULL, PLAIN, _r, _rounded
from tidewright.plans.registry import Catalogue
from tidewright.runtime import cut_lineage

catalogue = Catalogue()

# ------------------------------------------------------------------------------ portfolios and models

_BUILT = N._UNIVERSE + """, t as (select *, row_number() over (partition by period order by score desc, ticker) as place from u qualify place <= 25)"""


@catalogue.add("build_from_scores", f"with {_BUILT} select period, ticker, cast(place as bigint) as place, round((1.0 / place) / sum(1.0 / place) over (partition by period), 6) as weight, round(ret, 9) as ret from t")
def q_build_from_scores(spark, folder):
    built = pf.build(N.universe(spark, folder), "period", "ticker", 25, "rank")
    return built.select("period", "ticker", F.col("place").cast("long").alias("place"), _r("weight"), _r("ret", 9))


FEATURES = ("mean_score", "sentiment_balance", "n_articles", "roll_vol_20")
_PANEL = N._FEATURES + """, g as (select ticker, cast(strftime(period, '%Y%m') as bigint) as ym, period,
  lag(mean_score) over w as mean_score, lag(sentiment_balance) over w as sentiment_balance, cast(lag(n_articles) over w as double) as n_articles, lag(roll_vol_20) over w as roll_vol_20,
  ret as target_return from f window w as (partition by ticker order by period)),
p as (select *, case when target_return > 0 then 1 else 0 end as target_class, case when ym <= 201512 then 'train' when ym <= 201712 then 'validation' else 'test' end as split from g where target_return is not null)"""


def model_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's return of a ticker with the features of its row before."""
    lagged = panel.lag_columns(N.latest_features(spark, folder).withColumn("n_articles", F.col("n_articles").cast("double")), FEATURES, "ticker", "period")
    return lagged.where("ret is not null").select(
        "ticker", F.date_format("period", "yyyyMM").cast("long").alias("ym"), "period", *FEATURES, F.col("ret").alias("target_return"),
        F.when(F.col("ret") > 0, 1).otherwise(0).alias("target_class"))


def _splits(spark, folder) -> panel.Splits:
    return panel.prepare_splits(model_panel(spark, folder), FEATURES, 201512, 201712)


@catalogue.add("split_parts", f"with {_PANEL}, z as (select split, target_class, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in FEATURES) + " from p), m as (select "
               + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}, median({c}) as q_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as r_{c}" for c in FEATURES)
               + " from z where split = 'train') select split, count(*) as n, count(*) filter (where target_class = 1 and split <> 'test') as rising, "
               + ", ".join(f"round(avg(({c} - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end), 6) as standard_{c}, round(avg(({c} - q_{c}) / case when r_{c} > 0 then r_{c} else 1 end), 6) as robust_{c}" for c in FEATURES)
               + " from z, m group by split")
def q_split_parts(spark, folder):
    """Size of every split and the means of its scaled features."""
    s = _splits(spark, folder)
    means = [F.round(F.avg(c), 6).alias(c if c in s.robust else f"standard_{c}") for c in (*s.features, *s.robust)]
    rising = s.rising.groupBy("split").agg(F.count(F.lit(1)).alias("rising"))
    return s.scaled.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *means).join(rising, "split", "left").na.fill(0, ["rising"])


def _fitted(s: panel.Splits) -> tuple[Classifier, Regressor]:
    """A classifier of rises and a regressor of the rises' size, by boosted trees with a fixed seed."""
    small, rising = {"maxIter": 8, "maxDepth": 3}, s.rising.where("split = 'train'")
    return Classifier(s.features, "target_class").fit(s.part("train"), small), Regressor(s.robust, "target_return").fit(rising, small)


@catalogue.add("model_evaluation")
def q_model_evaluation(spark, folder):
    """F1, precision and recall of the classifier and RMSE, MAE, R2 of the regressor on each split."""
    s = _splits(spark, folder)
    clf, reg = _fitted(s)
    each = [clf.evaluate(s.part(name)).join(F.broadcast(reg.evaluate(s.part(name)))).withColumn("split", F.lit(name)) for name in ("train", "validation", "test")]
    return _rounded(reduce(DataFrame.unionByName, each), 9)


@catalogue.add("model_confusions")
def q_model_confusions(spark, folder):
    """The classifier's confusion matrix by split."""
    s = _splits(spark, folder)
    said = _fitted(s)[0].predict(s.scaled)
    return stats.confusion_by(said.withColumn("prediction", F.col("prediction").cast("int")), "split", "target_class", "prediction")


@catalogue.add("model_importances")
def q_model_importances(spark, folder):
    """Features by importance for both models; ``from_text`` marks those made from scored texts."""
    rows = [(kind, i + 1, f, float(v), "sent" in f or "score" in f) for kind, m in zip(("classifier", "regressor"), _fitted(_splits(spark, folder)))
            for i, (f, v) in enumerate(m.importances())]
    return _rounded(spark.createDataFrame(rows, "model string, place int, feature string, importance double, from_text boolean"), 9)


@catalogue.add("model_portfolio")
def q_model_portfolio(spark, folder):
    """Ten tickers a day by the probability of a rise times its predicted size, in the test part, equally weighted."""
    s = _splits(spark, folder)
    built = pf.build_by_models(s.part("test"), *_fitted(s), "period", "ticker", 10)
    return _rounded(built.select("period", "ticker", "pred_prob", "pred_ret", "score", "weight"), 9)


@catalogue.add("confusion_by_split", f"with {_PANEL} select split, target_class, case when mean_score > 0 then 1 else 0 end as prediction, count(*) as n from p group by all")
def q_confusion_by_split(spark, folder):
    """A rise said where the score before is over 0, against what came, by split."""
    rows = model_panel(spark, folder).withColumn("split", panel.split_name(F.col("ym"), 201512, 201712))
    return stats.confusion_by(rows.withColumn("prediction", F.when(F.col("mean_score") > 0, 1).otherwise(0)), "split", "target_class", "prediction")


# ----------------------------------------------------------------------------------------------- tests

@catalogue.add("correlation_pair", f"with {N._FEATURES}, c as (select * from f where mean_score is not null and sentiment_balance is not null and ret is not null) "
               "select count(*) as n, round(corr(mean_score, ret), 6) as r_mean_score, round(corr(sentiment_balance, ret), 6) as r_sentiment_balance from c")
def q_correlation_pair(spark, folder):
    found = stats.correlation_tests(N.latest_features(spark, folder), ("mean_score", "sentiment_balance"), "ret")
    return spark.createDataFrame([(found["n"], round(found["r_mean_score"], 6), round(found["r_sentiment_balance"], 6))], "n long, r_mean_score double, r_sentiment_balance double")


@catalogue.add("hypothesis_tests")
def q_hypothesis_tests(spark, folder):
    """The four tests on one panel: (test, statistic, p, significant)."""
    rows = N.latest_features(spark, folder)
    known = rows.where("ret is not null and mean_score is not null and mkt_ret is not null")
    found = stats.all_tests(N._perf(spark, folder)[1], rows, ("mean_score", "sentiment_balance"), "ret", N._classes(spark, folder),
                            known.select(F.col("ret").alias("y"), F.col("mkt_ret").alias("e")), permutations=2000)
    table = [("alpha", found["alpha"]["t"], found["alpha"]["p"], found["alpha"]["significant"]),
             ("correlation", found["correlation"]["r_mean_score"], found["correlation"]["p_mean_score"], found["correlation"]["significant"]),
             ("permutation", found["permutation"]["f1"], found["permutation"]["p"], found["permutation"]["significant"]),
             ("diebold_mariano", found["diebold_mariano"]["t"], found["diebold_mariano"]["p"], found["diebold_mariano"]["significant"])]
    return _rounded(spark.createDataFrame(table, "test string, statistic double, p double, significant boolean"))


# ---------------------------------------------------------------------------------------------- scores

@catalogue.add("score_drift", f"""with {N._SCORED}, lex as (select * from lexicon), tok as (select news_id, unnest(regexp_extract_all(lower(headline), '[a-z]+')) as w from n),
s2 as (select n.news_id, coalesce(sum(v), 0) as s from n left join tok using (news_id) left join lex on w = word group by 1),
ph as (select news_id, avg(a) * 0.3 as a from n join phrase_table on contains(lower(headline), phrase) group by news_id),
d as (select abs(score - greatest(-1, least(1, s / sqrt(s * s + 15) + coalesce(a, 0)))) as d from s2 left join ph using (news_id) join sl using (news_id))
select count(*) as n, round(avg(d), 6) as mean_abs, round(max(d), 6) as largest from d""")
def q_score_drift(spark, folder):
    """How far the study's scorer and the full rules lie apart."""
    both = sentiment.annotate(sentiment.annotate(N.clean_news(spark, folder), "headline", PLAIN, "plain", None), "headline", FULL, "full", None)
    return _rounded(stats.drift(both, "plain", "full"))


@catalogue.add("ensemble_scores", f"""with {N._SCORED}, lex as (select * from lexicon), tok as (select news_id, unnest(regexp_extract_all(lower(headline), '[a-z]+')) as w from n),
s2 as (select n.news_id, coalesce(sum(v), 0) as s from n left join tok using (news_id) left join lex on w = word group by 1),
m as (select news_id, round((score + s / sqrt(s * s + 15)) / 2, 6) as score from s2 join sl using (news_id))
select news_id, score as ensemble_score, {N._LABEL} as ensemble_label from m""")
def q_ensemble_scores(spark, folder):
    """The mean of the full score and the words' own, with its label."""
    rows = sentiment.annotate(N.clean_news(spark, folder).select("news_id", "headline"), "headline", FULL, "full", None)
    rows = sentiment.annotate(rows, "headline", sentiment.Scorer(phrases={}, blank=False, negate=False, rules=False), "words", None)
    mean = retrieval.ensemble(rows, ("full", "words")).withColumn("ensemble_score", F.round("ensemble_score", 6))
    return mean.select("news_id", "ensemble_score", sentiment.label(F.col("ensemble_score")).alias("ensemble_label"))


@catalogue.add("top_hits")
def q_top_hits(spark, folder):
    """The three loudest words and phrases of every headline."""
    return sentiment.explain(N.clean_news(spark, folder), "news_id", "headline", FULL, 3)


@catalogue.add("hinted_prompts")
def q_hinted_prompts(spark, folder):
    """Hints from the lexicon for every headline whose id is divisible by 20, put into the prompt of its rewriting."""
    news = cut_lineage(N.clean_news(spark, folder).where("news_id % 20 = 0").select("news_id", "headline"))
    corpus = retrieval.hint_corpus(spark, FULL, retrieval.trigram_embedding)
    near = retrieval.nearest_terms(retrieval.embedded(news, "headline", retrieval.trigram_embedding), corpus, query_id="news_id", term="term",
                                   embedding="embedding", valence="valence", least=0.2)
    hints = retrieval.hint_lists(near, "news_id")
    asked = retrieval.normalise(news, "headline", retrieval.FactsBackend(), "rewrite", 40, hints=hints, row_id="news_id")
    return asked.join(hints, "news_id", "left").select("news_id", F.coalesce(F.size("positive"), F.lit(0)).alias("positive"),
                                                       F.coalesce(F.size("negative"), F.lit(0)).alias("negative"), "llm_used", "prompt_used")


@catalogue.add("annotated_with_backend", f"""with {N._NEWS} select count(*) as n, count(*) filter (where length(headline) >= 60) as asked from n""")
def q_annotated_with_backend(spark, folder):
    """How many headlines of 60 characters or more the backend rewrites before they are scored."""
    made = retrieval.annotate_news(N.clean_news(spark, folder), "headline", FULL, retrieval.FactsBackend(), threshold=60)
    return made.agg(F.count("sentiment_score").alias("n"), F.count("normalized_text").alias("asked"))


@catalogue.add("sentiment_latest_return", f"""with {N._SCORED}, {N._PRICES}, c as (select ticker, day, close_price / lag(close_price) over (partition by ticker order by day) - 1 as c from px),
l as (select ticker, (array_agg(c order by day desc))[1] as latest_change from c group by ticker)
select ticker, round(avg(score), 6) as mean_score, round(any_value(latest_change), 9) as latest_change from sl left join l using (ticker) group by ticker""")
def q_sentiment_latest_return(spark, folder):
    mean = N.scored_news(spark, folder).groupBy("ticker").agg(F.avg("sentiment_score").alias("mean_score"))
    return mean.join(panel.latest_change(N.daily_prices(spark, folder)), "ticker", "left").select("ticker", _r("mean_score"), _r("latest_change", 9))


# ------------------------------------------------------------------------------- summaries and charts

_DESCRIBED = ("n_articles", "mean_score", "ret", "mkt_ret", "roll_vol_20")


@catalogue.add("describe_features", f"with {N._FEATURES} " + " union all ".join(
    f"select '{c}' as \"column\", count({c}) as n, count(*) - count({c}) as nulls, round(avg({c}), 9) as mean, round(stddev_samp({c}), 9) as sd, cast(min({c}) as double) as least, cast(max({c}) as double) as largest from f" for c in _DESCRIBED))
def q_describe_features(spark, folder):
    found = stats.described(N.latest_features(spark, folder), _DESCRIBED)
    return found.select("column", "n", "nulls", _r("mean", 9), _r("sd", 9), "least", "largest")


@catalogue.add("price_maps", f"with {N._PRICES} select day, count(*) as tickers, round(sum(close_price), 6) as total, min(ticker) as first_ticker from px group by day")
def q_price_maps(spark, folder):
    """A map from ticker to price for each day; shown are its size, the sum of its values and its first key."""
    maps = panel.maps_of(N.daily_prices(spark, folder), ("day",), "ticker", "close_price")
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, v: a + v)
    return maps.select("day", F.size("values").cast("long").alias("tickers"), F.round(total, 6).alias("total"), F.array_min(F.map_keys("values")).alias("first_ticker"))


_BY_TICKER = f"with {N._FEATURES}, r as (select ticker, round(corr(mean_score, ret), 6) as r from f where mean_score is not null and ret is not null group by ticker having count(*) > 2)"


@catalogue.add("extreme_correlations", f"""{_BY_TICKER}, x as (select ticker, r, row_number() over (order by r desc, ticker) as a, row_number() over (order by r, ticker) as b from r where r is not null and not isnan(r))
select 'largest' as side, ticker, r from x where a <= 25 union all select 'smallest', ticker, r from x where b <= 25""")
def q_extreme_correlations(spark, folder):
    """The 25 tickers with the largest and the 25 with the smallest correlation of score and return."""
    rows = N.latest_features(spark, folder).where("mean_score is not null and ret is not null").groupBy("ticker").agg(
        F.round(pearson(F.col("mean_score"), F.col("ret")), 6).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return panel.extremes(rows.select("ticker", "r"), "r", "ticker", 25)


@catalogue.add("label_counts", f"with {N._SCORED} select cast(i as int) as place, l as label, (select count(*) from sl where sl.label = l) as n from (values (0, 'positif'), (1, 'neutre'), (2, 'négatif')) t(i, l)")
def q_label_counts(spark, folder):
    return charts.label_counts(N.scored_news(spark, folder), "sentiment_label", (W.POSITIVE, W.NEUTRAL, W.NEGATIVE))


@catalogue.add("return_tails", f"with {N._FEATURES} select count(ret) as n, round(avg(ret), 9) as mean, round(stddev_samp(ret), 9) as sd, round(quantile_cont(ret, 0.001), 9) as low_tail, round(quantile_cont(ret, 0.999), 9) as high_tail from f")
def q_return_tails(spark, folder):
    return _rounded(charts.tails(N.latest_features(spark, folder), "ret"), 9)


@catalogue.add("normal_points", f"with {N._FEATURES}, q as (select quantile_cont(ret, list_transform(range(1, 100), lambda i: cast(i as double) / 100)) as q from f) "
               "select cast(generate_subscripts(q, 1) - 1 as int) as point, round(unnest(q), 9) as observed from q")
def q_normal_points(spark, folder):
    return charts.normal_points(N.latest_features(spark, folder), "ret").select("point", _r("observed", 9))


@catalogue.add("correlation_summary", f"{_BY_TICKER} select count(*) as n, round(quantile_cont(r, 0.25), 6) as q1, round(median(r), 6) as median, round(quantile_cont(r, 0.75), 6) as q3, round(avg(cast(r > 0 as int)), 6) as share_over_0 from r where r is not null and not isnan(r)")
def q_correlation_summary(spark, folder):
    rows = N.latest_features(spark, folder).where("mean_score is not null and ret is not null").groupBy("ticker").agg(
        F.round(pearson(F.col("mean_score"), F.col("ret")), 6).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return _rounded(charts.share_positive(rows, "r"))


@catalogue.add("permutation_p95")
def q_permutation_p95(spark, folder):
    """The F1 that one of twenty permutations reaches, exact over 10,000 of them."""
    drawn = stats.permutation_f1(N._classes(spark, folder), "a", "p")
    return _rounded(charts.exact_quantiles(drawn, (), "f1", (0.95,)).select("n", F.col("quantiles")[0].alias("p95")))


_OVERVIEW = ("mean_score", "sentiment_balance", "roll_vol_20")


@catalogue.add("features_overview", f"with {N._FEATURES}, v as (" + " union all ".join(f"select '{c}' as \"column\", {c} as v from f where {c} is not null" for c in _OVERVIEW) + """),
s as (select "column", min(v) as a, max(v) as b from v group by 1), h as (select "column", least(floor((v - a) / ((b - a) / 30)), 29) as k, any_value(a) as a, any_value(b) as b, count(*) as n from v join s using ("column") group by 1, 2)
select "column", cast(row_number() over (partition by "column" order by k) - 1 as int) as bin, round(a + k * ((b - a) / 30), 6) as low, round(a + (k + 1) * ((b - a) / 30), 6) as high, n from h""")
def q_features_overview(spark, folder):
    return _rounded(charts.overview(N.latest_features(spark, folder), _OVERVIEW))


@catalogue.add("beta_histogram", f"with {N._BETAS}, v as (select beta as v from b where n_obs > 0), s as (select min(v) as a, max(v) as b, avg(v) as m from v), h as (select least(cast(floor((v - a) / (b - a) * 30) as int), 29) as bin, count(*) as n from v, s group by 1) "
               "select cast(i as int) as bin, coalesce(n, 0) as n, round(m, 6) as mean from (select unnest(range(30)) as i) cross join s left join h on bin = i")
def q_beta_histogram(spark, folder):
    betas = feat.market_betas(N.latest_features(spark, folder)).where("n_obs > 0")
    mean = betas.agg(F.round(F.avg("beta"), 6).alias("mean"))
    return charts.histogram(betas, "beta", 30).select("bin", "n").join(F.broadcast(mean))


_METHODS = {"equal": "1.0 / count(*) over w", "rank": "(1.0 / place) / sum(1.0 / place) over w"}


@catalogue.add("method_comparison", N._TOP + "".join(f""", w_{k} as (select period, ret * ({e}) as x from t window w as (partition by period)),
c_{k} as (select '{k}' as method, period, product(1 + x) over (order by period rows unbounded preceding) as value from (select period, sum(x) as x from w_{k} group by period))""" for k, e in _METHODS.items()) + """,
c as (select * from c_equal union all select * from c_rank), d as (select *, value / max(value) over (partition by method order by period rows unbounded preceding) - 1 as fall from c),
e as (select method, count(*) as periods, arg_max(value, period) as last, arg_min(value, period) as first, min(fall) as max_drawdown from d group by method),
b as (select first as base from e where method = 'equal'),
r as (select method, periods, (last / base - 1) * 100 as final_pct, max_drawdown, power(last / first, 12.0 / greatest(periods - 1, 1)) - 1 as ann_ret from e, b)
select method, periods, round(final_pct, 4) as final_pct, round(max_drawdown, 6) as max_drawdown, round(ann_ret, 6) as ann_ret, cast(row_number() over (order by final_pct desc, method) as int) as place from r""")
def q_method_comparison(spark, folder):
    """Two weightings of the same choice: what they end with, their largest fall and annual return."""
    rows, curves = N.universe(spark, folder), None
    for kind in _METHODS:
        perf = pf.performance(pf.build(rows, "period", "ticker", 10, kind), rows, "period", "ret")
        one = perf.select(F.lit(kind).alias("method"), "period", (F.col("cum_port") + 1).alias("value"))
        curves = one if curves is None else curves.unionByName(one)
    found = charts.compared(curves, "method", "period", "value", "equal")
    return found.select("method", "periods", _r("final_pct", 4), _r("max_drawdown"), _r("ann_ret"), "place")
