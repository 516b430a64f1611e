"""Queries over news, prices and features: cleaning, scoring, aggregation, panels, portfolios, statistics."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewright.functions import wordlists as W
from tidewright.functions.safe import pearson
from tidewright.functions.text import clean_ticker, squeeze, strip_html
from tidewright.operators import charts, features as feat, panel, portfolio as pf, retrieval, sentiment, stats
from tidewright.operators.trailing import latest_version
from tidewright.plans.problems import SQL_DAY, SQL_TICKER, days
from tidewright.plans.registry import Catalogue
from tidewright.plans.scoring_sql import ALL_SPACE, scored, values
from tidewright.runtime import cut_lineage, with_known
from tidewright.sources.tables import table

catalogue = Catalogue()
R = 6  # digits that both sides of a comparison keep


def _r(name: str, digits: int = R):
    return F.round(F.col(name), digits).alias(name)


def _rounded(df: DataFrame, digits: int = R) -> DataFrame:
    return df.select(*[_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------------------------------------- inputs

_NEWS = f"""
n0 as (select distinct news_id, {SQL_TICKER} as ticker, trim(date_only, e' \\t\\n\\r') as t, day_order, feed,
       nullif(trim(regexp_replace(headline, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')), '') as headline from news join feeds using (feed)),
n1 as (select news_id, ticker, headline, feed, cast({SQL_DAY} as date) as day from n0),
n as (select * from n1 where ticker is not null and headline is not null and day is not null)
"""


def clean_news(spark: SparkSession, folder: str) -> DataFrame:
    """News with ticker, headline and day, each id once.  The one shuffle comes first, so that texts delivered again are
    read and scored once and a file of few row groups doesn't hold that work in few tasks."""
    rows = with_known(days(spark, folder, "news", "news_id", "ticker", "headline", "feed", once="news_id"), "day").select(
        "news_id", clean_ticker(F.col("ticker")).alias("ticker"), squeeze(F.col("headline")).alias("headline"), "feed",
        F.date_from_unix_date(F.col("day").cast("int")).alias("day"))
    return rows.where("ticker is not null and headline is not null")


#: A scorer of words and phrases without order, blanking and negation.
PLAIN = sentiment.Scorer(blank=False, negate=False, rules=False)
FULL = sentiment.Scorer()

_LABEL = "case when score >= 0.05 then 'positif' when score <= -0.05 then 'négatif' else 'neutre' end"
_PLAIN_SCORED = _NEWS + ", " + values(PLAIN.words, "lex", "word, v") + ", " + values(PLAIN.phrases, "phr", "phrase, a") + f""",
tok as (select news_id, unnest(regexp_extract_all(lower(headline), '[a-z]+')) as w from n),
bs as (select news_id, sum(v) as s from tok join lex on w = word group by news_id),
ph as (select news_id, avg(a) * 0.3 as a from n join phr on contains(lower(headline), phrase) group by news_id),
sc as (select n.*, greatest(-1, least(1, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) + coalesce(a, 0))) as score
       from n left join bs using (news_id) left join ph using (news_id)),
sl as (select *, {_LABEL} as label from sc)
"""
_SCORED = "recursive " + _NEWS + ", src as (select news_id as id, headline as text from n), " + scored("src", FULL.words, FULL.phrases) + f""",
sl as (select n.*, base, adjustment, n_phrases, score, {_LABEL} as label from n join scored on news_id = id)
"""


def scored_news(spark: SparkSession, folder: str) -> DataFrame:
    return sentiment.annotate(clean_news(spark, folder), "headline", FULL)


_PRICES = f"""
p0 as (select distinct price_id, {SQL_TICKER} as ticker, trim(date_only, e' \\t\\n\\r') as t, day_order, close_price
       from prices join feeds using (feed)),
px as (select ticker, day, arg_min(close_price, price_id) as close_price from
       (select *, cast({SQL_DAY} as date) as day from p0) where ticker is not null and day is not null and close_price > 0 group by all)
"""


def daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    """One positive price for each ticker and day, of the smallest id."""
    rows = with_known(days(spark, folder, "prices", "price_id", "ticker", "close_price"), "day").withColumn("ticker", clean_ticker(F.col("ticker")))
    return rows.where("ticker is not null and close_price > 0 and not isnan(close_price)").groupBy(
        "ticker", F.date_from_unix_date(F.col("day").cast("int")).alias("day")).agg(F.min_by("close_price", "price_id").alias("close_price"))


_RETURNS = _PRICES + """,
lr as (select ticker, day, close_price, coalesce(ln(close_price / lag(close_price) over (partition by ticker order by day)), 0.0) as log_return from px)
"""
_DAILY = """,
ds as (select day, ticker, coalesce(sum(score), 0) as sentiment_sum, avg(score) as sentiment_mean, stddev_samp(score) as sentiment_std,
       count(score) as n_articles, avg(case when label = 'positif' then 1.0 else 0.0 end) as pct_positif,
       avg(case when label = 'négatif' then 1.0 else 0.0 end) as pct_negatif from sl group by day, ticker)
"""


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return panel.daily_sentiment(scored_news(spark, folder))


_FEATURES = f"""
f0 as (select * replace ({SQL_TICKER} as ticker) from features),
f1 as (select *, row_number() over (partition by ticker, period order by loaded_at desc nulls last, feature_id desc) as rn
       from f0 where ticker is not null and period is not null),
f as (select ticker, period, n_articles, mean_score, sentiment_balance, ret, mkt_ret, roll_vol_20 from f1 where rn = 1)
"""
_MEASURES = ("n_articles", "mean_score", "sentiment_balance", "ret", "mkt_ret", "roll_vol_20")


def latest_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "features").withColumn("ticker", clean_ticker(F.col("ticker"))).where("ticker is not null and period is not null")
    return latest_version(rows, ("ticker", "period"), ("loaded_at", "feature_id"), _MEASURES)


_UNIVERSE = _FEATURES + """,
u as (select strftime(period, '%Y-%m') as period, ticker, round(avg(mean_score), 12) as score, round(sum(ret), 12) as ret from f
      where mean_score is not null and ret is not null group by 1, 2)
"""


def universe(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly score and return of every ticker."""
    rows = latest_features(spark, folder).where("mean_score is not null and ret is not null")
    return rows.groupBy(F.date_format("period", "yyyy-MM").alias("period"), "ticker").agg(
        F.round(F.avg("mean_score"), 12).alias("score"), F.round(F.sum("ret"), 12).alias("ret"))


# ------------------------------------------------------------------------------- cleaning and scoring

@catalogue.add("clean_news", f"with {_NEWS} select news_id, ticker, headline, feed, day from n")
def q_clean_news(spark, folder):
    return clean_news(spark, folder)


@catalogue.add("headline_score_label", f"with {_SCORED} select news_id, round(score, 6) as sentiment_score, label as sentiment_label from sl")
def q_headline_score_label(spark, folder):
    return scored_news(spark, folder).select("news_id", _r("sentiment_score"), "sentiment_label")


@catalogue.add("plain_score_label", f"with {_PLAIN_SCORED} select news_id, round(score, 6) as sentiment_score, label as sentiment_label from sl")
def q_plain_score_label(spark, folder):
    """The study's scorer: words and phrases alone."""
    return sentiment.annotate(clean_news(spark, folder), "headline", PLAIN).select("news_id", _r("sentiment_score"), "sentiment_label")


@catalogue.add("phrase_negation", f"with {_SCORED} select news_id, round(base, 6) as base, round(adjustment, 6) as adjustment, cast(n_phrases as bigint) as n_phrases from sl")
def q_phrase_negation(spark, folder):
    """The parts of the full score: phrases blank what they cover, negators turn phrases and words."""
    full = sentiment.annotate(clean_news(spark, folder), "headline", FULL, keep_hits=True)
    return full.select("news_id", _r("base"), _r("adjustment"), F.size("phrase_hits").cast("long").alias("n_phrases"))


@catalogue.add("explain_tokens", f"""with {_PLAIN_SCORED},
x as (select news_id, 'word' as source, w as token, v as valence, false as negated from (select distinct news_id, w from tok) join lex on w = word where v <> 0
union all select news_id, 'phrase', phrase, a, false from n join phr on contains(lower(headline), phrase))
select * from x""")
def q_explain_tokens(spark, folder):
    return sentiment.explain(clean_news(spark, folder), "news_id", "headline", PLAIN).drop("place")


@catalogue.add("explain_scores", f"""with {_SCORED},
wh as (select distinct id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from blanked),
wv as (select id, count(*) as n from wh join lexicon on w = word where v <> 0 group by id)
select news_id, round(base, 6) as base, round(adjustment, 6) as adjustment, round(score, 6) as score, label, coalesce(n, 0) + n_phrases as n_hits
from sl left join wv on wv.id = news_id""")
def q_explain_scores(spark, folder):
    """What every score is made of."""
    made = sentiment.explain_scores(clean_news(spark, folder), "news_id", "headline", FULL)
    return made.select("news_id", _r("base"), _r("adjustment"), _r("score"), "label", F.size("hits").cast("long").alias("n_hits"))


@catalogue.add("loudest_words", f"""with {_SCORED},
wh as (select distinct id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from blanked)
select w as token, count(*) as texts from wh join lexicon on w = word where v <> 0 group by w""")
def q_loudest_words(spark, folder):
    """In how many headlines each word speaks."""
    hits = sentiment.explain(clean_news(spark, folder), "news_id", "headline", FULL).where("source = 'word'")
    return hits.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))


_SENTENCES = f"""
d0 as (select doc_id, coalesce(text, '') as text from documents),
cut as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\x0c\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {ALL_SPACE})),
        lambda x: length(x) >= 10) as ss from d0),
chosen as (select doc_id, case when len(ss) <= 1 then [text] else ss end as ss from cut),
src as (select doc_id * 100000 + generate_subscripts(ss, 1) as id, unnest(ss) as text from chosen)"""


@catalogue.add("article_decay_score", f"with recursive {_SENTENCES}, {scored('src', FULL.words, FULL.phrases)}, "
               "sums as (select id // 100000 as doc_id, count(*) as n_sentences, sum(score * power(0.9, id % 100000 - 1)) / sum(power(0.9, id % 100000 - 1)) as score from scored group by 1) "
               f"select doc_id, n_sentences, round(greatest(-1, least(1, score)), 6) as score, {_LABEL} as label from sums")
def q_article_decay_score(spark, folder):
    documents = table(spark, folder, "documents")
    return _rounded(sentiment.annotate_articles(documents, "doc_id", "text"))


@catalogue.add("lexicon_snapshot", f"with {values(PLAIN.words, 'lex', 'word, v')}, t as (select distinct news_id, headline from news where headline is not null), "
               "w as (select unnest(regexp_extract_all(lower(headline), '[a-z]+')) as word from t) "
               "select word, v as valence, count(*) as uses from w join lex using (word) group by all")
def q_lexicon_snapshot(spark, folder):
    """Lexicon words that headlines use, with their valence and uses."""
    words = table(spark, folder, "news").select("news_id", "headline").distinct().where("headline is not null").select(
        F.explode(F.regexp_extract_all(F.lower("headline"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return words.join(F.broadcast(PLAIN.snapshot(spark)), "word").select("word", "valence", "uses")


@catalogue.add("label_pivot", f"""with {_SCORED} select ticker, count(*) filter (where label = 'positif') as positif,
count(*) filter (where label = 'neutre') as neutre, count(*) filter (where label = 'négatif') as negatif from sl group by ticker""")
def q_label_pivot(spark, folder):
    return scored_news(spark, folder).groupBy("ticker").pivot("sentiment_label", [W.POSITIVE, W.NEUTRAL, W.NEGATIVE]).count().na.fill(0).withColumnRenamed(W.NEGATIVE, "negatif")


@catalogue.add("two_scorers_agree", f"""with {_SCORED}, lex as (select * from lexicon), tok as (select news_id, unnest(regexp_extract_all(lower(headline), '[a-z]+')) as w from n),
s2 as (select n.news_id, coalesce(sum(v), 0) as s from n left join tok using (news_id) left join lex on w = word group by 1),
ph as (select news_id, avg(a) * 0.3 as a from n join phrase_table on contains(lower(headline), phrase) group by news_id),
b as (select label as l_full, case when c >= 0.05 then 'positif' when c <= -0.05 then 'négatif' else 'neutre' end as l_words,
             case when p >= 0.05 then 'positif' when p <= -0.05 then 'négatif' else 'neutre' end as l_plain
      from (select news_id, s / sqrt(s * s + 15) as c, greatest(-1, least(1, s / sqrt(s * s + 15) + coalesce(a, 0))) as p from s2 left join ph using (news_id)) join sl using (news_id))
select round(avg(cast(l_words = l_plain as int)), 6) as words_plain, round(avg(cast(l_words = l_full as int)), 6) as words_full, round(avg(cast(l_plain = l_full as int)), 6) as plain_full,
  round(avg(cast(l_words = l_plain and l_plain = l_full as int)), 6) as all_agree from b""")
def q_two_scorers_agree(spark, folder):
    """How often labels by words alone, by words and phrases, and by the full rules agree, two and two and all."""
    rows = clean_news(spark, folder).select("news_id", "headline")
    for name, scorer in (("words", replace(PLAIN, phrases={})), ("plain", PLAIN), ("full", FULL)):
        rows = sentiment.annotate(rows, "headline", scorer, f"{name}_score", name)
    return _rounded(retrieval.agreement(rows, "words", "plain", "full"))


@catalogue.add("strip_html", "select doc_id, length(trim(regexp_replace(text, '<[^>]+>', ' ', 'g'), e' \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f' || chr(160) || "
               "chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) "
               "|| chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(133))) as n from documents where text is not null")
def q_strip_html(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.length(strip_html(F.col("text"))).cast("long").alias("n"))


@catalogue.add("parse_model_score", f"with {_NEWS}, q as (select news_id, headline, regexp_extract(headline, '[-+]?\\d*\\.?\\d+') as x from n) select news_id, round(case when x <> '' then "
               "greatest(-1, least(1, cast(x as double))) when regexp_matches(lower(headline), 'positive|bullish|optimistic|beat|strong') then 0.7 "
               "when regexp_matches(lower(headline), 'negative|bearish|pessimistic|miss|weak|loss') then -0.7 else 0 end, 6) as score from q")
def q_parse_model_score(spark, folder):
    """Headlines read as if they were a model's replies."""
    return clean_news(spark, folder).select("news_id", F.round(sentiment.parse_model_score(F.col("headline")), R).alias("score"))


@catalogue.add("normalize_routing", f"""with {_SENTENCES},
n as (select doc_id, kind, d.text, length(d.text) >= 300 as asked,
  trim(coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(d.text, '([.!?])[ \\t\\n\\x0b\\x0c\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[0-9]')), ' '), ''), d.text), {ALL_SPACE}) as facts
  from documents d)
select kind, count(*) as texts, count(*) filter (where asked) as asked,
  cast(sum(length(coalesce(case when asked then coalesce(nullif(facts, ''), text) else text end, ''))) as bigint) as chars,
  cast(coalesce(sum(length(text) + {len(retrieval.PROMPTS["extract"]) - 6}) filter (where asked), 0) as bigint) as prompt_chars from n group by kind""")
def q_normalize_routing(spark, folder):
    """Texts of 300 characters or more are reduced to their sentences with figures, others pass through; by kind."""
    done = retrieval.normalise(table(spark, folder, "documents").select("doc_id", "kind", "text"), "text", retrieval.FactsBackend())
    size = lambda c: F.sum(F.coalesce(F.length(c), F.lit(0))).cast("long")
    return done.groupBy("kind").agg(F.count(F.lit(1)).alias("texts"), F.count_if("llm_used").alias("asked"), size("normalized_text").alias("chars"),
                                    size("prompt_used").alias("prompt_chars"))


@catalogue.add("cosine_hints", """with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
s as (select q.vec_id, t.vec_id as term, case when t.label % 2 = 0 then 1.0 else -1.0 end as valence, list_dot_product(q.e, t.e) as similarity
      from u q join u t on q.vec_id % 20 = 0 and q.vec_id <> t.vec_id),
near as (select *, row_number() over (partition by vec_id order by round(similarity, 12) desc, term) as rn from s),
placed as (select *, row_number() over (partition by vec_id, valence > 0 order by round(similarity, 12) desc, term) as place from near where rn <= 24 and similarity >= 0.2)
select vec_id, term, cast(valence as double) as valence, round(similarity, 6) as similarity, cast(place as int) as place from placed where place <= 4""")
def q_cosine_hints(spark, folder):
    """Hints for every vector whose id is divisible by 20 from all vectors but itself, signed by their label."""
    e = table(spark, folder, "embeddings")
    terms = e.select(F.col("vec_id").alias("term"), F.col("embedding").alias("emb"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("valence"))
    queries = e.where("vec_id % 20 = 0").select("vec_id", F.col("embedding").alias("emb"))
    return _rounded(retrieval.nearest_terms(queries, terms, query_id="vec_id", term="term", embedding="emb", valence="valence", least=0.2,
                                             skip_own=True))


# ---------------------------------------------------------------------------------- counts and groups

@catalogue.add("cap_per_group", f"with {_NEWS}, r as (select *, row_number() over (partition by ticker, day order by news_id) as rn from n) select news_id, ticker, day from r where rn <= 5")
def q_cap_per_group(spark, folder):
    return panel.first_rows(clean_news(spark, folder), ("ticker", "day"), ("news_id",), 5).select("news_id", "ticker", "day")


@catalogue.add("top_tickers_semi", f"with {_NEWS}, top as (select ticker from n group by ticker order by count(*) desc, ticker limit 25) select news_id, ticker from n where ticker in (select ticker from top)")
def q_top_tickers_semi(spark, folder):
    news = cut_lineage(clean_news(spark, folder).select("news_id", "ticker"))  # parsed once for the counts and the join
    return news.join(F.broadcast(panel.top_keys(news, "ticker", 25)), "ticker", "left_semi")


@catalogue.add("news_by_year", f"with {_NEWS} select cast(year(day) as bigint) as year, count(*) as n, count(distinct ticker) as tickers from n group by 1")
def q_news_by_year(spark, folder):
    return clean_news(spark, folder).groupBy(F.year("day").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"))


@catalogue.add("coverage", f"with {_SCORED} {_DAILY} select ticker, cast(sum(n_articles) as bigint) as articles, round(avg(sentiment_mean), 6) as mean, count(*) as days from ds group by ticker")
def q_coverage(spark, folder):
    return _rounded(_daily(spark, folder).groupBy("ticker").agg(F.sum("n_articles").alias("articles"), F.avg("sentiment_mean").alias("mean"), F.count(F.lit(1)).alias("days")))


@catalogue.add("monthly_series_having", f"with {_SCORED} {_DAILY} select strftime(day, '%Y-%m') as month, round(avg(sentiment_mean), 6) as mean, cast(sum(n_articles) as bigint) as articles, count(*) as n_obs from ds group by 1 having count(*) > 50")
def q_monthly_series_having(spark, folder):
    return _rounded(_daily(spark, folder).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.avg("sentiment_mean").alias("mean"), F.sum("n_articles").alias("articles"), F.count(F.lit(1)).alias("n_obs")).where("n_obs > 50"))


@catalogue.add("summary_scalars", f"with {_FEATURES} select count(*) as n, count(distinct ticker) as tickers, min(period) as first_day, max(period) as last_day, round(avg(ret), 12) as mean_ret, round(corr(mean_score, ret), 6) as r from f")
def q_summary_scalars(spark, folder):
    return latest_features(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("period").alias("first_day"), F.max("period").alias("last_day"),
        F.round(F.avg("ret"), 12).alias("mean_ret"), F.round(pearson(F.col("mean_score"), F.col("ret")), R).alias("r"))


@catalogue.add("union_batches", f"with {_PRICES}, a as (select ticker from px where year(day) < 2010 union all select ticker from px where year(day) >= 2010) select ticker, count(*) as n from a group by ticker")
def q_union_batches(spark, folder):
    px = cut_lineage(daily_prices(spark, folder).select("ticker", (F.year("day") >= 2010).alias("late")))  # parsed once for both batches
    return px.where("not late").unionByName(px.where("late")).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------------------------- panels

@catalogue.add("daily_sentiment", f"with {_SCORED} {_DAILY} select day, ticker, round(sentiment_sum, 6) as sentiment_sum, round(sentiment_mean, 6) as sentiment_mean, round(sentiment_std, 6) as sentiment_std, n_articles, round(pct_positif, 6) as pct_positif, round(pct_negatif, 6) as pct_negatif from ds")
def q_daily_sentiment(spark, folder):
    return _rounded(_daily(spark, folder))


@catalogue.add("log_returns", f"with {_RETURNS} select ticker, day, close_price, round(log_return, 9) as log_return from lr")
def q_log_returns(spark, folder):
    return panel.log_returns(daily_prices(spark, folder)).select("ticker", "day", "close_price", _r("log_return", 9))


@catalogue.add("latest_change", f"with {_PRICES}, c as (select ticker, day, close_price / lag(close_price) over (partition by ticker order by day) - 1 as c from px) select ticker, round((array_agg(c order by day desc))[1], 9) as latest_change from c group by ticker")
def q_latest_change(spark, folder):
    return panel.latest_change(daily_prices(spark, folder)).select("ticker", _r("latest_change", 9))


@catalogue.add("sentiment_price_join", f"with {_SCORED} {_DAILY}, {_RETURNS} select day, ticker, n_articles, round(sentiment_mean, 6) as sentiment_mean, round(log_return, 6) as log_return from ds join lr using (day, ticker)")
def q_sentiment_price_join(spark, folder):
    joined = _daily(spark, folder).join(panel.log_returns(daily_prices(spark, folder)), ["day", "ticker"])
    return joined.select("day", "ticker", "n_articles", _r("sentiment_mean"), _r("log_return"))


_MONTHS = f"""with {_SCORED} {_DAILY}, {_RETURNS},
j as (select * from ds join lr using (day, ticker)),
mo as (select ticker, cast(year(day) * 100 + month(day) as bigint) as ym, avg(sentiment_sum) as sent_sum_mean, stddev_samp(sentiment_sum) as sent_sum_std, avg(sentiment_mean) as sent_mean_avg,
       avg(sentiment_std) as sent_std_avg, cast(sum(n_articles) as bigint) as n_articles_total, avg(pct_positif) as pct_pos_avg, avg(pct_negatif) as pct_neg_avg,
       sum(log_return) as monthly_return, stddev_samp(log_return) as monthly_vol, count(day) as n_trading_days from j group by 1, 2),
la as (select *, pct_pos_avg - pct_neg_avg as sentiment_balance, lag(sent_sum_mean) over w as sent_lag1, lag(monthly_return) over w as ret_lag1, lag(monthly_return, 2) over w as ret_lag2,
       lag(monthly_vol) over w as vol_lag1, lead(monthly_return) over w as target_return from mo window w as (partition by ticker order by ym)),
months as (select *, cast(target_return > 0 as bigint) as target_class from la
  where target_return is not null and ret_lag1 is not null and ret_lag2 is not null and sent_lag1 is not null and vol_lag1 is not null)"""
_MONTH_COLUMNS = (*panel.MONTHLY_COLUMNS, "monthly_return", "target_return")


def months(spark: SparkSession, folder: str) -> DataFrame:
    joined = _daily(spark, folder).join(panel.log_returns(daily_prices(spark, folder)), ["day", "ticker"]).withColumn("day", F.unix_date("day").cast("long"))
    return panel.monthly_features(joined).withColumns({"ym": F.col("ym").cast("long"), "target_class": F.col("target_class").cast("long")})


@catalogue.add("monthly_features", _MONTHS + " select ticker, ym, " + ", ".join(
    c if c in ("n_articles_total", "n_trading_days") else f"round({c}, 6) as {c}" for c in _MONTH_COLUMNS) + ", target_class from months")
def q_monthly_features(spark, folder):
    return _rounded(months(spark, folder).select("ticker", "ym", *_MONTH_COLUMNS, "target_class"))


@catalogue.add("lagged_features", f"with {_FEATURES} select ticker, period, lag(mean_score) over w as mean_score, lag(sentiment_balance) over w as sentiment_balance, lag(n_articles) over w as n_articles, lead(ret) over w as target_return from f window w as (partition by ticker order by period)")
def q_lagged_features(spark, folder):
    led = latest_features(spark, folder).withColumn("target_return", F.lead("ret").over(panel.series("ticker", "period")))
    return panel.lag_columns(led, ("mean_score", "sentiment_balance", "n_articles"), "ticker", "period").select(
        "ticker", "period", "mean_score", "sentiment_balance", "n_articles", "target_return")


@catalogue.add("rolling_vol20", f"with {_FEATURES} select ticker, period, case when count(ret) over w >= 20 then round(stddev_samp(ret) over w, 9) end as vol from f window w as (partition by ticker order by period rows between 19 preceding and current row)")
def q_rolling_vol20(spark, folder):
    return latest_features(spark, folder).select("ticker", "period", F.round(panel.rolling_deviation("ret", "ticker", "period"), 9).alias("vol"))


@catalogue.add("forward_fill", f"with {_FEATURES} select ticker, period, last_value(roll_vol_20 ignore nulls) over (partition by ticker order by period rows between unbounded preceding and current row) as vol from f")
def q_forward_fill(spark, folder):
    return latest_features(spark, folder).select("ticker", "period", panel.forward_fill("roll_vol_20", "ticker", "period").alias("vol"))


@catalogue.add("feature_unpivot", f"with {_FEATURES} select variable, count(value) as n, round(avg(value), 12) as mean from (select * from (select ticker, period, ret, mkt_ret, roll_vol_20 from f) unpivot (value for variable in (ret, mkt_ret, roll_vol_20))) group by variable")
def q_feature_unpivot(spark, folder):
    long = charts.long_form(latest_features(spark, folder), ("ticker", "period"), ("ret", "mkt_ret", "roll_vol_20"))
    return long.groupBy("variable").agg(F.count("value").alias("n"), F.round(F.avg("value"), 12).alias("mean"))


_CELLS = f"""with {_SCORED},
c as (select ticker, day as period, count(*) as n, count(*) filter (where label = 'positif') as np, count(*) filter (where label = 'négatif') as nn, count(*) filter (where label = 'neutre') as nu,
      avg(score) as m, median(score) as md, coalesce(stddev_samp(score), 0) as sd, max(score) - min(score) as rg, sum(score) as s1, sum(score * score) as s2, sum(score * score * score) as s3 from sl group by 1, 2),
q as (select quantile_cont(n, 0.75) as q from c)
select ticker, period, n as n_articles, np as n_positive_articles, nn as n_negative_articles, nu as n_neutral_articles, cast(n > coalesce(nullif(q, 0), 1) as integer) as news_burst,
round(m, 6) as mean_score, round(md, 6) as median_score, round(sd, 6) as std_score, round(rg, 6) as score_range, round(np / n, 6) as pct_positive, round(nn / n, 6) as pct_negative, round(np / n - nn / n, 6) as sentiment_balance
from c, q"""


@catalogue.add("sentiment_features", _CELLS)
def q_sentiment_features(spark, folder):
    cells = feat.sentiment_features(scored_news(spark, folder).withColumnRenamed("day", "period"))
    return _rounded(cells.drop("score_skew").withColumns({f"n_{x}_articles": F.col(f"n_{x}_articles").cast("long") for x in ("positive", "negative", "neutral")}))


@catalogue.add("score_skew", f"""with {_SCORED}, c as (select ticker, avg(score) as m, count(*) as n, var_pop(score) as v from sl group by 1),
k as (select sl.ticker, avg(power(score - m, 3)) as m3 from sl join c using (ticker) group by 1)
select ticker, round(case when n < 3 or v < 1e-18 then 0 else m3 / power(v, 1.5) end, 5) as score_skew from c join k using (ticker)""")
def q_score_skew(spark, folder):
    by_ticker = feat.sentiment_features(scored_news(spark, folder).withColumn("period", F.lit(0)))
    return by_ticker.select("ticker", _r("score_skew", 5))


_BETAS = _FEATURES + """,
o as (select ticker, ret as y, mkt_ret as x from f where ret is not null and mkt_ret is not null),
b as (select ticker, case when count(*) >= 24 then regr_intercept(y, x) else 0 end as alpha, case when count(*) >= 24 then regr_slope(y, x) else 1 end as beta, count(*) as n_obs from o group by ticker)
"""


@catalogue.add("market_betas", f"with {_BETAS} select ticker, round(alpha, 6) as alpha, round(beta, 6) as beta, n_obs from b")
def q_market_betas(spark, folder):
    return _rounded(feat.market_betas(latest_features(spark, folder)).where("n_obs > 0"))


@catalogue.add("abnormal_returns", f"with {_BETAS} select f.ticker, f.period, round(ret - (coalesce(alpha, 0) + coalesce(beta, 1) * mkt_ret), 6) as abnormal_ret from f left join b using (ticker)")
def q_abnormal_returns(spark, folder):
    rows = latest_features(spark, folder)
    return feat.abnormal_returns(rows, feat.market_betas(rows)).select("ticker", "period", _r("abnormal_ret"))


_FULL = _CELLS.replace("\nselect ticker, period, n as", ",\ncells as (select ticker, period, n as", 1) + f"""),
{_FEATURES}, mk as (select period, avg(mkt_ret) as mkt_ret from f group by period),
fp as (select f.ticker, f.period, f.ret, mk.mkt_ret from f left join mk using (period)),
fo as (select ticker, ret as y, mkt_ret as x from fp where ret is not null and mkt_ret is not null),
fb as (select ticker, case when count(*) >= 24 then regr_intercept(y, x) else 0 end as alpha, case when count(*) >= 24 then regr_slope(y, x) else 1 end as beta from fo group by ticker),
fa as (select fp.*, ret - (coalesce(alpha, 0) + coalesce(beta, 1) * mkt_ret) as abnormal_ret from fp left join fb using (ticker))
select cells.*, round(ret, 6) as ret, round(mkt_ret, 6) as mkt_ret, round(abnormal_ret, 6) as abnormal_ret from cells left join fa using (ticker, period)"""


@catalogue.add("full_feature_set", _FULL)
def q_full_feature_set(spark, folder):
    rows = latest_features(spark, folder)
    market = rows.groupBy("period").agg(F.avg("mkt_ret").alias("mkt_ret"))
    found = feat.full_features(scored_news(spark, folder).withColumnRenamed("day", "period"), rows, market).drop("score_skew")
    return _rounded(found.withColumns({f"n_{x}_articles": F.col(f"n_{x}_articles").cast("long") for x in ("positive", "negative", "neutral")}))


# ----------------------------------------------------------------------------------------- portfolios

_TOP = f"with {_UNIVERSE}, t as (select *, max(score) over (partition by period) as m, row_number() over (partition by period order by score desc, ticker) as place from u qualify place <= 10)"
_WEIGHTS = {
    "equal": "1.0 / count(*) over w",
    "score": "case when max(score) over w > min(score) over w then (score - min(score) over w) / (sum(score) over w - count(*) over w * min(score) over w) else 1.0 / count(*) over w end",
    "softmax": "exp(score - m) / sum(exp(score - m)) over w",
    "rank": "(1.0 / place) / sum(1.0 / place) over w",
}


def _weighted(kind: str):
    def run(spark, folder):
        chosen = pf.build(universe(spark, folder), "period", "ticker", 10, kind)
        return chosen.select("period", "ticker", F.col("place").cast("long").alias("place"), _r("weight"))

    return run


for _kind, _sql in _WEIGHTS.items():
    catalogue.add(f"topn_{_kind}_weights", f"{_TOP} select period, ticker, cast(place as bigint) as place, round({_sql}, 6) as weight from t window w as (partition by period)")(_weighted(_kind))


@catalogue.add("custom_weights", f"{_TOP} select period, ticker, round((1.0 / sqrt(place)) / sum(1.0 / sqrt(place)) over (partition by period), 6) as weight from t")
def q_custom_weights(spark, folder):
    """Weights by a Python function of a period's scores: falling with the root of the place."""

    def falling(scores):
        raw = 1 / np.sqrt(np.arange(1, len(scores) + 1))
        return raw / raw.sum()

    return pf.build(universe(spark, folder), "period", "ticker", 10, falling).select("period", "ticker", _r("weight"))


def _perf(spark, folder):
    rows = universe(spark, folder)
    chosen = pf.build(rows, "period", "ticker", 10)
    return chosen, pf.performance(chosen, rows, "period", "ret")


_PERF = _TOP + """, p as (select period, sum(ret) / count(*) as port_ret from t group by period), bm as (select period, avg(ret) as bench_ret from u group by period),
pb as (select *, port_ret - bench_ret as excess from p join bm using (period))"""


@catalogue.add("portfolio_performance", _PERF + " select period, round(port_ret, 11) as port_ret, round(bench_ret, 11) as bench_ret, round(excess, 11) as excess, round(product(1 + port_ret) over w - 1, 5) as cum_port, round(product(1 + bench_ret) over w - 1, 5) as cum_bench from pb window w as (order by period rows unbounded preceding)")
def q_portfolio_performance(spark, folder):
    return _perf(spark, folder)[1].select("period", _r("port_ret", 11), _r("bench_ret", 11), _r("excess", 11), _r("cum_port", 5), _r("cum_bench", 5))


@catalogue.add("portfolio_metrics", _PERF + ", ic as (select corr(score, ret) as ic from t) select round(avg(port_ret) * 12, 6) as ann_port, round(avg(bench_ret) * 12, 6) as ann_bench, round(avg(port_ret) / stddev_samp(port_ret) * sqrt(12), 6) as sharpe, round(any_value(ic), 6) as ic from pb, ic")
def q_portfolio_metrics(spark, folder):
    chosen, perf = _perf(spark, folder)
    return _rounded(pf.metrics(perf, chosen, "ret"))


@catalogue.add("max_drawdown", f"with {_PRICES}, k as (select ticker, close_price / max(close_price) over (partition by ticker order by day rows unbounded preceding) - 1 as d from px) select ticker, round(min(d), 9) as max_drawdown from k group by ticker")
def q_max_drawdown(spark, folder):
    return pf.drawdown(daily_prices(spark, folder), "ticker", "day", "close_price").select("ticker", _r("max_drawdown", 9))


def _ledger_inputs(spark, folder):
    """Monthly target weights of a book and month-end prices, books by first letter of the ticker."""
    px = daily_prices(spark, folder).groupBy("ticker", F.date_format("day", "yyyy-MM").alias("period")).agg(F.max_by("close_price", "day").alias("price"))
    listed = px.withColumn("book", F.substring("ticker", 1, 1))
    return listed.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("book", "period"))).select("book", "period", "ticker", "weight"), px


_LEDGER = f"""with {_PRICES}, mp as (select ticker, strftime(day, '%Y-%m') as period, arg_max(close_price, day) as price from px group by 1, 2),
tg as (select left(ticker, 1) as book, period, ticker, price, 1.0 / count(*) over (partition by left(ticker, 1), period) as weight from mp),
st as (select book, period, lead(period) over (partition by book order by period) as nxt from (select distinct book, period from tg)),
g as (select tg.book, st.nxt as period, 1 - sum(weight) + sum(weight * coalesce(q.price / tg.price, 0)) as growth from tg join st using (book, period)
      left join mp q on q.ticker = tg.ticker and q.period = st.nxt where st.nxt is not null group by 1, 2)"""


@catalogue.add("frictionless_nav", _LEDGER + " select book, period, round(growth, 6) as growth from g")
def q_frictionless_nav(spark, folder):
    targets, px = _ledger_inputs(spark, folder)
    return pf.frictionless_value(targets, px).select("book", "period", _r("growth"))


@catalogue.add("rebalance_trades")
def q_rebalance_trades(spark, folder):
    targets, px = _ledger_inputs(spark, folder)
    return _rounded(pf.rebalance(targets, px, 100_000.0, 0.001), 4)


@catalogue.add("trade_summary")
def q_trade_summary(spark, folder):
    targets, px = _ledger_inputs(spark, folder)
    return _rounded(charts.trade_summary(pf.rebalance(targets, px, 100_000.0, 0.001, close=True)), 4)


# ----------------------------------------------------------------------------------------- statistics

@catalogue.add("ticker_correlation", f"with {_FEATURES} select ticker, round(corr(mean_score, ret), 6) as r, round(avg(ret), 12) as avg_return, cast(sum(n_articles) as bigint) as total_articles, count(*) as n_points from f where mean_score is not null and ret is not null group by ticker having count(*) > 2")
def q_ticker_correlation(spark, folder):
    rows = latest_features(spark, folder).where("mean_score is not null and ret is not null")
    return rows.groupBy("ticker").agg(F.round(pearson(F.col("mean_score"), F.col("ret")), R).alias("r"), F.round(F.avg("ret"), 12).alias("avg_return"),
                                      F.sum("n_articles").alias("total_articles"), F.count(F.lit(1)).alias("n_points")).where("n_points > 2")


_PAIRS = ("mean_score", "sentiment_balance", "ret", "mkt_ret", "roll_vol_20")


@catalogue.add("corr_matrix", f"with {_FEATURES} " + " union all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from f" for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1:]))
def q_corr_matrix(spark, folder):
    return _rounded(charts.correlations(latest_features(spark, folder), _PAIRS, pearson))


@catalogue.add("t_test_stat", _PERF + ", e as (select round(excess, 12) as e from pb) select count(*) as n, round(avg(e), 9) as mean, round(stddev_samp(e), 9) as sd, round(avg(e) / nullif(stddev_samp(e) / sqrt(count(*)), 0), 6) as t from e")
def q_t_test_stat(spark, folder):
    excess = _perf(spark, folder)[1].select(F.round("excess", 12).alias("excess"))  # a portfolio of all names has none
    return stats.mean_test(excess, "excess").select("n", _r("mean", 9), _r("sd", 9), _r("t"))


@catalogue.add("pearson_test_stat", f"with {_FEATURES}, c as (select count(*) as n, corr(mean_score, ret) as r from f where mean_score is not null and ret is not null) select n, round(r, 6) as r, round(r * sqrt((n - 2) / (1 - r * r)), 5) as t from c")
def q_pearson_test_stat(spark, folder):
    return stats.correlation_test(latest_features(spark, folder), "mean_score", "ret").select("n", _r("r"), _r("t", 5))


@catalogue.add("dm_stat", f"with {_FEATURES}, g as (select ret * ret - (ret - mkt_ret) * (ret - mkt_ret) as g from f where ret is not null and mkt_ret is not null) select count(*) as n, round(avg(g) / (stddev_samp(g) / sqrt(count(*))), 5) as t from g")
def q_dm_stat(spark, folder):
    return stats.forecast_gain(latest_features(spark, folder), "ret", "mkt_ret").select("n", _r("t", 5))


@catalogue.add("ols_coefs", f"with {_FEATURES} select '_intercept' as term, round(regr_intercept(ret, mkt_ret), 8) as coef from f union all select 'mkt_ret', round(regr_slope(ret, mkt_ret), 6) from f")
def q_ols_coefs(spark, folder):
    rows = latest_features(spark, folder)
    fit = stats.ols_hc3(rows, "ret", ["mkt_ret"], intercept=True)
    values = [(n, round(c, 8 if n == "_intercept" else 6)) for n, c in zip(fit["names"], fit["coef"])]
    return rows.sparkSession.createDataFrame(values, "term string, coef double")


_HC3 = f"""with {_BETAS},
fa as (select f.*, ret - (coalesce(alpha, 0) + coalesce(beta, 1) * mkt_ret) as y from f left join b using (ticker)),
c as (select y, mean_score as x1, sentiment_balance as x2 from fa where y is not null and mean_score is not null and sentiment_balance is not null),
s as (select sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x2 * x2) as d, sum(x1 * y) as p, sum(x2 * y) as q, count(*) as n from c),
i as (select *, d / (a * d - b * b) as ia, -b / (a * d - b * b) as ib, a / (a * d - b * b) as id from s),
e as (select *, ia * p + ib * q as b1, ib * p + id * q as b2 from i),
r as (select c.*, e.*, power((y - b1 * x1 - b2 * x2) / (1 - (ia * x1 * x1 + 2 * ib * x1 * x2 + id * x2 * x2)), 2) as u from c, e),
m as (select any_value(b1) as b1, any_value(b2) as b2, any_value(ia) as ia, any_value(ib) as ib, any_value(id) as id,
      sum(u * x1 * x1) as m11, sum(u * x1 * x2) as m12, sum(u * x2 * x2) as m22 from r),
v as (select b1, b2, sqrt(ia * ia * m11 + 2 * ia * ib * m12 + ib * ib * m22) as s1, sqrt(ib * ib * m11 + 2 * ib * id * m12 + id * id * m22) as s2 from m)
select 'mean_score' as term, round(b1, 8) as coef, round(s1, 8) as se, round(b1 / s1, 5) as t, round(b1 - 1.96 * s1, 8) as low, round(b1 + 1.96 * s1, 8) as high from v
union all select 'sentiment_balance', round(b2, 8), round(s2, 8), round(b2 / s2, 5), round(b2 - 1.96 * s2, 8), round(b2 + 1.96 * s2, 8) from v"""


@catalogue.add("ols_hc3", _HC3)
def q_ols_hc3(spark, folder):
    rows = latest_features(spark, folder)
    fit = stats.ols_hc3(feat.abnormal_returns(rows, feat.market_betas(rows)), "abnormal_ret", ["mean_score", "sentiment_balance"])
    made = charts.coefficient_bars(rows.sparkSession, fit)
    return made.select("term", _r("coef", 8), _r("se", 8), _r("t", 5), _r("low", 8), _r("high", 8))


_CLASSES = f"with {_FEATURES}, c as (select cast(ret > 0 as int) as a, cast(mean_score > 0 as int) as p from f where ret is not null and mean_score is not null)"


def _classes(spark, folder):
    return latest_features(spark, folder).where("ret is not null and mean_score is not null").select(
        (F.col("ret") > 0).cast("int").alias("a"), (F.col("mean_score") > 0).cast("int").alias("p"))


@catalogue.add("classification_metrics", _CLASSES + """, k as (select count(*) filter (where a = 1 and p = 1) as tp, count(*) filter (where a = 0 and p = 1) as fp, count(*) filter (where a = 1 and p = 0) as fn, count(*) filter (where a = 0 and p = 0) as tn from c)
select tp, fp, fn, tn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from k""")
def q_classification_metrics(spark, folder):
    return _rounded(stats.confusion(_classes(spark, folder), "a", "p"))


@catalogue.add("permutation_f1")
def q_permutation_f1(spark, folder):
    """How the F1 of shuffled labels is spread: a histogram of 10,000 permutations of the whole table's margins."""
    return _rounded(charts.histogram(stats.permutation_f1(_classes(spark, folder), "a", "p"), "f1", 40))


@catalogue.add("regression_metrics", f"with {_FEATURES}, e as (select ret as y, ret - mkt_ret as e from f where ret is not null and mkt_ret is not null) select round(sqrt(avg(e * e)), 8) as rmse, round(avg(abs(e)), 8) as mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) as r2 from e")
def q_regression_metrics(spark, folder):
    out = stats.regression_errors(latest_features(spark, folder).where("ret is not null and mkt_ret is not null"), "ret", "mkt_ret")
    return out.select(_r("rmse", 8), _r("mae", 8), _r("r2"))


_SPLIT = f"with {_FEATURES}, z as (select ticker, period, coalesce(mean_score, 0) as a, coalesce(roll_vol_20, 0) as b, case when period <= date '2015-12-31' then 'train' when period <= date '2017-12-31' then 'validation' else 'test' end as split from f)"


def _splits(spark, folder):
    rows = latest_features(spark, folder).select("ticker", "period", F.col("mean_score").alias("a"), F.col("roll_vol_20").alias("b"))
    return rows.withColumn("split", panel.split_name(F.col("period"), F.lit("2015-12-31").cast("date"), F.lit("2017-12-31").cast("date")))


@catalogue.add("temporal_split", _SPLIT + " select split, count(*) as n, min(period) as first_day, max(period) as last_day from z group by split")
def q_temporal_split(spark, folder):
    return _splits(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("first_day"), F.max("period").alias("last_day"))


@catalogue.add("standard_scale", _SPLIT + ", m as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from z where split = 'train') select ticker, period, split, round((a - ma) / sa, 6) as a, round((b - mb) / sb, 6) as b from z, m")
def q_standard_scale(spark, folder):
    return _rounded(panel.standardised(_splits(spark, folder), ("a", "b"), F.col("split") == "train"))


@catalogue.add("robust_scale", _SPLIT + ", m as (select median(a) as ma, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) as sa, median(b) as mb, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) as sb from z where split = 'train') select ticker, period, split, round((a - ma) / case when sa > 0 then sa else 1 end, 6) as a, round((b - mb) / case when sb > 0 then sb else 1 end, 6) as b from z, m")
def q_robust_scale(spark, folder):
    return _rounded(panel.robust_scaled(_splits(spark, folder), ("a", "b"), F.col("split") == "train"))


# --------------------------------------------------------------------------------------------- charts

@catalogue.add("histogram40", f"with {_FEATURES}, v as (select ret as v from f where ret is not null), s as (select min(v) as a, max(v) as b from v), h as (select least(cast(floor((v - a) / (b - a) * 40) as int), 39) as bin, count(*) as n from v, s group by 1) "
               "select cast(i as int) as bin, round(a + i * ((b - a) / 40), 6) as low, round(a + (i + 1) * ((b - a) / 40), 6) as high, coalesce(n, 0) as n from (select unnest(range(40)) as i) cross join s left join h on bin = i")
def q_histogram40(spark, folder):
    return _rounded(charts.histogram(latest_features(spark, folder), "ret", 40))


@catalogue.add("weight_box_stats", f"with p as (select distinct * from portfolio) select book, count(weight) as n, round(quantile_cont(weight, 0.25), 10) as q1, round(quantile_cont(weight, 0.5), 10) as q2, round(quantile_cont(weight, 0.75), 10) as q3, min(weight) as low, max(weight) as high from p where weight is not null and not isnan(weight) group by book")
def q_weight_box_stats(spark, folder):
    rows = table(spark, folder, "portfolio").distinct().where("weight is not null and not isnan(weight)")
    return charts.quartiles(rows, ("book",), "weight").select("book", "n", _r("q1", 10), _r("q2", 10), _r("q3", 10), "low", "high")


@catalogue.add("return_moments", f"with {_FEATURES}, m as (select avg(ret) as m, count(ret) as n, stddev_samp(ret) as sd, var_pop(ret) as v from f), k as (select avg(power(ret - m, 3)) as m3, avg(power(ret - m, 4)) as m4 from f, m where ret is not null) "
               "select n, round(m, 9) as mean, round(sd, 9) as sd, round(m3 / power(v, 1.5), 5) as skew, round(m4 / (v * v) - 3, 5) as kurtosis from m, k")
def q_return_moments(spark, folder):
    return charts.moments(latest_features(spark, folder), "ret").select("n", _r("mean", 9), _r("sd", 9), _r("skew", 5), _r("kurtosis", 5))


@catalogue.add("line_fit", f"with {_FEATURES} select round(regr_slope(ret, mean_score), 8) as slope, round(regr_intercept(ret, mean_score), 8) as intercept, cast(regr_count(ret, mean_score) as bigint) as n from f")
def q_line_fit(spark, folder):
    return charts.line_fit(latest_features(spark, folder), "mean_score", "ret").select(_r("slope", 8), _r("intercept", 8), "n")


@catalogue.add("thinned_periods", _PERF + ", r as (select period, port_ret, row_number() over (order by period) as i from pb) select period, round(port_ret, 11) as port_ret from r where (i - 1) % 6 = 0")
def q_thinned_periods(spark, folder):
    return charts.every_kth(_perf(spark, folder)[1], "period", 6).select("period", _r("port_ret", 11))
