"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.functions.text import clean_ticker
from tidewright.llm.mixing import mixed, reached_shares
from tidewright.llm.nearest_time import nearest_in_time
from tidewright.llm.tokens import token_ids
from tidewright.llm.top_n import top_items
from tidewright.llm.truncation import truncation_scores
from tidewright.plans.problems import SQL_DAY, SQL_TICKER, days
from tidewright.plans.registry import Catalogue
from tidewright.runtime import with_known
from tidewright.sources.tables import table

catalogue = Catalogue()


def _days(spark: SparkSession, folder: str, name: str, row_id: str, *more: str) -> DataFrame:
    """(row_id, ticker, day, further columns) of the rows with a ticker and a readable date_only."""
    rows = with_known(days(spark, folder, name, row_id, "ticker", *more), "day").withColumn("ticker", clean_ticker(F.col("ticker")))
    return rows.where("ticker is not null")


#: Days that a price may lie away from the news.
TOLERANCE = 3


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    news = _days(spark, folder, "news", "news_id")
    prices = _days(spark, folder, "prices", "price_id", "close_price").where("close_price > 0 and not isnan(close_price)")
    return nearest_in_time(news, prices, left_id="news_id", right_id="price_id", entity="ticker", at="day", tolerance=TOLERANCE)


_PAIRED = f"""
with n as (select distinct news_id, {SQL_TICKER} as ticker, trim(date_only, e' \\t\\n\\r') as t, day_order from news join feeds using (feed)),
nd as (select news_id, ticker, cast({SQL_DAY} as date) as day from n where ticker is not null),
p as (select distinct price_id, {SQL_TICKER} as ticker, trim(date_only, e' \\t\\n\\r') as t, day_order from prices join feeds using (feed)
      where close_price > 0),
pd as (select ticker, cast({SQL_DAY} as date) as day, min(price_id) as price_id from p where ticker is not null group by all),
m as (select news_id, price_id, pd.day - nd.day as gap, row_number() over (partition by news_id
             order by abs(pd.day - nd.day), pd.day) as rn
      from nd join pd on nd.ticker = pd.ticker and pd.day between nd.day - {TOLERANCE} and nd.day + {TOLERANCE})
"""


@catalogue.add("p2_found", _PAIRED + "select news_id, price_id from m where rn = 1 and gap <> 0")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).where("gap <> 0").select("news_id", "price_id")


@catalogue.add("p2_gaps", _PAIRED + "select cast(gap as bigint) as gap, count(*) as n from m where rn = 1 group by all")
def p2_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """How many news rows lie how many days from their nearest price."""
    return _pairs(spark, folder).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@catalogue.add("p4_found", f"""
with s as (select book, period, {SQL_TICKER} as ticker, max(score) as score from portfolio
           where score is not null and not isnan(score) group by all),
r as (select *, row_number() over (partition by book, period order by score desc, ticker) as rn from s where ticker is not null)
select book, period, ticker from r where rn <= 5""")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    picks = table(spark, folder, "portfolio").withColumn("ticker", clean_ticker(F.col("ticker")))
    return top_items(picks, ("book", "period"), "ticker", "score", 5).select("book", "period", "ticker")


@catalogue.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"), "doc_id", "text")


_MIX = dict(row_id="doc_id", text="text", source="source", seed=7)


@catalogue.add("p8_mix")
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix itself, shuffled: the documents' columns, copy_no and shuffle_key."""
    return mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), **_MIX)


@catalogue.add("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of the mix by source."""
    return reached_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), **_MIX)


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return truncation_scores(documents, row_id="doc_id", text="text", source="source", kind="kind")


@catalogue.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).where("score > 0.5").select("doc_id")


@catalogue.add("p9_source_rates")
def p9_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of each source that aren't blank were cut, at a limit and elsewhere, and their share."""
    cut = F.col("score") > 0.5
    return _cut(spark, folder).groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(cut).alias("truncated"),
        F.count_if(cut & F.col("at_limit").isNotNull()).alias("truncated_at_limit"),
        F.avg(cut.cast("double")).alias("truncated_share"))
