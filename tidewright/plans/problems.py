"""Queries of the general data-processing problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.functions.text import clean_ticker, squeeze
from tidewright.functions.ticks import day_of, first_day_from, iso_day, iso_instant
from tidewright.operators.heavy_keys import heavy_keys, most_repeated_value
from tidewright.operators.point_in_time import match_as_of, with_attributes_as_of
from tidewright.operators.timestamps import offset_intervals, read_days, read_times
from tidewright.operators.trailing import each_day, latest_version, trailing_runs
from tidewright.plans.registry import Catalogue
from tidewright.runtime import partitions, with_known
from tidewright.sources.tables import table

catalogue = Catalogue()

#: The characters that the SQL below strips, as DuckDB writes them.
_WS = r"e' \t\n\r\x0b\x0c'"
SQL_TICKER = f"nullif(upper(trim(ticker, {_WS})), '')"


def estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Beta estimates with the first day on which each is both in force and known."""
    betas = table(spark, folder, "betas").select(
        "beta_id", clean_ticker(F.col("ticker")).alias("ticker"), "alpha", "beta", "effective_from", "known_at"
    )
    return betas.where("beta is not null and known_at is not null and effective_from is not null").withColumn(
        "start", F.greatest(day_of(F.col("effective_from")), first_day_from(F.col("known_at"))))


def _returns(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "features").select(
        "feature_id", clean_ticker(F.col("ticker")).alias("ticker"), "period", "ret", "mkt_ret")
    return features.where("ret is not null and mkt_ret is not null").withColumn("tick", day_of(F.col("period")))


_AS_OF = dict(key="ticker", event_id="feature_id", event_tick="tick", start_tick="start",
              precedence=("effective_from", "known_at", "beta_id"))

_P1 = f"""
with e as (select distinct feature_id, {SQL_TICKER} as ticker, period, ret, mkt_ret from features
           where ret is not null and mkt_ret is not null),
b as (select distinct beta_id, {SQL_TICKER} as ticker, alpha, beta, effective_from, known_at from betas
      where beta is not null and known_at is not null),
m as (select e.*, b.beta_id, b.alpha, b.beta, row_number() over (partition by e.feature_id
             order by b.effective_from desc, b.known_at desc, b.beta_id desc) as rn
      from e join b on e.ticker = b.ticker and b.effective_from <= e.period
           and b.known_at <= timezone('UTC', cast(e.period as timestamp)))
"""


@catalogue.add("p1_found", _P1 + "select feature_id, beta_id from m where rn = 1")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return match_as_of(_returns(spark, folder), estimates(spark, folder), **_AS_OF).select("feature_id", "beta_id")


@catalogue.add("p1_abnormal_returns", _P1 + """
select feature_id, ticker, period, beta_id, ret - (alpha + beta * mkt_ret) as abnormal_ret
from m where rn = 1""")
def p1_abnormal_returns(spark: SparkSession, folder: str) -> DataFrame:
    known = with_attributes_as_of(_returns(spark, folder).dropDuplicates(["feature_id"]), estimates(spark, folder),
                                  values=("alpha", "beta"), **_AS_OF).where("asof_beta is not null")
    return known.select("feature_id", "ticker", "period", F.col("asof_beta_id").alias("beta_id"), (
        F.col("ret") - (F.col("asof_alpha") + F.col("asof_beta") * F.col("mkt_ret"))).alias("abnormal_ret"))


_HEADLINES = f"""
h as (select distinct news_id, {SQL_TICKER} as ticker,
      nullif(trim(regexp_replace(headline, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')), '') as headline from news),
c as (select ticker, headline, count(*) as n from h where ticker is not null and headline is not null group by all)
"""


def _headlines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "news").select(
        "news_id", clean_ticker(F.col("ticker")).alias("ticker"), "headline")


@catalogue.add("p3_found", f"""with {_HEADLINES}, r as (select *, row_number() over (partition by ticker
order by n desc, encode(headline)) as rn from c) select ticker, headline from r where rn = 1""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_repeated_value(_headlines(spark, folder), "ticker", squeeze(F.col("headline")), "news_id").select(
        "ticker", F.col("value").alias("headline"))


@catalogue.add("p3_heavy_tickers")
def p3_heavy_tickers(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers that hold at least a hundredth of the news rows, by the sketch; counts are estimates."""
    return heavy_keys(_headlines(spark, folder), "ticker", 0.01)


#: A trailing total below the first value over 7 days, or a trailing average above the second over 30, is a case.
LOW_TOTAL, HIGH_AVERAGE = -0.12000137, 0.04000137

_LATEST = f"""
f as (select *, row_number() over (partition by ticker, period order by loaded_at desc nulls last, feature_id desc) as rn
      from (select * replace ({SQL_TICKER} as ticker) from features) where ticker is not null and period is not null),
d as (select ticker, period, ret, roll_vol_20 from f where rn = 1),
days as (select ticker, unnest(generate_series(min(period), max(period) + 30, interval 1 day))::date as day from d group by ticker),
s as (select days.ticker, days.day,
        sum(case when d.period > days.day - 7 then cast(d.ret as decimal(26, 12)) end) as total7,
        count(case when d.period > days.day - 7 then d.ret end) as n7,
        sum(cast(d.roll_vol_20 as decimal(26, 12))) as total30, count(d.roll_vol_20) as n30
      from days join d on d.ticker = days.ticker and d.period <= days.day and d.period > days.day - 30
      group by all)
"""


def _trailing(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "features").select(
        clean_ticker(F.col("ticker")).alias("ticker"), "period", "loaded_at", "feature_id", "ret", "roll_vol_20")
    kept = latest_version(features, ("ticker", "period"), ("loaded_at", "feature_id"), ("ret", "roll_vol_20"))
    return trailing_runs(kept, "ticker", "period", {7: "ret", 30: "roll_vol_20"})


@catalogue.add("p5_found", f"""with {_LATEST}
select ticker, strftime(day, '%Y-%m-%d') as on_day, cast(7 as bigint) as span_days from s where n7 > 0 and total7 < {LOW_TOTAL}
union all
select ticker, strftime(day, '%Y-%m-%d'), cast(30 as bigint) from s where n30 > 0 and cast(total30 as double) / n30 > {HIGH_AVERAGE}""")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = _trailing(spark, folder)
    case = ((F.col("span_days") == 7) & (F.col("total") < LOW_TOTAL)) | (
        (F.col("span_days") == 30) & (F.col("total") / F.col("n") > HIGH_AVERAGE))
    return each_day(runs.where(case)).select("ticker", "on_day", "span_days")


@catalogue.add("p5_trailing_runs", f"""with {_LATEST}
select ticker, cast(7 as bigint) as span_days, count(*) as days, round(cast(sum(total7) as double), 6) as sum_of_totals from s where n7 > 0 group by ticker
union all
select ticker, cast(30 as bigint), count(*), round(cast(sum(total30) as double), 6) from s where n30 > 0 group by ticker""")
def p5_trailing_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Days with a trailing window that holds something, and the sum of their totals, for each ticker and span."""
    length = F.col("to_day") - F.col("from_day")
    return _trailing(spark, folder).groupBy("ticker", "span_days").agg(
        F.sum(length).alias("days"), F.round(F.sum(F.col("total") * length), 6).alias("sum_of_totals"))


def _with_feed(spark: SparkSession, folder: str, name: str, *columns: str, once: str | None = None) -> DataFrame:
    """Columns of a table with the zone and day order of each row's feed; the feeds are a fixed dozen of rows.

    With ``once`` each value of this column gives one row: rows are dealt by it before anything is read from their texts.
    """
    feeds = table(spark, folder, "feeds").select(F.col("feed").alias("_feed"), "tz_name", "day_order")
    rows = table(spark, folder, name).select(*dict.fromkeys([*columns, "feed"]))
    if once:
        rows = rows.repartition(partitions(spark), once).dropDuplicates([once])
    return rows.join(F.broadcast(feeds), F.col("feed") == F.col("_feed"), "left").drop("_feed")


def instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``news`` with the readings of its ``date``: day, utc, how."""
    intervals = offset_intervals(table(spark, folder, "feeds"))
    return read_times(_with_feed(spark, folder, "news", "news_id", "date"), "date", F.col("day_order"), F.col("tz_name"), intervals)


def days(spark: SparkSession, folder: str, name: str, *columns: str, once: str | None = None) -> DataFrame:
    """Columns of ``news`` or ``prices`` with the ``day`` of each row's ``date_only``."""
    return read_days(_with_feed(spark, folder, name, *columns, "date_only", once=once), "date_only", F.col("day_order"))


def _norms(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    ids = {"news": "news_id", "prices": "price_id"}
    return [with_known(days(spark, folder, n, ids[n]), "day").select(
        F.lit(f"{n}.date_only").alias("src_field"), F.col(ids[n]).alias("row_id"), iso_day(F.col("day")).alias("norm")) for n in names]


@catalogue.add("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    at = instants(spark, folder).select(F.lit("news.date").alias("src_field"), F.col("news_id").alias("row_id"), iso_instant(F.col("utc")).alias("norm"))
    return reduce(DataFrame.unionByName, [with_known(at, "norm"), *_norms(spark, folder, "news", "prices")]).distinct()


#: The day of a stripped text t by the order day_order, as SQL.
SQL_DAY = """case
    when regexp_full_match(t, '\\d{8}') then try_strptime(t, '%Y%m%d')
    when regexp_full_match(t, '\\d{10}') then make_timestamp(cast(t as bigint) * 1000000)
    when regexp_full_match(t, '\\d{13}') then make_timestamp(cast(t as bigint) * 1000)
    when regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}') then try_strptime(left(t, 10), '%Y-%m-%d')
    when regexp_full_match(t, '\\d{1,2}[./]\\d{1,2}[./]\\d{4}')
      then case day_order when 'dmy' then try_strptime(replace(t, '.', '/'), '%d/%m/%Y')
                          else try_strptime(replace(t, '.', '/'), '%m/%d/%Y') end
    else try_strptime(t, ['%d-%b-%Y', '%b %d, %Y']) end"""
_DAY_SQL = f"""
select src_field, row_id, strftime(day, '%Y-%m-%d') as norm from (
  select distinct src_field, row_id, {SQL_DAY} as day
  from (select x.*, trim(raw, e' \\t\\n\\r') as t, day_order from x join feeds using (feed))) where day is not null"""


@catalogue.add("p6_days", """with x as (select 'news.date_only' as src_field, news_id as row_id, date_only as raw, feed from news
union all select 'prices.date_only', price_id, date_only, feed from prices)""" + _DAY_SQL)
def p6_days(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, _norms(spark, folder, "news", "prices")).distinct()


@catalogue.add("p6_readings")
def p6_readings(spark: SparkSession, folder: str) -> DataFrame:
    """How often each way of finding the offset occurred in ``news.date``: repeated, skipped, unreadable hours and all."""
    return instants(spark, folder).groupBy("how").agg(F.count(F.lit(1)).alias("n"))
