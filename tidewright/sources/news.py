"""Reading and cleaning news and price files; read-through tables; sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, types as T, functions as F

from tidewright.functions.safe import finite
from tidewright.functions.text import clean_ticker, strip, strip_html
from tidewright.runtime import require_columns

MONTHLY_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("_idx", T.IntegerType()), ("title", T.StringType()), ("date", T.StringType()), ("stock", T.StringType()))])
DAILY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Article_title", "Article", "Stock_symbol", "Date")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header, quoted line breaks and doubled quotes; the schema is given, never inferred."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def _whole(df: DataFrame, *needed: str) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in needed]))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """headline, date, date_only, ticker of a file of headlines; zones are cut off, unreadable rows left out."""
    raw = read_csv(spark, path, MONTHLY_SCHEMA)
    at = F.try_to_timestamp(F.substring("date", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = raw.select(F.col("title").alias("headline"), at.alias("date"), clean_ticker(F.col("stock")).alias("ticker"))
    return _whole(rows, "headline", "date", "ticker").select("headline", "date", F.to_date("date").alias("date_only"), "ticker")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """headline, body, date_only, ticker of a file of articles; rows with any of them missing are left out."""
    raw = read_csv(spark, path, DAILY_SCHEMA)
    rows = raw.select(F.col("Article_title").alias("headline"), F.col("Article").alias("body"),
                      F.try_to_date(F.substring("Date", 1, 10), "yyyy-MM-dd").alias("date_only"), clean_ticker(F.col("Stock_symbol")).alias("ticker"))
    return _whole(rows, "headline", "body", "date_only", "ticker")


def flatten_records(records: DataFrame, json: str, ticker: str, summary_chars: int = 300) -> DataFrame:
    """ticker, pub_date, title, summary, url of JSON records as news services give them, fields nested or not."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(json, p) for p in paths])
    return records.select(
        F.col(ticker).alias("ticker"), get("$.content.pubDate", "$.providerPublishTime").alias("pub_date"),
        strip_html(get("$.content.title", "$.title")).alias("title"),
        F.substring(strip_html(F.coalesce(get("$.content.summary", "$.summary"), F.lit(""))), 1, summary_chars).alias("summary"),
        get("$.content.canonicalUrl.url", "$.link").alias("url")).where(F.length(F.coalesce("title", F.lit(""))) > 0)


def unpivot_prices(wide: DataFrame, day: str, tickers: Sequence[str]) -> DataFrame:
    """(day, ticker, close_price) of a table with a column for each ticker; missing prices are left out."""
    long = wide.unpivot([day], list(tickers), "ticker", "close_price")
    return long.withColumn("ticker", F.upper(strip(F.col("ticker")))).where("close_price is not null")


def read_prices(spark: SparkSession, path: str, day: str = "Date") -> DataFrame:
    """(date_only, ticker, close_price) of price files, long with the columns ticker and close_price or wide with a column a ticker.

    ``path`` may name a folder or a pattern, so batches need no union.  Rows without a readable day, ticker or number are left out.
    """
    raw = spark.read.csv(path, header=True)
    require_columns(raw, day)
    dated = raw.withColumn("_day", F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd"))
    if {"ticker", "close_price"} <= set(raw.columns):
        long = dated.select("_day", "ticker", "close_price")
    else:
        long = dated.unpivot(["_day"], [c for c in raw.columns if c != day], "ticker", "close_price")
    rows = long.select(F.col("_day").alias("date_only"), clean_ticker(F.col("ticker")).alias("ticker"), finite(F.col("close_price").try_cast("double")).alias("close_price"))
    return _whole(rows, "date_only", "ticker", "close_price")


def market_returns(prices: DataFrame, ticker: str, day: str = "date_only") -> DataFrame:
    """(day, mkt_ret): the log returns of one index's closes, without its first day.  Days are one series, one row each."""
    index = prices.where(F.col("ticker") == ticker.strip().upper()).groupBy(day).agg(F.max("close_price").alias("_p"))
    before = F.lag("_p").over(Window.orderBy(day))
    return index.withColumn("_b", before).where("_b > 0 and _p > 0").select(day, F.ln(F.col("_p") / F.col("_b")).alias("mkt_ret"))


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at the path; made and written first where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV, without reading its rows."""
    return spark.read.option("header", True).csv(path).limit(0).columns


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows picked by a seeded hash of their key, the same ones every time."""
    require_columns(df, key)
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
