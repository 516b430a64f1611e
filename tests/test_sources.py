import json

from pyspark.sql import functions as F

from tidewright.sources import news


def test_news_files(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text('_idx,title,date,stock\n0,"A ""b"", c",2019-01-02 10:00:00-04:00,\t aapl \n1,x,broken,GOOG\n2,,2019-01-02 10:00:00-04:00,GOOG\n3,"line\nbreak",2019-01-03 00:00:00-04:00,goog\n')
    got = news.read_news(spark, str(p)).orderBy("date").collect()
    assert [(r.headline, str(r.date), str(r.date_only), r.ticker) for r in got] == [
        ('A "b", c', "2019-01-02 10:00:00", "2019-01-02", "AAPL"), ("line\nbreak", "2019-01-03 00:00:00", "2019-01-03", "GOOG")]
    assert news.columns_of(spark, str(p)) == ["_idx", "title", "date", "stock"]
    q = tmp_path / "a.csv"
    q.write_text("Article_title,Article,Stock_symbol,Date\nT,B,x,2020-02-30 00:00:00 UTC\nT,B,x,2020-02-28 00:00:00 UTC\nT,,x,2020-02-28\n")
    assert news.read_articles(spark, str(q)).count() == 1


def test_records_prices_batches_and_tables(spark, tmp_path):
    recs = [("A", json.dumps({"content": {"title": "<b>Up</b>", "summary": "s" * 400, "pubDate": "d", "canonicalUrl": {"url": "u"}}})), ("B", json.dumps({"title": "flat"})), ("C", "{}"), ("D", None)]
    got = {r.ticker: r for r in news.flatten_records(spark.createDataFrame(recs, "t string, j string"), "j", "t").collect()}
    assert set(got) == {"A", "B"} and (got["A"].title, len(got["A"].summary), got["A"].url, got["B"].summary) == ("Up", 300, "u", "")
    wide = spark.createDataFrame([(1, 2.0, None)], "day int, ` aa ` double, bb double")
    long = news.unpivot_prices(wide, "day", [" aa ", "bb"])
    assert [tuple(r) for r in long.collect()] == [(1, "AA", 2.0)]
    assert news.union_batches([long, long.drop("day")]).count() == 2
    made = []
    path = str(tmp_path / "t")
    for _ in range(2):
        assert news.read_through(spark, path, lambda: made.append(1) or long).count() == 1
    assert made == [1]
    news.write_csv(long, str(tmp_path / "c"))
    news.write_table(long, str(tmp_path / "p"), ["day"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert news.sample_rows(spark.range(100), "id", 5).collect() == news.sample_rows(spark.range(100).orderBy(F.desc("id")), "id", 5).collect()


def test_price_files_long_and_wide(spark, tmp_path):
    (tmp_path / "w1.csv").write_text("Date, aa ,BB\n2020-01-02,1.5,\n2020-01-03 00:00:00,3.0,x\nbad,1,2\n")
    (tmp_path / "l.csv").write_text("Date,ticker,close_price\n2020-01-02, aa,2\n2020-01-03,,2\n2020-01-04,AA,NaN\n2020-01-06,aa,4\n")
    wide, long = (news.read_prices(spark, str(tmp_path / f)) for f in ("w1.csv", "l.csv"))
    assert sorted((str(r.date_only), r.ticker, r.close_price) for r in wide.collect()) == [("2020-01-02", "AA", 1.5), ("2020-01-03", "AA", 3.0)]
    assert sorted((str(r.date_only), r.ticker, r.close_price) for r in long.collect()) == [("2020-01-02", "AA", 2.0), ("2020-01-06", "AA", 4.0)]
    assert [(str(r.date_only), round(r.mkt_ret, 6)) for r in news.market_returns(long, "aa").collect()] == [("2020-01-06", 0.693147)]
    assert news.market_returns(long.limit(0), "aa").count() == 0
