"""Landed RSS files with ticker and position; the index of stored URLs reads only the buckets it needs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marketsig.operators import url_index
from marketsig.sources import news
from marketsig.streaming import monitor as M

ITEM = "<item><title>{}</title><link>https://n.example/?x=1&amp;y={}</link><pubDate>Mon, 1 Jan 2024 02:00 +0200</pubDate></item>"


def _feed(path, items, built="<lastBuildDate>Mon, 01 Jan 2024 10:00:00 GMT</lastBuildDate>"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"<?xml version='1.0'?>\n<rss><channel><title>t</title>{built}{''.join(items)}</channel></rss>")


def test_feeds_have_ticker_time_and_position(spark, tmp_path):
    _feed(tmp_path / "AAPL.rss.xml", [ITEM.format(f"Head {i} - Reuters", i) for i in range(12)])
    _feed(tmp_path / "EMPTY.xml", [])
    rows = news.secondary_articles(news.read_feeds(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(10))
    assert {r.ticker for r in rows} == {"AAPL"} and {r.fetched_at for r in rows} == {dt.datetime(2024, 1, 1, 10)}
    assert rows[3].headline == "Head 3" and rows[3].url == "https://n.example/?x=1&y=3"
    assert rows[0].published_at == dt.datetime(2024, 1, 1, 0)


def test_feed_folders_keep_tickers_as_text(spark, tmp_path):
    _feed(tmp_path / "ticker=007" / "a.xml", [ITEM.format("A", 1)], built="")
    _feed(tmp_path / "ticker=BRK%2FB" / "a.xml", [ITEM.format("B", 2), ITEM.format("C", 3)])
    rows = news.read_feeds(spark, str(tmp_path)).orderBy("ticker", "pos").collect()
    assert [(r.ticker, r.pos, r.title) for r in rows] == [("007", 0, "A"), ("BRK/B", 0, "B"), ("BRK/B", 1, "C")]
    assert rows[0].fetched_at.year >= 2024  # landed time


def test_feeds_as_a_stream(spark, tmp_path):
    _feed(tmp_path / "in" / "ticker=T" / "a.xml", [ITEM.format("A", 1), ITEM.format("B", 2)])
    out = M.run_to_table(news.read_feeds(spark, str(tmp_path / "in"), stream=True, n=1), spark, "t-feeds")
    assert [(r.ticker, r.pos, r.title) for r in out.collect()] == [("T", 0, "A")]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(url_index, "BUCKETS", 64)


def _urls(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))


def test_index_reads_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "index")
    assert url_index.stored_among(_urls(spark, 0, 5), root, "url") is None
    url_index.add(_urls(spark, 0, 3000), root, "url", 0)
    batch = _urls(spark, 2998, 3040).unionByName(spark.createDataFrame([(None,), ("u2998",)], "url string"))
    hit = url_index.touched(batch, root, "url")
    assert 1 <= len(hit) <= 4
    for folder, _, files in os.walk(os.path.join(root, "keys")):  # the others cannot even be read
        if files and int(folder.rsplit("=", 1)[1]) not in hit:
            for f in files:
                with open(os.path.join(folder, f), "wb") as out:
                    out.write(b"broken")
                if os.path.exists(os.path.join(folder, f".{f}.crc")):
                    os.remove(os.path.join(folder, f".{f}.crc"))
    stored = url_index.stored_among(batch, root, "url")
    assert sorted(r.url for r in stored.join(batch.distinct(), "url", "left_semi").collect()) == ["u2998", "u2999"]
    assert "bucket" in stored._jdf.queryExecution().toString().split("PartitionFilters")[1].split("]")[0]
    assert url_index.stored_among(_urls(spark, 0, 3000), root, "url", but=0) is None


@pytest.mark.parametrize("again", [False, True])
def test_index_is_exact_and_replays(spark, tmp_path, again):
    root, target = str(tmp_path / "index"), str(tmp_path / "compact")
    url_index.add(_urls(spark, 0, 500), root, "url", 0)
    for _ in range(1 + again):
        url_index.add(_urls(spark, 400, 900), root, "url", 1)
    url_index.compact(spark, root, target)
    for folder in (root, target):
        stored = {r.url for r in url_index.stored_among(_urls(spark, 0, 2000), folder, "url").collect()}
        assert stored == {f"u{i}" for i in range(900)}


def test_stream_with_index_inserts_each_url_once(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [[(1, "a", "x"), (2, "b", "x"), (3, "a", "y")], [(4, "a", "z"), (5, "c", "z")], [(6, "d", "w"), (7, "b", "w"), (8, None, "w")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "created_at int, url string, headline string").coalesce(1).write.parquet(f"{src}/p={k}")
        stream = spark.readStream.schema("created_at int, url string, headline string").parquet(f"{src}/p=*")
        M.insert_new_articles(stream, str(tmp_path / "table"), lambda d: d, checkpoint=str(tmp_path / "ckpt"),
                              index=str(tmp_path / "index")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "table")).filter("url is not null")
    assert sorted((r.url, r.created_at) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 5), ("d", 6)]


def test_read_errors_are_not_an_empty_table(spark, tmp_path):
    assert M._read_or_none(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        M._read_or_none(spark, str(tmp_path / "bad")).collect()
