"""Snapshot tables (atomic commits, second writers, failed updates) and the whole poll as one batch."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketsig.operators import sentiment, snapshots
from marketsig.operators.validate import fill_defaults
from marketsig.plans import poll
from marketsig.schemas import MARKET_QUOTES, NEWS_STAGING, SENTIMENT_SCORES, TRADE_LEDGER
from marketsig.session import scratch_path

NOW = dt.datetime(2024, 3, 1, 12)
NEWS = "id string, ticker string, source string, headline string, url string, published_at timestamp, sentiment_score double, created_at timestamp"


def article(spark, *urls, score=None, ticker="A"):
    rows = [(u, ticker, "s", f"h {u}", u, None, score, NOW) for u in urls]
    return spark.createDataFrame(rows, NEWS)


def urls(spark, root, snap=None):
    return sorted((r.url, r.sentiment_score) for r in snapshots.read(spark, root, NEWS_STAGING, snap).collect())


def test_commits_appear_at_once_and_old_versions_stay(spark):
    root = scratch_path(spark, "snap")
    assert snapshots.snapshot(spark, root).version == -1 and snapshots.read(spark, root, NEWS_STAGING).count() == 0
    first = snapshots.append(article(spark, "a", "b"), root, NEWS_STAGING)
    staged = snapshots.stage(article(spark, "never"), root, NEWS_STAGING)  # a writer that dies before it publishes
    assert urls(spark, root) == [("a", None), ("b", None)] and staged
    second = snapshots.insert_ignore(article(spark, "b", "c", "c"), root, NEWS_STAGING, ["id"])
    assert [u for u, _ in urls(spark, root)] == ["a", "b", "c"] and [u for u, _ in urls(spark, root, first)] == ["a", "b"]
    assert second.version == 1 and [u for u, _ in urls(spark, root, snapshots.snapshot(spark, root, 0))] == ["a", "b"]
    with pytest.raises(ValueError):
        snapshots.snapshot(spark, root, 7)


def test_second_writer_fails_cleanly_or_starts_again(spark):
    root = scratch_path(spark, "snap")
    base = snapshots.append(article(spark, "a"), root, NEWS_STAGING)
    mine, yours = (snapshots.stage(article(spark, x), root, NEWS_STAGING) for x in ("mine", "yours"))
    snapshots.publish(spark, root, base, {NEWS_STAGING.name: [mine]})
    with pytest.raises(snapshots.ConcurrentCommit):
        snapshots.publish(spark, root, base, {NEWS_STAGING.name: [yours]})
    assert [u for u, _ in urls(spark, root)] == ["a", "mine"]
    runs = []

    def change(state):
        runs.append(state.version)
        if len(runs) == 1:  # another writer gets in between
            snapshots.append(article(spark, "between"), root, NEWS_STAGING)
        return {NEWS_STAGING.name: [snapshots.stage(article(spark, "late"), root, NEWS_STAGING)]}, {}
    snapshots.transaction(spark, root, change)
    assert runs == [1, 2] and [u for u, _ in urls(spark, root)] == ["a", "between", "late", "mine"]


def test_update_rewrites_only_touched_folders_and_survives_a_failure(spark, monkeypatch):
    root = scratch_path(spark, "snap")
    snapshots.append(article(spark, "a", "b"), root, NEWS_STAGING)
    before = snapshots.append(article(spark, "c"), root, NEWS_STAGING)
    updates = spark.createDataFrame([("a", 0.5), ("zz", 0.1)], "url string, sentiment_score double")
    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            snapshots.update(spark, root, updates, NEWS_STAGING, "sentiment_score")
    assert urls(spark, root) == [("a", None), ("b", None), ("c", None)]
    after = snapshots.update(spark, root, updates, NEWS_STAGING, "sentiment_score")
    assert urls(spark, root) == [("a", 0.5), ("b", None), ("c", None)]
    name = NEWS_STAGING.name
    assert before.tables[name][1] in after.tables[name] and before.tables[name][0] not in after.tables[name]
    snapshots.compact(spark, root, NEWS_STAGING)
    assert len(snapshots.snapshot(spark, root).tables[name]) == 1 and len(urls(spark, root)) == 3
    gone = snapshots.vacuum(spark, root, keep=1, older_than_hours=-1)
    assert len(gone) >= 3 and urls(spark, root) == [("a", 0.5), ("b", None), ("c", None)]


def test_defaults_make_ids(spark):
    rows = spark.createDataFrame([("A", "h", "positive", 0.9), ("A", "g", "positive", 0.9)], "ticker string, headline string, sentiment string, score double")
    out = fill_defaults(rows, SENTIMENT_SCORES, NOW).collect()
    assert len({r.id for r in out}) == 2 and all(r.timestamp == NOW for r in out)
    assert {r.id for r in fill_defaults(rows, SENTIMENT_SCORES, NOW).collect()} == {r.id for r in out}


def quote(c):
    return json.dumps(dict(zip(("c", "d", "dp", "h", "l", "o", "pc"), (c, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0))))


def landed(spark, batch):
    """Three batches of landed rows of five tickers."""
    at = NOW + dt.timedelta(minutes=15 * batch)
    rows = [("quote", "A", at, 1, quote(10.0 + batch)), ("quote", "B", at, 2, quote(20.0 + batch)), ("quote", "C", at, 3, quote(0)),
            ("quote", "E", at, 4, quote(5.0)), ("reply", "A", at, 5, "<think>t</think>DECISION: BUY\nCONFIDENCE: HIGH\nREASONING: r")]
    rows = [(*r, None, None, None, None) for r in rows]
    for i in range(4):
        rows.append(("news", "A", at, 10 + i, None, f"profit gains {i + batch}", f"u{i + batch}", None, "yfinance"))
    rows.append(("news", "B", at, 20, None, "loss and decline", f"b{batch}", None, "google_news"))
    rows.append(("news", "B", at, 21, None, "no url", "", None, "google_news"))
    rows.append(("news", "D", at, 22, None, "no url at all", None, None, "yfinance"))
    return spark.createDataFrame(rows, poll.LANDED)


@pytest.fixture(scope="module")
def world(spark):
    bars = spark.createDataFrame([(t, NOW - dt.timedelta(hours=i), i, 50.0 + (i * 7) % 13) for t in "ABCD" for i in range(40)],
                                 "ticker string, ts timestamp, n long, price double")
    universe = spark.createDataFrame([(t,) for t in "ABCDE"], "ticker string")
    return lambda as_of: bars, universe, sentiment.lexicon_scorer("headline")


def tables_of(spark, root):
    snap = snapshots.snapshot(spark, root)
    out = {}
    for name, key in (("market_quotes", "current_price"), ("news_staging", "url"), ("sentiment_scores", "headline"), ("trade_ledger", "price")):
        out[name] = sorted(tuple(str(x) for x in r) for r in snapshots.read(spark, root, poll.SPECS[name], snap).select("id", "ticker", key).collect())
    for name in (poll.SIGNALS, poll.PROMPTS):
        rows = snapshots.read(spark, root, name, snap).collect() if snap.tables.get(name) else []
        out[name] = sorted((r.ticker, str(r.as_of)) for r in rows)
    return out


def test_poll_writes_all_tables_or_none_and_replays_change_nothing(spark, world, monkeypatch):
    history, universe, score = world
    root = scratch_path(spark, "poll")
    poll.poll(landed(spark, 0), root, ("s", 0), history, universe, score)
    first = tables_of(spark, root)
    assert [t for t, _ in first[poll.SIGNALS]] == list("ABCDE")
    assert {x[1] for x in first["trade_ledger"]} == {"A", "B"} and len(first["news_staging"]) == 5 and len(first["market_quotes"]) == 3

    real, calls = snapshots.stage, []

    def dies(df, root, table):
        calls.append(table)
        if len(calls) == 3:
            raise RuntimeError("executor lost between two writes")
        return real(df, root, table)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "stage", dies)
        with pytest.raises(RuntimeError):
            poll.poll(landed(spark, 1), root, ("s", 1), history, universe, score)
    assert tables_of(spark, root) == first  # two tables were written, none is seen
    poll.poll(landed(spark, 1), root, ("s", 1), history, universe, score)
    second = tables_of(spark, root)
    assert len(second["news_staging"]) == 7 and len(second["trade_ledger"]) == 4
    poll.poll(landed(spark, 1), root, ("s", 1), history, universe, score)  # a replay
    poll.poll(landed(spark, 0), root, ("s", 0), history, universe, score)
    assert tables_of(spark, root) == second
    snap = snapshots.snapshot(spark, root)
    signals = {(r.ticker, r.as_of): r for r in snapshots.read(spark, root, poll.SIGNALS, snap).collect()}
    later = NOW + dt.timedelta(minutes=15)
    assert signals["A", later].decision == "BUY" and signals["A", later].news_count == 5 and signals["A", NOW].news_count == 4
    assert signals["B", later].decision == "HOLD" and signals["B", later].sentiment_source == "news_engine"
    assert signals["C", NOW].error.startswith("Failed") and signals["E", NOW].error.startswith("No price history")
    assert signals["E", NOW].current_price == 5.0 and signals["E", NOW].sentiment_source == "headlines"
    prompts = {(r.ticker, r.as_of): r.decision_prompt for r in snapshots.read(spark, root, poll.PROMPTS, snap).collect()}
    assert "Past 5 trades" not in prompts["A", NOW] and "1. 2024-03-01: BUY at $10.00" in prompts["A", later]


def test_poll_stream_equals_its_batches(spark, world):
    history, universe, score = world
    source, root, want = (scratch_path(spark, x) for x in ("landed", "poll-stream", "poll-batch"))
    for b in range(3):
        landed(spark, b).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(poll.LANDED).parquet(source)
        poll.poll_stream(stream, root, history, universe, score, f"{root}-ck", available_now=True).awaitTermination()
        poll.poll(landed(spark, b), want, ("batch", b), history, universe, score)
    assert tables_of(spark, root) == tables_of(spark, want)
    assert snapshots.snapshot(spark, root).batches == {"poll": 2}


def test_empty_batch_marks_its_number(spark, world):
    history, universe, score = world
    root = scratch_path(spark, "poll")
    snap = poll.poll(landed(spark, 0).limit(0), root, ("s", 4), history, universe, score)
    assert snap.batches == {"s": 4} and not any(snap.tables.values())
