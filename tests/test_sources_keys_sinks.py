import datetime as dt
import os

from pyspark.sql import functions as F

from marketsig.operators import keys, sinks, validate
from marketsig.plans import news as news_plan
from marketsig.schemas import MARKET_QUOTES, NEWS_STAGING, TRADE_LEDGER
from marketsig.sources import news, quotes

T0 = dt.datetime(2026, 1, 27, 12, 0)


def test_quote_decode(spark):
    rows = [("AAPL", '{"c":184.89,"d":-10.67,"dp":-5.46,"h":195.56,"l":183.0,"o":195.0,"pc":195.56}'),
            ("ZERO", '{"c":0,"d":0,"dp":0,"h":0,"l":0,"o":0,"pc":0}'),
            ("NULL", '{"c":null,"d":1,"dp":null,"h":null,"l":null,"o":null,"pc":null}'),
            ("MISSING", '{"d":1}'), ("BAD", '{not json'), ("EMPTY", ''), ("NONE", None)]
    q = {r.ticker: r for r in quotes.decode(spark.createDataFrame(rows, "ticker string, payload string")).collect()}
    assert set(q) == {"AAPL", "NULL"}
    assert q["NULL"].current_price is None and q["NULL"].change == 1.0
    assert q["AAPL"].current_price == 184.89 and q["AAPL"].previous_close == 195.56


def test_primary_first_ten_then_filter(spark):
    items = [(f"t{i}" if i not in (1, 3, 5, 7) else "", f"u{i}", None, 1_700_000_000 + i, None) for i in range(12)]
    df = spark.createDataFrame([("AAPL", T0, items)], news.PRIMARY_SNAPSHOT)
    got = news.primary_articles(df).collect()
    assert len(got) == 6                                   # 10 taken, 4 blank dropped
    assert got[0].published_at == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_falsy_coalesce_fields(spark):
    items = [("A", "", "u-fallback", 0, 1_700_000_000)]
    df = spark.createDataFrame([("X", T0, items)], news.PRIMARY_SNAPSHOT)
    r = news.primary_articles(df).first()
    assert r.url == "u-fallback" and r.published_at == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_secondary_keeps_empty_headline(spark):
    df = spark.createDataFrame([("T", 0, "", "l0", "Mon, 01 Jan 2024 00:00:07 GMT"),
                                ("T", 1, "<b>x</b> - Reuters", "l1", "Tue, 02 Jan 2024 10:00:00 GMT")],
                               "ticker string, pos int, title string, link string, pubDate string")
    got = {r.pos: r for r in news.secondary_articles(df).collect()}
    assert got[0].headline == "" and got[1].headline == "x"
    assert got[0].published_at == dt.datetime(2024, 1, 1, 0, 0, 7)


def test_url_owned_by_first_ticker(spark):
    feed = spark.createDataFrame([("AAPL", "u1", 1), ("MSFT", "u1", 2), ("MSFT", "u2", 3), ("AAPL", "u2", 4)],
                                 "ticker string, url string, pos int")
    got = {r.url: r.ticker for r in keys.insert_ignore(feed, None, "url", ["pos"]).collect()}
    assert got == {"u1": "AAPL", "u2": "MSFT"}
    stored = spark.createDataFrame([("u2",)], "url string")
    assert [r.url for r in keys.insert_ignore(feed, stored, "url", ["pos"]).collect()] == ["u1"]


def test_fallback(spark):
    p = spark.createDataFrame([("A", "p1")], "ticker string, url string")
    s = spark.createDataFrame([("A", "s1"), ("B", "s2")], "ticker string, url string")
    assert sorted(r.url for r in keys.fallback(p, s).collect()) == ["p1", "s2"]


def test_news_plan_empty_fetch_reads_nothing(spark):
    cols = "ticker string, url string, headline string, created_at timestamp_ntz, published_at timestamp_ntz, pos int"
    primary = spark.createDataFrame([("A", "a1", "good", T0, None, 0)], cols)
    secondary = spark.createDataFrame([], cols)
    existing = spark.createDataFrame([("B", "b0", "old", T0, None, 0.9)],
                                     "ticker string, url string, headline string, created_at timestamp_ntz, "
                                     "published_at timestamp_ntz, sentiment_score double")
    universe = spark.createDataFrame([("A",), ("B",)], "ticker string")
    sig, new = news_plan.news_signals(primary, secondary, existing, lambda d: d.withColumn("sentiment_score", F.lit(0.8)),
                                      T0, universe)
    out = {r.ticker: r for r in sig.collect()}
    assert out["A"].articles_count == 1 and out["A"].alert
    assert out["B"].articles_count == 0 and out["B"].score == 0.0     # stored news of B not read (M16)
    assert [r.url for r in new.collect()] == ["a1"]


def test_validator(spark):
    rows = [(1, "AAPL", "BUY", 10.0, T0), (2, "TOO_LONG_TICKER", "SELL", 1.0, T0), (3, "X", "WAIT", 1e9, None)]
    df = spark.createDataFrame(rows, "id long, ticker string, action string, price double, timestamp timestamp")
    df = df.withColumn("approved", F.lit(True)).withColumn("quantity", F.lit(0))
    for c in ("reasoning", "portfolio_manager_reasoning"):
        df = df.withColumn(c, F.lit(""))
    for c in ("sentiment_avg", "rsi", "macd"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    got = {r.id: r.reason for r in validate.check(df, TRADE_LEDGER).collect()}
    assert got[1] is None
    assert got[2] == "ticker longer than 10"
    assert got[3] == "timestamp is null; action not in BUY/SELL/HOLD; price overflows decimal(12,4)"


def test_sinks_roundtrip(spark, tmp_path):
    root = str(tmp_path / "tables")
    sinks.create_tables(spark, root)
    sinks.create_tables(spark, root)                       # idempotent
    q = spark.createDataFrame([(1, "AAPL", 184.89, T0), (2, "AAPL", 185.0, T0), (3, "MSFT", 272.14, T0)],
                              "id long, ticker string, current_price double, timestamp timestamp")
    for c in ("change", "percent_change", "high", "low", "open", "previous_close"):
        q = q.withColumn(c, F.lit(1.0))
    first = sinks.insert_ignore_into(q, root, MARKET_QUOTES, ["id"])
    assert first.count() == 2
    again = sinks.insert_ignore_into(q, root, MARKET_QUOTES, ["id"])
    assert again.count() == 0
    assert sinks.read_table(spark, root, MARKET_QUOTES).count() == 2

    n = spark.createDataFrame([("s1", "AAPL", "yf", "h", "u1", None, None, T0),
                               ("s2", "AAPL", "yf", "h", "u2", None, None, T0)],
                              "id string, ticker string, source string, headline string, url string, "
                              "published_at timestamp, sentiment_score double, created_at timestamp")
    assert sinks.append(n, root, NEWS_STAGING).count() == 0
    upd = spark.createDataFrame([("u1", 0.5)], "url string, sentiment_score double")
    sinks.update_scores(spark, root, upd)
    got = {r.url: r.sentiment_score for r in sinks.read_table(spark, root, NEWS_STAGING).collect()}
    assert got == {"u1": 0.5, "u2": None}
    assert os.path.isdir(os.path.join(root, "trade_ledger"))


def test_universe_dataframe_and_list(spark):
    df = spark.createDataFrame([("aapl", 1), ("msft", 2), ("tsla", 3)], "ticker string, v int")
    u = spark.createDataFrame([("AAPL",), ("TSLA",)], "t string")
    assert sorted(r.v for r in keys.in_universe(df, "ticker", u).collect()) == [1, 3]
    assert sorted(r.v for r in keys.in_universe(df, "ticker", ["MSFT"]).collect()) == [2]


def test_lexicon_table_matches_literal(spark):
    from marketsig.operators import sentiment as S
    docs = spark.createDataFrame([(1, "Good gains, good growth; bad loss."), (2, "nothing here"), (3, "")],
                                 "doc_id int, text string")
    lex = {"good": "positive", "gains": "positive", "bad": "negative", "loss": "negative"}
    lit = {r.doc_id: (r.n_tokens, r.n_pos, r.n_neg) for r in S.lexicon_counts(docs, "text", lex).collect()}
    table = spark.createDataFrame(list(lex.items()), "word string, cls string")
    tab = {r.doc_id: (r.n_tokens, r.n_pos, r.n_neg) for r in S.lexicon_counts_table(docs, "doc_id", "text", table).collect()}
    assert lit == tab == {1: (6, 3, 2), 2: (2, 0, 0), 3: (0, 0, 0)}


def test_landed_json_readers(spark, tmp_path):
    q = tmp_path / "quotes"
    q.mkdir()
    (q / "a.json").write_text('{"ticker":"AAPL","fetched_at":"2026-01-27T12:00:00Z",'
                              '"payload":"{\\"c\\":184.89,\\"d\\":-10.67,\\"dp\\":-5.46,\\"h\\":195.56,'
                              '\\"l\\":183.0,\\"o\\":195.0,\\"pc\\":195.56}"}\n')
    got = quotes.decode(quotes.read_landed(spark, str(q))).first()
    assert got.ticker == "AAPL" and got.current_price == 184.89 and got.low == 183.0
    n = tmp_path / "news"
    n.mkdir()
    (n / "a.json").write_text('{"ticker":"AAPL","fetched_at":"2026-01-27T12:00:00Z","items":['
                              '{"title":"<b>Apple</b> soars - Reuters","link":"https://x/1","providerPublishTime":1700000000},'
                              '{"title":"","url":"https://x/2","publishedAt":1700000001}]}\n')
    arts = news.primary_articles(news.read_snapshots(spark, str(n))).collect()
    assert [(a.headline, a.url) for a in arts] == [("Apple soars", "https://x/1")]


def test_fill_defaults(spark):
    df = spark.createDataFrame([(None, "AAPL", "yf", "h", "https://x/1", None, None, None)],
                               "id string, ticker string, source string, headline string, url string, "
                               "published_at timestamp, sentiment_score double, created_at timestamp")
    out = validate.fill_defaults(df, NEWS_STAGING, T0).first()
    assert out.created_at == T0 and len(out.id) == 64
    assert validate.check(validate.fill_defaults(df, NEWS_STAGING, T0), NEWS_STAGING).first().valid


def test_sql_registration(spark, tmp_path):
    root = str(tmp_path / "tbl")
    sinks.create_tables(spark, root)
    q = spark.createDataFrame([(1, "AAPL", 184.89, T0)], "id long, ticker string, current_price double, timestamp timestamp")
    for c in ("change", "percent_change", "high", "low", "open", "previous_close"):
        q = q.withColumn(c, F.lit(1.0))
    sinks.append(q, root, MARKET_QUOTES)
    sinks.register_tables(spark, root, [MARKET_QUOTES])
    assert spark.sql("SELECT count(*) AS n FROM market_quotes WHERE ticker = 'AAPL'").first().n == 1
    spark.sql("DROP TABLE market_quotes")


def test_state_layout(spark):
    import __spark_entry__ as E
    from marketsig.plans import catalog, signals
    a = catalog._signal_inputs(spark, "/root/testdata/sf0.001")
    st = signals.as_state(a, T0)
    assert [f.name for f in st.schema] == ["ticker", "as_of", "market", "news_alert", "sentiment", "technical",
                                           "decision", "error"]
    assert st.schema["news_alert"].dataType.names == ["score", "alert", "articles_count", "direction"]
    assert st.count() == E.queries()["signal_assembly"](spark, "/root/testdata/sf0.001").count()


def test_bad_feed_values_do_not_fail(spark):
    """A malformed RSS date gives a NULL time (no job failure); a zero epoch
    is a missing publish time, as the reference's truthiness check has it."""
    df = spark.createDataFrame([("T", 0, "a", "l", "garbage"), ("T", 1, "b", "m", None)],
                               "ticker string, pos int, title string, link string, pubDate string")
    assert [r.published_at for r in news.secondary_articles(df).collect()] == [None, None]
    items = [("A", "u", None, 0, 0)]
    s = spark.createDataFrame([("X", T0, items)], news.PRIMARY_SNAPSHOT)
    assert news.primary_articles(s).first().published_at is None


def test_updates_of_one_key_never_add_rows(spark):
    table = spark.createDataFrame([("u1", 0.1), ("u2", None)], "url string, score double")
    updates = spark.createDataFrame([("u1", 0.5), ("u1", 0.7), ("u1", None), ("u3", 0.9)], "url string, score double")
    got = sorted((r.url, r.score) for r in keys.apply_updates(table, updates, "url", "score").collect())
    assert got == [("u1", 0.7), ("u2", None)]


def test_universe_longer_than_the_broadcast_limit(spark):
    names = [f"T{i}" for i in range(keys.MAX_LITERAL_BROADCAST + 50_000)]
    d = spark.createDataFrame([("t7",), (names[-1],), ("other",)], "ticker string")
    assert sorted(r.ticker for r in keys.in_universe(d, "ticker", names).collect()) == [names[-1], "t7"]


def test_insert_returns_only_rows_written(spark, tmp_path):
    root = str(tmp_path / "tables")
    sinks.create_tables(spark, root)
    n = spark.createDataFrame([("s1", "A ticker too long", "yf", "h", "u1", None, None, T0), ("s2", "AAPL", "yf", "h", "u2", None, None, T0)],
                              "id string, ticker string, source string, headline string, url string, "
                              "published_at timestamp, sentiment_score double, created_at timestamp")
    assert [r.url for r in sinks.insert_ignore_into(n, root, NEWS_STAGING, ["id"]).collect()] == ["u2"]
    assert [r.url for r in sinks.read_table(spark, root, NEWS_STAGING).collect()] == ["u2"]


def test_round_of_infinity(spark):
    from marketsig.functions.scalar import py_round
    d = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1234.5678,), (None,)], "x double")
    assert [r.y for r in d.select(py_round("x", 2).alias("y")).collect()] == [float("inf"), float("-inf"), 1234.57, None]
