"""Quote source (S1, S2, F1, F3): landed quote payloads -> quote rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vendor payload keys and the column each one becomes.
PAYLOAD_FIELDS = {
    "c": "current_price",
    "d": "change",
    "dp": "percent_change",
    "h": "high",
    "l": "low",
    "o": "open",
    "pc": "previous_close",
}
LANDED_SCHEMA = T.StructType([T.StructField("ticker", T.StringType()),
                              T.StructField("fetched_at", T.TimestampType()),
                              T.StructField("payload", T.StringType())])


def quote_struct(payload) -> Column:
    """S1/F1/F3 as an expression: the quote's fields as a struct, NULL where there is no quote.

    A payload that is not a JSON object holding all seven keys is a failed fetch and gives no quote
    (the reference indexes every key, so a missing one ends in its error path); other keys may hold
    anything.  A price of exactly 0 is no quote either, an explicit NULL is kept."""
    c = F.col(payload) if isinstance(payload, str) else payload
    # one parse into a map, so that key presence and values come from the same parse
    parsed = F.from_json(c, "map<string,string>")
    wanted = F.array(*[F.lit(k) for k in PAYLOAD_FIELDS])

    def fields(m: Column) -> Column:
        complete = F.size(F.array_intersect(F.map_keys(m), wanted)) == len(PAYLOAD_FIELDS)
        price = m["c"].try_cast("double")
        quote = F.struct(*[m[k].try_cast("double").alias(v) for k, v in PAYLOAD_FIELDS.items()])
        return F.when(complete & (price.isNull() | (price != 0)), quote)
    return F.get(F.transform(F.array(parsed), fields), F.lit(0))


def decode(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows whose payload holds a quote (``quote_struct``), its fields as columns."""
    rest = [c for c in df.columns if c != payload]
    # behind a generator Catalyst neither splits nor repeats the parse
    d = df.select(*rest, F.inline(F.array(F.struct(quote_struct(payload).alias("_q")))))
    return d.filter(F.col("_q").isNotNull()).select(*rest, "_q.*")


def read_landed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines files of ``{ticker, fetched_at, payload}``, schema fixed."""
    r = spark.readStream if stream else spark.read
    return r.schema(LANDED_SCHEMA).json(path)


def quotes_for(quotes: DataFrame, tickers, ticker: str = "ticker") -> DataFrame:
    """Quotes of a ticker list; tickers without a quote are simply absent."""
    from marketsig.operators.keys import in_universe
    return in_universe(quotes, ticker, tickers)
