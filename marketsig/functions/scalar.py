"""Scalar expressions: time conversion (X2-X5), class probabilities (X6-X8),
labels (A4), rounding and formatting (X9-X13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970 of a UTC wall-clock timestamp."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {_sql(ts)})")


def from_epoch(secs) -> Column:
    """Epoch seconds -> UTC timestamp (as TIMESTAMP_NTZ, zone-free)."""
    return F.timestamp_add("SECOND", _col(secs).cast("long"), F.expr(EPOCH))


def falsy_coalesce(*cols, empty=0) -> Column:
    """Python ``a or b or ...``: ``empty`` (0 or '') counts as missing, like
    NULL.  The last operand is returned as is (``item.get('url', '')``)."""
    *head, last = [_col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit(empty)) for c in head], last)


# The zone names of RFC 822, as offsets.
RFC822_ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
                "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_RFC822 = (r"(?i)^\s*(?:[a-z]+\s*,)?\s*([0-9]{1,2})\s+([a-z]{3})[a-z]*\s+([0-9]{4}|[0-9]{2})\s+"
           r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*([+-][0-9]{4}|[a-z]+)?\s*$")


def rss_to_timestamp(c) -> Column:
    """RFC-822 date ``'Mon, 01 Jan 2024 00:00:07 GMT'`` -> timestamp
    (TIMESTAMP_NTZ, UTC wall clock); an unparseable date gives NULL.

    The week-day and the seconds may be missing, the day and hour may have one digit, the year two
    (below 69: 20xx); numeric offsets and the RFC's zone names are applied, no zone is UTC and an
    unknown name gives NULL.  The time is parsed with its offset, so no session time zone is involved.
    """
    part = lambda k: F.regexp_extract(_col(c), _RFC822, k)
    month = F.concat(F.upper(F.substring(part(2), 1, 1)), F.lower(F.substring(part(2), 2, 2)))
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(
        F.concat(F.when(part(3) < "69", F.lit("20")).otherwise(F.lit("19")), part(3)))
    zone = F.upper(part(7))
    offset = F.when(zone == "", F.lit("+0000")).when(zone.rlike("^[+-]"), zone)
    for name, value in RFC822_ZONES.items():
        offset = offset.when(zone == name, F.lit(value))
    seconds = F.when(part(6) == "", F.lit("00")).otherwise(part(6))
    text = F.concat(F.lpad(part(1), 2, "0"), F.lit(" "), month, F.lit(" "), year, F.lit(" "), F.lpad(part(4), 2, "0"), F.lit(":"),
                    part(5), F.lit(":"), seconds, F.lit(" "), offset)
    instant = F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(EPOCH))


def rss_format(ts) -> Column:
    """RFC-822 rendering used by RSS feeds (for landing test feeds)."""
    return F.concat(F.date_format(_col(ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def seen_at(created_at, published_at) -> Column:
    """Recency time is the ingest time, else the publish time."""
    return F.coalesce(_col(created_at), _col(published_at))


# Class order of the scorer output (negative, neutral, positive).
CLASSES = ("negative", "neutral", "positive")


def softmax3(l_neg, l_neu, l_pos) -> list[Column]:
    """Probabilities of three logits, computed stably."""
    ls = [_col(l_neg).cast("double"), _col(l_neu).cast("double"), _col(l_pos).cast("double")]
    m = F.greatest(*ls)
    es = [F.exp(x - m) for x in ls]
    total = es[0] + es[1] + es[2]
    return [e / total for e in es]


def signed_score(p_neg, p_pos) -> Column:
    """p(positive) - p(negative), in [-1, 1]."""
    return _col(p_pos) - _col(p_neg)


def argmax_label(p_neg, p_neu, p_pos) -> Column:
    """Winning class; ties go to the first of negative, neutral, positive."""
    n, u, p = _col(p_neg), _col(p_neu), _col(p_pos)
    return (F.when(n.isNull() | u.isNull() | p.isNull(), F.lit(None).cast("string"))
            .when((n >= u) & (n >= p), F.lit(CLASSES[0]))
            .when(u >= p, F.lit(CLASSES[1])).otherwise(F.lit(CLASSES[2])))


# The aggregate label is positive above 0.2 and negative below
# -0.2 (strict), neutral otherwise.
LABEL_THRESHOLD = 0.2


def sentiment_label(score) -> Column:
    """A4: aggregate label with strict thresholds (exactly 0.2 is neutral)."""
    s = _col(score)
    return (F.when(s > LABEL_THRESHOLD, F.lit("positive"))
            .when(s < -LABEL_THRESHOLD, F.lit("negative")).otherwise(F.lit("neutral")))


def direction(score) -> Column:
    """Sign of a score as positive / negative / neutral."""
    s = _col(score)
    return F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")


def ymd(ts) -> Column:
    """``yyyy-MM-dd``."""
    return F.date_format(_col(ts), "yyyy-MM-dd")


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")


def fixed(x, digits: int) -> Column:
    """Python ``f'{x:.{digits}f}'``.

    ``format_number`` rounds the exact binary value half-to-even, as Python and
    C do; ``format_string('%.2f')`` rounds the shortest decimal half-up and
    differs on values such as 0.235.  Grouping commas are removed.
    """
    return F.regexp_replace(F.format_number(_col(x).cast("double"), digits), ",", "")


def signed_fixed(x, digits: int) -> Column:
    """Python ``f'{x:+.{digits}f}'`` (``-0.000`` keeps its sign)."""
    s = fixed(x, digits)
    return F.when(s.startswith("-"), s).otherwise(F.concat(F.lit("+"), s))


def py_round(x, digits: int) -> Column:
    """Python ``round(x, digits)`` -- the exact binary value rounded
    half-to-even (``F.round`` rounds the shortest decimal half-up, so
    -0.53375 would give -0.5338 where Python gives -0.5337).  A result of
    negative zero is returned as 0.0, so a value that is 0 in one engine and
    -1e-15 in another rounds to the same number.  Infinities stay as they are."""
    return F.coalesce(fixed(x, digits).try_cast("double"), _col(x).cast("double")) + F.lit(0.0)


def percent(x, digits: int) -> Column:
    """Python ``f'{x:.{digits}%}'``."""
    return F.concat(fixed(_col(x).cast("double") * 100.0, digits), F.lit("%"))


def time_literal(value, dtype: str = "timestamp_ntz") -> Column:
    """A driver-side time value as a literal of the column's own type.

    ``F.lit(naive datetime)`` makes a zone-aware TIMESTAMP from the Python
    process's local time, and comparing it with a TIMESTAMP_NTZ column then
    converts through the session time zone.  A wall-clock literal is built
    from its text instead, which no time zone touches.  Columns pass through.
    """
    import datetime as _dt
    if isinstance(value, Column):
        return value
    if value is None:
        return F.lit(None).cast(dtype)
    if dtype == "timestamp_ntz" and isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(dtype)
