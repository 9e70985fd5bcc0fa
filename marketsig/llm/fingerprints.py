"""I-Match document fingerprints, in DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon.  A document's distinct
lexicon terms are sorted and hashed: once whole, and once for each of several families of
randomised lexicon subsets.  A family keeps a term when the term's seeded hash is under a bound
that halves from one subset to the next; a document is hashed with the sparsest subset that still
holds one of its terms, so that documents of any length tolerate changes alike.

The band is relative to the number of documents: a lexicon term occurs in at least the share
``exp(-max_idf)`` of them, so there are at most (distinct terms of the average document) /
exp(-max_idf) such terms however many documents there are.  The lexicon is therefore broadcast
(up to a size that is checked) and terms are looked up where the text is: they are not shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsig.llm.common import stored

SEPARATOR = r"[^\p{L}\p{N}]+"
TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """Band of inverse document frequencies, ln(documents / documents with the term); subset families;
    terms of a lexicon that is broadcast (a larger one is joined by shuffle)."""

    min_idf: float = 2.3
    max_idf: float = 6.9
    families: int = 16
    broadcast_rows: int = 1_000_000


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits."""
    found = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR, -1))
    return F.transform(F.filter(found, lambda t: t != ""), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(term) hashes of the band, counted over all documents; empty for no documents."""
    s = settings
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(n, 1))) / F.col("df"))
    return stored(counted.filter(idf.between(s.min_idf, s.max_idf)).select("term"), "lexicon")


def whole(found: Column) -> Column:
    return F.xxhash64(F.array_sort(found))


def digest(subset: Column) -> Column:
    return F.lower(F.hex(F.pmod(F.xxhash64(subset), F.lit(1 << 32))))


def fingerprint(banded: str, other: str, settings: Settings = Settings()) -> Column:
    """Hashes in hex, joined by "-": of all terms of column ``banded`` (sorted), then of one subset
    of each family.  Without banded terms it is the hash of all terms, column ``other``, alone;
    without any term (null there) the empty string.
    """
    def family(j: Column) -> Column:
        # a term's seeded hash beside the term; the least hash is bound once, not per term
        seeded = F.transform(F.col(banded), lambda t: F.struct(F.xxhash64(t, j).bitwiseAND(F.lit(TOP)).alias("h"), t.alias("t")))
        return F.element_at(F.transform(F.array(seeded), subset), 1)

    def subset(pairs: Column) -> Column:
        least = F.array_min(pairs)["h"]
        bound = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(least, F.lit(1)).cast("double"))) + 1)
        return F.element_at(F.transform(F.array(bound), lambda b: digest(
            F.transform(F.filter(pairs, lambda p: p["h"] < b), lambda p: p["t"]))), 1)

    return (F.when(F.col(other).isNull(), "").when(F.size(banded) == 0, F.lower(F.hex(other)))
            .otherwise(F.concat_ws("-", digest(F.col(banded)),
                                   F.transform(F.sequence(F.lit(1), F.lit(settings.families)), family))))


def with_fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str], lexicon_table: DataFrame,
                      settings: Settings = Settings()) -> DataFrame:
    """``df`` without the text columns of ``texts`` but with the fingerprint named for each.

    ``keys`` tell the rows apart; where ``df`` is already partitioned by one of them, nothing is shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c not in texts]
    held = df.select(*keys, *rest, *[terms(F.col(t)).alias(t) for t in texts])
    for t in texts:
        held = held.withColumn(f"__whole_{t}", F.when(F.size(t) > 0, whole(F.col(t))))

    def of_side(k: int, t: str) -> Column:
        return F.transform(F.col(t), lambda x: F.struct(F.lit(k).alias("side"), x.alias("term")))

    sides = F.concat(*[of_side(k, t) for k, t in enumerate(texts)])
    carried = [c for c in held.columns if c not in keys and c not in texts]
    rows = held.select(*keys, *carried, F.posexplode_outer(sides).alias("pos", "found")).select(
        *keys, *carried, "pos", "found.side", "found.term")
    known = lexicon_table.withColumn("banded", F.lit(True))
    if lexicon_table.count() <= settings.broadcast_rows:
        known = F.broadcast(known)
    rows = rows.join(known, "term", "left").filter("banded or pos = 0 or pos is null")  # a row of each text stays
    grouped = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        *[F.array_sort(F.collect_list(F.when(F.col("banded") & (F.col("side") == k), F.col("term")))).alias(t) for k, t in enumerate(texts)])
    return grouped.select(*keys, *rest, *[fingerprint(t, f"__whole_{t}", settings).alias(n) for t, n in texts.items()])


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of subset hashes that are equal; 0 beside a null."""
    x, y = F.split(a, "-"), F.split(b, "-")
    same = F.size(F.filter(F.zip_with(F.slice(x, 2, 1 << 20), F.slice(y, 2, 1 << 20), lambda p, q: p == q), lambda e: e))
    return F.coalesce(F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
                      .otherwise(same / F.greatest(F.size(x) - 1, F.lit(1))), F.lit(0.0))


def _ranges(docs: DataFrame, n: int) -> Column:
    """A number that grows with doc_id and splits the ids into about ``n`` even ranges."""
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))  # two short searches instead of a long one
    fine, coarse = F.lit([float(c) for c in cuts]), F.lit([float(c) for c in cuts[::step]])
    at = F.col("doc_id").cast("double")
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= at)) - 1, F.lit(0)) * step
    return block + F.size(F.filter(F.slice(fine, block + 1, F.lit(step)), lambda c: c <= at))


def in_ranges(docs: DataFrame, tie: str) -> DataFrame:
    """``docs`` plus ``range`` and ``ghost``: even ranges of doc_id, to be ordered apart by descending doc_id.

    In each range one more row (ghost 1) repeats the row that follows the range's last one: the
    first of the next range down or, after the last, of the highest.  Equal ids are ordered by
    ``tie``.  Rows without doc_id get ranges of their own, below 0.
    """
    spark = docs.sparkSession
    ids = docs.filter("doc_id is not null").select("doc_id")
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = _ranges(ids, n)
    tops = sorted((r.range, r.top) for r in ids.groupBy(number.alias("range")).agg(F.max("doc_id").alias("top")).collect())  # one a range
    placed = docs.withColumns({
        "range": F.when(F.col("doc_id").isNotNull(), number).otherwise(-1 - F.pmod(F.xxhash64(tie), F.lit(n))).cast("int"), "ghost": F.lit(0)})
    if not tops:
        return placed
    follows = spark.createDataFrame([(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)], "top long, range int")
    firsts = (docs.join(F.broadcast(follows), F.col("doc_id") == F.col("top")).groupBy("doc_id", "range")
              .agg(*[F.min_by(c, tie).alias(c) for c in docs.columns if c != "doc_id"]))
    return placed.unionByName(firsts.withColumn("ghost", F.lit(1)))


def op10(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints of every document and of its text with the last third replaced by the start
    of the next document's, and how alike they are.

    The next document is the following one by descending doc_id, after the last the first; equal
    ids are ordered by text.  A row without doc_id has no next document: its text loses its last
    third and near_next is 0.  Null texts are empty ones.
    """
    s = settings
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy("ghost", F.desc("doc_id"), "text")
    known = F.col("doc_id").isNotNull()
    cut = F.floor(F.length("text") / 3).cast("int")
    paired = (in_ranges(rows, "text")
              .withColumns({"next_text": F.when(known, F.lead("text").over(order)), "row": F.row_number().over(order)})
              .withColumns({"n_chars": F.length("text").cast("long"), "edited": F.concat(
                  F.left("text", F.length("text") - cut), F.left(F.coalesce("next_text", F.lit("")), cut))})
              .withColumn("edited_sha256", F.sha2("edited", 256)).drop("next_text"))
    both = with_fingerprints(paired, ["range", "row"], {"text": "fingerprint", "edited": "edited_fingerprint"}, lexicon(rows, s), s)
    following = F.when(known, F.lead("fingerprint").over(Window.partitionBy("range").orderBy("row")))
    return (both.withColumn("next", following).filter("ghost = 0").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next")))
