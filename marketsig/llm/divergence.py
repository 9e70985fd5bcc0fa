"""Source divergence audit: how the term shares of a language's sources differ, in exact integers.

One pass counts the documents of each term.  The kept terms, sorted, are cut into shards, and each
shard becomes a minimal acyclic transducer: an automaton that accepts its terms and adds up, along
the way, a term's lexicographic ordinal.  A second pass streams all texts through the transducers
and counts ordinals by language and source; from there on only ordinals are counted, compared and
used to break ties, and names come back at the very end.

Pairs of sources are compared over blocks of ordinals, all sources of a language side by side, so
terms that a source never uses cost no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketsig.llm.common import stored

#: Letters and everything beyond ASCII, A-Z lower-cased; other bytes separate.
TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """``least_docs`` of a kept term, ``top`` terms reported a group.  ``shard``: terms a transducer.
    ``broadcast_bytes``: transducers that are sent to the tasks at once; more take further passes over the
    texts.  ``held``: counts a task holds before it passes them on, and places of a language that it
    remembers.  ``cells``: counts of a block of terms, all sources together."""

    least_docs: int = 10
    top: int = 10
    shard: int = 1 << 16
    broadcast_bytes: int = 32 << 20
    held: int = 1 << 19
    cells: int = 1 << 18


def term_lists(text: str, chunk: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    said = text.encode().translate(TERMS)
    at = 0
    while at < len(said):
        end = len(said) if len(said) - at <= chunk else said.find(b" ", at + chunk)
        yield said[at: len(said) if end < 0 else end].split()
        at = len(said) if end < 0 else end


class Transducer:
    """A minimal acyclic transducer from sorted distinct terms to their places in that order.

    States are numbered children first, arcs sorted by (state, byte); an arc carries the number of
    terms that branch off before it, final state included.
    """

    def __init__(self, states: np.ndarray, labels: np.ndarray, targets: np.ndarray, before: np.ndarray, final: np.ndarray):
        self.targets, self.before, self.final = targets, before, final
        self.keys = states.astype(np.int64) * 256 + labels

    @classmethod
    def build(cls, terms: list[bytes]) -> "Transducer":
        known: dict[tuple, int] = {}  # equal states are one
        states: list[int] = []
        labels: list[int] = []
        targets: list[int] = []
        before: list[int] = []
        final: list[bool] = []
        reach: list[int] = []  # terms that end at or after a state
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

        def close(node: tuple[list[bool], list[tuple[int, int]]]) -> int:
            ends, arcs = node[0][0], tuple(node[1])
            state = known.setdefault((ends, arcs), len(final))
            if state == len(final):
                seen = int(ends)
                for label, target in arcs:
                    states.append(state)
                    labels.append(label)
                    targets.append(target)
                    before.append(seen)
                    seen += reach[target]
                final.append(ends)
                reach.append(seen)
            return state

        last = b""
        for term in [*terms, b""]:
            same = 0
            while same < min(len(last), len(term)) and last[same] == term[same]:
                same += 1
            for depth in range(len(last), same, -1):  # what no further term shares
                path[-2][1].append((last[depth - 1], close(path.pop())))
            path += [([False], []) for _ in term[same:]]
            path[-1][0][0] |= bool(term)
            last = term
        close(path[0])
        return cls(np.array(states, np.int32), np.array(labels, np.uint8), np.array(targets, np.int32), np.array(before, np.int32), np.array(final, bool))

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.final)], "<i4")
        return b"".join(x.tobytes() for x in (head, (self.keys >> 8).astype("<i4"), self.targets.astype("<i4"), self.before.astype("<i4"),
                                              (self.keys & 255).astype(np.uint8), self.final.astype(np.uint8)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Transducer":
        arcs, states = np.frombuffer(raw, "<i4", 2)
        ints = np.frombuffer(raw, "<i4", 3 * arcs, 8).reshape(3, arcs)
        rest = np.frombuffer(raw, np.uint8, arcs + states, 8 + 12 * arcs)
        return cls(ints[0], rest[:arcs], ints[1], ints[2], rest[arcs:].astype(bool))

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The place of each term, -1 for one that is not accepted; all terms take a step at a time."""
        sizes = np.array([len(t) for t in terms], np.int64)
        u8 = np.frombuffer(b"".join(terms), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.full(len(terms), len(self.final) - 1, np.int64)
        place = np.zeros(len(terms), np.int64)
        alive = np.arange(len(terms)) if len(self.keys) else np.zeros(0, np.int64)
        out = np.full(len(terms), -1, np.int64)
        step = 0
        while len(alive):
            done = sizes[alive] == step
            ended = alive[done]
            ended = ended[self.final[state[ended]]]
            out[ended] = place[ended]
            alive = alive[~done]
            want = state[alive] * 256 + u8[begins[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            found = self.keys[arc] == want
            alive, arc = alive[found], arc[found]
            state[alive] = self.targets[arc]
            place[alive] += self.before[arc]
            step += 1
        return out


def document_frequencies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, term, docs): in how many rows of a language each term occurs."""
    def rows(held: dict[str, Counter]) -> pa.RecordBatch:
        of = pa.array(np.repeat(np.arange(len(held)), [len(c) for c in held.values()]))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()).take(of), pa.array([t for c in held.values() for t in c], pa.string()),
                                           pa.array([n for c in held.values() for n in c.values()], pa.int64())], names=["lang", "term", "docs"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                said: set[bytes] = set()
                for terms in term_lists(text):
                    said.update(terms)
                held[lang].update(said)
                if sum(map(len, held.values())) >= s.held:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return docs.select("lang", "text").mapInArrow(task, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, first, n, fst, terms, base): the transducers of runs of the sorted kept terms; ``base`` terms of
    the language come before a run's."""
    kept = stored(document_frequencies(docs, s).filter(F.col("docs") >= s.least_docs).select("lang", "term"), "kept-terms")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []

        def row() -> pa.RecordBatch:
            columns = [pa.array([lang], pa.string()), pa.array([terms[0]], pa.string()), pa.array([len(terms)], pa.int64()),
                       pa.array([Transducer.build([t.encode() for t in terms]).to_bytes()], pa.binary()), pa.array([terms], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "first", "n", "fst", "terms"])

        for batch in batches:
            for one, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if terms and (one != lang or len(terms) >= s.shard):
                    yield row()
                    terms = []
                lang = one
                terms.append(term)
        if terms:
            yield row()

    runs = (kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(task, "lang string, first string, n long, fst binary, terms array<string>"))
    runs = stored(runs, "term-runs")
    earlier = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("lang", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))  # one row a run
    return stored(runs.join(bases, ["lang", "first"]), "transducers")


def recount(docs: DataFrame, runs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, source, ordinal, n): how often each group says each kept term, from the texts through the transducers.

    The transducers go to the tasks in rounds of ``broadcast_bytes``, usually one; each round is a pass
    over the texts for its own terms.
    """
    sc = docs.sparkSession.sparkContext
    small = runs.select("lang", "first", "base", F.length("fst").alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy("lang", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rounds = stored(small.withColumn("round", F.floor((upto - 1) / s.broadcast_bytes)), "rounds")  # one row a run
    parts = []
    for k in range((rounds.agg(F.max("round")).first()[0] or 0) + 1):
        own = runs.join(rounds.filter(F.col("round") == k).select("lang", "first"), ["lang", "first"])
        shared = sc.broadcast(sorted((r.lang, r.first.encode(), r.base, bytes(r.fst)) for r in own.select("lang", "first", "base", "fst").collect()))
        parts.append(_recount(docs, shared, s))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _recount(docs: DataFrame, shared, s: Settings) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict[str, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
        for lang, first, base, fst in shared.value:
            for held, x in zip(machines[lang], (first, base, Transducer.from_bytes(fst))):
                held.append(x)
        places: dict[str, dict[bytes, int]] = defaultdict(dict)
        groups: dict[tuple[str, str], int] = {}
        counts, pending = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def learn(lang: str, terms: set[bytes]) -> None:
            firsts, bases, fsts = machines[lang]
            by_run: dict[int, list[bytes]] = defaultdict(list)
            for t in terms:
                by_run[bisect_right(firsts, t) - 1].append(t)
            for k, own in by_run.items():
                found = fsts[k].ordinals(own) if k >= 0 else np.full(len(own), -1)
                places[lang].update(zip(own, np.where(found >= 0, found + (bases[k] if k >= 0 else 0), -1).tolist()))

        def look_up(waiting: dict[str, list[tuple[int, list[bytes]]]]) -> None:
            for lang, own in waiting.items():
                known = places[lang]
                said = set().union(*(terms for _, terms in own))
                if new := said.difference(known):
                    if len(known) + len(new) > s.held:
                        known.clear()
                        new = said
                    learn(lang, new)
                for group, terms in own:
                    at = np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))
                    pending.append(at[at >= 0] + (group << 40))

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([counts[0], *pending]), return_inverse=True)
            total = np.bincount(at[len(counts[0]):], minlength=len(keys))
            total[at[: len(counts[0])]] += counts[1]
            return keys, total

        def rows() -> pa.RecordBatch:
            of = pa.array(counts[0] >> 40)
            lang, source = (pa.array([g[k] for g in groups], pa.string()).take(of) for k in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, pa.array(counts[0] & (1 << 40) - 1), pa.array(counts[1])], names=["lang", "source", "ordinal", "n"])

        waiting, size, said = defaultdict(list), 0, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                if lang not in machines:
                    continue
                for terms in term_lists(text):
                    waiting[lang].append((groups.setdefault((lang, source), len(groups)), terms))
                    size += len(terms)
                    if size >= 1 << 17:
                        look_up(waiting)
                        waiting, size, said = defaultdict(list), 0, said + size
                if said >= 1 << 20:
                    counts, pending, said = merged(), [], 0
                    if len(counts[0]) >= s.held:
                        yield rows()
                        counts = counts[0][:0], counts[1][:0]
        look_up(waiting)
        counts = merged()
        yield rows()

    return docs.select("lang", "source", "text").mapInArrow(task, "lang string, source string, ordinal long, n long")


def share(n: str, total: str) -> str:
    """SQL of 1 + floor(SCALE * n / total), n at most total, without leaving 64 bits."""
    left, whole = n, "0"
    for _ in range(3):
        whole, left = f"({whole} * 1000 + ({left} * 1000) div {total})", f"(({left} * 1000) % {total})"
    return f"(1 + {whole})"


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    left, whole = n, np.zeros_like(n)
    for _ in range(3):
        whole, left = whole * 1000 + left * 1000 // total, left * 1000 % total
    return whole + 1


def pair_values(counts: DataFrame, groups: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, a, b, value) of every two sources a < b of a language: the summed terms of their divergence.

    ``groups`` has (lang, source, total, v, sources): a group's summed counts, its language's kept terms
    and sources.  A task takes a block of terms and all sources.
    """
    width = F.greatest(F.lit(64), F.floor(F.lit(s.cells) / F.col("sources"))).cast("long")
    blocks = groups.withColumn("width", width).withColumn("block", F.explode(F.expr("sequence(0L, greatest(v - 1, 0L) div width)")))
    heads = blocks.select("lang", "block", "source", "total", "v", "width", F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("n"))
    widths = groups.groupBy("lang").agg(F.first(width).alias("width"))
    cells = counts.join(widths, "lang").select("lang", F.expr("ordinal div width").alias("block"), "source", F.lit(None).cast("long").alias("total"),
                                               F.lit(None).cast("long").alias("v"), "width", "ordinal", "n")

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, block = key
        head = rows[rows["total"].notna()].sort_values("source")
        names, width = head["source"].tolist(), int(head["width"].iloc[0])
        v = int(head["v"].iloc[0])
        n = np.zeros((len(names), min(width, v - block * width)), np.int64)
        body = rows[rows["total"].isna()]
        place = {x: i for i, x in enumerate(names)}
        n[body["source"].map(place).to_numpy(np.int64), body["ordinal"].to_numpy(np.int64) - block * width] = body["n"].to_numpy(np.int64)
        p = shares(n + 2, (head["total"].to_numpy(np.int64) + 2 * v)[:, None]) if n.size else n
        found: list[tuple] = []
        for i in range(len(names) - 1):
            others = p[i + 1:]
            value = ((others - p[i]) ** 2 // (others + p[i])).sum(axis=1)
            found += [(lang, names[i], b, v) for b, v in zip(names[i + 1:], value.tolist())]
        return pd.DataFrame(found, columns=["lang", "a", "b", "value"])

    return (heads.unionByName(cells).groupBy("lang", "block").applyInPandas(task, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by their
    divergence from the group, part ``term`` the terms that set the group apart from its language.

    Null text, lang and source are empty strings; every row counts as a document of its own.  A language
    without kept terms has pairs of value 0, one with a single source has none, an empty table gives no
    row; other columns are ignored.
    """
    s = settings
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = vocabulary(rows, s)
    counts = stored(recount(rows, runs, s), "term-counts")
    sizes = runs.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    groups = stored(groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang"))), "groups")  # one row a group

    pairs = pair_values(counts, groups, s)
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "value")
    pairs = pairs.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    apart = (counts.join(of_lang, ["lang", "ordinal"]).join(groups.drop("sources"), ["lang", "source"]).join(langs, "lang")
             .withColumns({"p": F.expr(share("(n + 2)", "(total + 2 * v)")), "q": F.expr(share("(all_n + 2)", "(all_total + 2 * v)"))})
             .filter("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)")))
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")  # ordinals are in the terms' order
    apart = stored(apart.select("lang", "source", "ordinal", "value", F.row_number().over(first).alias("rank")).filter(F.col("rank") <= s.top), "top-terms")
    names = runs.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "item")
    terms = apart.join(names, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


#: The same rows in DuckDB SQL.
SQL = r"""
with d as (select row_number() over () as id, coalesce(text, '') as body, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct id) >= 10),
c as (select lang, source, term, count(*) as cnt from t join kept using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
langs as (select l.lang, count(term) as v from (select distinct lang from d) l left join kept using (lang) group by l.lang),
totals as (select g.lang, g.source, coalesce(sum(cnt), 0) as total from g left join c using (lang, source) group by g.lang, g.source),
p as (select g.lang, g.source, k.term, coalesce(cnt, 0) as cnt,
             1 + (1000000000::hugeint * (coalesce(cnt, 0) + 2)) // (total + 2 * v) as p
      from g join kept k using (lang) left join c using (lang, source, term) join totals using (lang, source) join langs using (lang)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(cnt) + 2)) // (any_value(all_total) + 2 * any_value(v)) as q
      from p join langs using (lang) join (select lang, sum(total) as all_total from totals group by lang) using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as total
         from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
ranked as (
  select lang, source, 'pair' as part, item, coalesce(total, 0)::bigint as value from pairs left join sums using (lang, source, item)
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p join q using (lang, term) where cnt > 0 and p > q),
numbered as (select *, row_number() over (partition by lang, source, part order by value desc, item) as place from ranked)
select lang, source, part, item, value, place::int as rank from numbered where part = 'pair' or place <= 10
"""
