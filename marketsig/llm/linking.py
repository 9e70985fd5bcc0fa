"""Groups of linked rows from rows that share a key, without writing out all pairs of a group.

Only the groups are wanted, so a pair inside a group already found need not be tried.  First each
key's smallest id is paired with the key's other ids (a star): what links joins one component.
Then, for keys that still hold several components, the rows outside the key's largest component
are paired with the key's rows of other components.  No pair of different components that shares a
key is left untried, so no group is lost; a group of n near copies costs about n pairs, not n * n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketsig.llm.common import scratch, stored

#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def with_ids(df: DataFrame, column: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with a stored table of ids, broadcast while it is small."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, column, how)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Alternates large-star and small-star steps, which hang every neighbour on the smallest one,
    until only stars are left; each step is written to the shared folder.
    """
    def edges(df: DataFrame) -> DataFrame:  # from the larger to the smaller id
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def only_stars(df: DataFrame) -> bool:  # no id hangs on two, none that hangs has another one hang on it
        ends = df.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()

    now = stored(edges(links), "links")
    while not only_stars(now):
        with scratch():
            both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = stored(edges(large), "large-star")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
            now = stored(edges(small), "small-star", outlives=1)
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)


def groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[str, str], F.Column] | None = None) -> DataFrame:
    """(id, component) of every id that links to another one.

    ``members`` is a stored table of (key, id, ...); two ids may link only if they share a key.
    ``verify`` takes distinct pairs (a, b), a < b, and returns those that link.  ``near`` gives a
    cheap condition on a key's two rows, from their column prefixes, that every linked pair meets
    at one of its keys; pairs that meet it at none are not handed to ``verify``.
    """
    others = [c for c in members.columns if c not in ("key", "id")]
    shared = (members.groupBy("key").agg(F.min(F.struct("id", *others)).alias("least"), F.max("id").alias("most"))
              .filter("least.id < most").select("key", F.col("least.id").alias("leader"), *[F.col(f"least.{c}").alias(f"leader_{c}") for c in others]))
    held = stored(members.join(stored(shared, "leaders"), "key"), "shared-keys")
    possible = F.col("id") > F.col("leader")
    if near is not None:  # a linked pair that fails here meets it at another key, or is tried below
        possible &= near("leader_", "")
    star = held.filter(possible).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    with scratch():
        links = stored(verify(star), "star-links", outlives=1)
    with scratch():
        found = stored(components(links), "components", outlives=1)

    labelled = held.select("key", "id", *others).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = (counts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
             .filter("parts > 1").select("key", F.col("top.component").alias("largest")))
    rest = stored(labelled.join(mixed, "key"), "mixed-keys")
    left = rest.filter("component <> largest").select(*[F.col(c).alias(f"x_{c}") for c in rest.columns])
    right = rest.select(*[F.col(c).alias(f"y_{c}") for c in rest.columns])
    # a pair of rows outside the largest component would come twice: the smaller id keeps it
    pair = ((F.col("x_key") == F.col("y_key")) & (F.col("x_component") != F.col("y_component"))
            & ((F.col("y_component") == F.col("y_largest")) | (F.col("x_id") < F.col("y_id"))))
    if near is not None:
        pair &= near("x_", "y_")
    cross = (left.join(right, pair).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
             .join(star.withColumnRenamed("a", "sa").withColumnRenamed("b", "sb"), (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left_anti"))
    with scratch():
        more = stored(verify(cross), "cross-links", outlives=1)
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
