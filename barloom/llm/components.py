"""Connected components: unions inside tasks, then alternating large-star and small-star rounds.

Each task first unites the links that it holds, a bounded number at a time, which leaves
stars.  Rounds of grouped minima and joins over the edges then bring the stars of different
tasks together, so a component of any size is spread over the cluster.  Once no more than
``RUN`` links are left, one task can unite them.  The driver only sees two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle


def _apart(least: DataFrame) -> DataFrame:
    """The minima dealt out by another hash, so that Spark shuffles both sides of the join and may split a large star."""
    return least.repartition(F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(_apart(least), "u")
    down = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Links that are united in a task at once.
RUN = 1 << 18


def _forest(batches: Iterator) -> Iterator:
    """Links (u, v) to those of each node of a run of links with the smallest that the run connects it with."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def stars():
        pairs = [(x, find(x)) for x in list(root)]
        root.clear()
        columns = list(zip(*[p for p in pairs if p[0] != p[1]], strict=True)) or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["u", "v"])

    held = 0
    for batch in batches:
        if held and held + batch.num_rows > RUN:
            yield stars()
            held = 0
        held += batch.num_rows
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if held:
        yield stars()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that is not the smallest of its component.

    ``edges`` has two columns of longs; self-links and nulls are ignored, and
    repeated or reversed links are harmless.  ``root`` is the component's smallest node.
    An empty input gives an empty result.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    links = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # what is connected within a task becomes a star there, so few rounds are left
    now = settle(links.mapInArrow(_forest, "u long, v long").distinct())
    mark = None
    for _ in range(rounds):
        # decimal keeps the sum of hashes from overflowing
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen[0] <= RUN:
            now = settle(now.repartition(1).mapInArrow(_forest, "u long, v long"))
        if seen[0] <= RUN or seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        now = settle(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
