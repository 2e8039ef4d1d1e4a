"""Connected components of an edge table, by alternating stars; nothing is gathered at the driver but counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import written
from siltbed.sources.folders import remove_folder


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge (node, smallest node) for each node that isn't smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


#: Hubs number this at most, so their table may be broadcast at any size of the input.
_MOST_HUBS = 10_000


def with_group(rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """rows, which are read twice, with aggregates over the rows of the same key (no nulls); no task gets all rows of a large group.

    Groups are counted by partial sums. Those of over `rows / _MOST_HUBS` rows (100 at least) number _MOST_HUBS at most; their rows meet
    the aggregates by broadcast where they lie, and all other groups are small enough for a join by key.
    """
    groups = rows.groupBy(key).agg(F.count("*").alias("_size"), *aggregates)
    groups = written(groups, "groups")
    total = groups.agg(F.sum("_size")).first()[0] or 0
    large = F.col("_size") > max(100, total // _MOST_HUBS)
    hubs = F.broadcast(groups.where(large).drop("_size"))
    rest = groups.where(~large).drop("_size")
    return rows.join(hubs, key).unionByName(rows.join(rest, key))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root: smallest node of its component) for each node of edges (a, b) that is not smallest itself.

    Each round links every node's larger neighbours to its smallest one (large star), then every node's smaller
    neighbours likewise (small star); the rounds grow with the logarithm of the component size. A hub's edges never meet in
    one task: its smallest neighbour comes from partial aggregates and goes to its edges by with_group. Self-links and
    repeated or null ends are dropped. No edges give no rows. Raises if it has not settled after most_rounds.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        # Both directions of each edge: u's neighbours v. Rows with v < u are there for the least neighbour only.
        both = current.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        starred = with_group(both, "u", F.min("v").alias("m")).where("v > u")
        large = written(starred.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct(), "edges")
        smaller = with_group(large, "a", F.min("b").alias("m"))
        small = smaller.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = written(small, "edges")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for done in (current, large):
            remove_folder(current.sparkSession, done.siltbed_path)
        current = after
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
