"""Connected components by contraction in a random order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.tables import drop, partitions, written


#: Edges that a single task joins up, for callers that ask for it.
TOGETHER = 200_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of few edges, and one node of its component."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for b in batches:
        kind = b.schema.types[0]
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent[root(x)] = root(y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["label", "to"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", together: int = 0) -> DataFrame:
    """node and component (its smallest node) for every node of an edge.

    Every node is its own label at first. Each round puts the labels in another random order; a label gives way to its
    first neighbour, or to that one's first neighbour, if that comes before itself. Edges become edges between labels, and
    go once both ends are equal. The image of a connected graph is connected, so a component ends as one label; a constant
    share of the labels that still have edges goes in each round, whatever the ids' order, so chains take a logarithmic
    number of rounds. A round keeps where its own labels went, so what is kept gets less by the same share; nodes are named
    once, after the last. A node with very many neighbours costs a partial minimum on the map side. Only whether edges are left
    reaches the driver. together: once no more edges than this are left, one task joins them up.
    """
    left = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a != b")
    left = written(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        if together and left.count() <= together:
            # count() reads the files' ends only
            kind = left.schema["a"].dataType.simpleString()
            rounds.append(written(left.select("a", "b").coalesce(1).mapInArrow(_joined_up, f"label {kind}, to {kind}")))
            break
        turn = len(rounds) + 1
        ranked = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("x"))
        later, sooner = F.greatest(ranked("a"), ranked("b")), F.least(ranked("a"), ranked("b"))
        first = left.select(later.getField("x").alias("a"), sooner.alias("b")).groupBy("a").agg(F.min("b").getField("x").alias("b"))
        further = first.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moved = written(first.join(further, "b", "left").select(F.col("a").alias("label"), F.coalesce("c", "b").alias("to")))
        rest = _renamed(_renamed(left, "a", moved), "b", moved).filter("a != b")
        rest = written(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        drop(left)
        left = rest
        rounds.append(moved)
    drop(left)
    if not rounds:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    # where labels end, from the last round back to the first: a round's own labels move and then go where that leads; what does not move in it goes where it goes later
    end = rounds.pop()
    while rounds:
        moved = rounds.pop()
        on = moved.withColumnRenamed("to", "by").join(end.withColumnRenamed("label", "by"), "by", "left").select("label", F.coalesce("to", "by").alias("to"))
        before = written(on.unionByName(end.join(moved.select("label"), "label", "left_anti")))
        drop(moved)
        drop(end)
        end = before
    # a node that ends as itself has no row, or one of its own
    names = end.groupBy("to").agg(F.min("label").alias("first")).select("to", F.least("to", "first").alias("component"))
    return end.filter("label != to").join(names, "to").select(F.col("label").alias("node"), "component").unionByName(names.select(F.col("to").alias("node"), "component"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with their number from 1 in the order of a key that does not repeat. Rows are dealt by ranges of the key; what a single task sees is one row a range."""
    n = partitions(rows.sparkSession)
    dealt = written(rows.repartitionByRange(n, key).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("__part").count().withColumn("__before", before)
    at = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return dealt.join(F.broadcast(parts), "__part").withColumn("number", at + F.col("__before")).drop("__part", "count", "__before")  # a row a partition


def updated(member: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """connected_components(edges) from what they were (node, component) before edges were added and removed. edges: all there are now.

    Components that lose no edge stay whole, so they are single nodes of a small graph whose edges are the added ones.
    Only the nodes of components that lose an edge are searched anew, over their own edges.
    """
    ends = lambda df: df.select(F.explode(F.array(src, dst)).alias("node"))
    touched = written(ends(removed).join(member, "node").select("component").distinct())
    again = member.join(touched, "component", "left_semi").select("node")
    inside = edges.join(again.select(F.col("node").alias(src)), src, "left_semi").join(again.select(F.col("node").alias(dst)), dst, "left_semi")
    whole = member.join(touched, "component", "left_anti")
    # what edges are left in the touched components; a node that lost them all may be none any more
    kept = written(whole.select("node", "component").unionByName(connected_components(inside, src, dst, TOGETHER).select("node", "component")))
    name = lambda side: kept.select(F.col("node").alias(side), F.col("component").alias(f"__{side}"))
    links = added.join(name(src), src, "left").join(name(dst), dst, "left")
    links = links.select(F.coalesce(f"__{src}", src).alias("src"), F.coalesce(f"__{dst}", dst).alias("dst"))
    joined = connected_components(links, together=TOGETHER).select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = kept.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = ends(added.filter(F.col(src) != F.col(dst))).distinct().join(kept.select("node"), "node", "left_anti")
    return written(old.unionByName(new.join(joined.select(F.col("component").alias("node"), F.col("to").alias("component")), "node")))


def _renamed(df: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    out = df.join(moved.select(F.col("label").alias(column), "to"), column, "left")
    new: Column = F.coalesce("to", column).alias(column)
    return out.select(*(new if c == column else c for c in df.columns))
