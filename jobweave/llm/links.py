"""Similarity graphs without pair tables: buckets -> spanning edges -> components -> exact links.

Rows meet in buckets of equal keys. A bucket of any size is dealt out in pairs of
blocks of at most ``BLOCK`` rows, so no task holds a whole hot bucket. Each task
prunes its pairs by the rows' sketches and returns a spanning forest of what is
left: as many edges as rows at most, never the pairs. The components of these
edges contain every true link; in them all pairs are looked at again, now exactly,
and a task returns link counts and a spanning forest of the true links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import BLOCK, whole_groups
from jobweave.session import stage

#: A key with more than this share of the rows is heavy; there are at most as many heavy keys as its inverse.
HEAVY_SHARE = 1 / 1000
PAIRS_AT_ONCE = 1 << 19


def join_by_key(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and in ``size`` how many rows have it.

    Heavy keys (at most 1 / HEAVY_SHARE of them, so a proven bound) are joined by broadcast, where their rows
    stay where they are; only the others are shuffled.
    """
    heavy = side.where(F.col(size) > F.lit(max(total * HEAVY_SHARE, 1000.0)))
    if total < 1000 or heavy.isEmpty():
        return rows.join(side, keys, how)
    light = side.where(F.col(size) <= F.lit(max(total * HEAVY_SHARE, 1000.0)))
    names = F.broadcast(heavy.select(*keys))
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(names, keys, "left_anti").join(light, keys, how))


def deal_blocks(rows: DataFrame, keys: list[str], size: str, node: str = "node", block: int = BLOCK) -> DataFrame:
    """Each row once for every pair of blocks of its group: adds lo, hi (the pair) and side (the row's own block)."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    return (
        rows.withColumn("_n", blocks)
        .withColumn("side", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("lo", F.least("side", "_other"))
        .withColumn("hi", F.greatest("side", "_other"))
        .drop("_n", "_other")
    )


def pairs_of(borders: np.ndarray, side: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs to compare within each group, in portions of bounded size."""
    held_i, held_j, n = [], [], 0
    sizes = np.diff(borders)
    twos = borders[:-1][sizes == 2]
    if len(twos):
        ok = (lo[twos] == hi[twos]) | (side[twos] != side[twos + 1])
        yield twos[ok], twos[ok] + 1
    for a, m in zip(borders[:-1][sizes > 2], sizes[sizes > 2]):
        if lo[a] == hi[a]:
            i, j = np.triu_indices(m, 1)
            i, j = i + a, j + a
        else:
            one, two = np.flatnonzero(side[a : a + m] == lo[a]) + a, np.flatnonzero(side[a : a + m] == hi[a]) + a
            i, j = np.repeat(one, len(two)), np.tile(two, len(one))
        held_i.append(i)
        held_j.append(j)
        n += len(i)
        if n >= PAIRS_AT_ONCE:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, n = [], [], 0
    if n:
        yield np.concatenate(held_i), np.concatenate(held_j)


def settle(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable over the links (i, j), starting from ``labels``."""
    while len(i):
        before = labels.copy()
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels = labels[labels]
        if np.array_equal(before, labels):
            break
    return labels


def forest_of_buckets(
    rows: DataFrame, payload: DataFrame, prune: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray], total: int
) -> DataFrame:
    """Spanning edges (a, b) of the pairs that meet in a bucket and survive ``prune``.

    ``rows``: (bucket, key, node), ``payload``: (node, sketch). ``prune`` takes the sketches and pair positions.
    """
    counts = stage(rows.groupBy("bucket", "key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = join_by_key(rows, counts, ["bucket", "key"], "size", total)
    dealt = deal_blocks(met, ["bucket", "key"], "size").join(payload, "node")
    keys = ["bucket", "key", "lo", "hi"]
    # In order of the nodes too: every bucket then names its trees by their smallest node, and buckets agree on edges.
    sorted_rows = dealt.select(*keys, "side", "node", "sketch").repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, keys):
            side, lo, hi = (table.column(c).to_numpy() for c in ("side", "lo", "hi"))
            sketch = table.column("sketch").combine_chunks()
            labels = np.arange(table.num_rows)
            for i, j in pairs_of(borders, side, lo, hi):
                keep = prune(sketch, i, j)
                labels = settle(labels, i[keep], j[keep])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            if len(moved):
                nodes = table.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(labels[moved]))], ["a", "b"])

    return sorted_rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has an edge.

    Every round takes the smallest label around a node and that label's own label;
    each round is written to the shared folder, the loop ends when none moves.
    """
    both = stage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = stage(labels, "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = stage(lower.join(jump, "comp").select("node", "old", F.least("comp", "far").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def first_of_node(table: pa.Table, borders: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The groups with one row for each node: repeated input rows do not link with themselves."""
    group = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    codes = table.column("node").combine_chunks().dictionary_encode().indices.to_numpy()
    _, first = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_index=True)
    if len(first) == len(group):
        return table, borders
    first.sort()
    return table.take(pa.array(first)), np.concatenate([[0], np.cumsum(np.bincount(group[first], minlength=len(borders) - 1))])


def exact_links(
    bodies: DataFrame, verify: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], Iterator], total: int
) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, cls) of the true links inside candidate components.

    ``bodies``: (comp, size, lo, hi, side, node, copies, body), one row per node and pair of blocks. ``verify``
    takes the bodies and pair positions and gives which are links. ``links`` counts the partners with their copies.
    """
    keys = ["comp", "lo", "hi"]
    schema = "node binary, root binary, links bigint, whole boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in whole_groups(batches, keys, 1024):
            table, borders = first_of_node(table, borders)
            side, lo, hi, copies, size = (table.column(c).to_numpy() for c in ("side", "lo", "hi", "copies", "size"))
            nodes, body = table.column("node").combine_chunks(), table.column("body").combine_chunks()
            labels, links = np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
            group = np.repeat(borders[:-1], np.diff(borders))
            for i, j in pairs_of(borders, side, lo, hi):
                keep = verify(body, i, j, group)
                i, j = i[keep], j[keep]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                labels = settle(labels, i, j)
            yield pa.RecordBatch.from_arrays(
                [nodes, nodes.take(pa.array(labels)), pa.array(links), pa.array(size <= BLOCK)], ["node", "root", "links", "whole"]
            )

    rows = bodies.select(*keys, "size", "side", "node", "copies", "body").repartition(*keys).sortWithinPartitions(*keys)
    found = stage(rows.mapInArrow(run, schema), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = found.where("whole").select("node", F.col("root").alias("cls"))
    rest = found.where("not whole and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not rest.isEmpty():
        classes = classes.unionByName(components(rest).select("node", F.col("comp").alias("cls")))
    return counts, classes
