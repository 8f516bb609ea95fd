"""Near-duplicate documents by the Jaccard similarity of word shingles, with Bayesian pruning of candidates.

A document is the set of its five-word shingles (``words.py`` says what a word is;
a text of one to four words is one shingle). Documents with equal sets are one node
with a number of copies. 100 MinHash values of 16 bits per node make 25 bands of
four; a pair of similarity 0.8 shares a band with probability 1 - 2e-6. The pairs of
a bucket are compared value by value, in steps of 20: a pair is dropped as soon as
the posterior probability (uniform prior) that its similarity reaches the threshold
is below ``TOLERANCE``. What is left spans components (``links.py``); inside them
every pair goes through the same pruning and the survivors are verified exactly.

Defined results: null and empty texts and texts without words are in no group (their
class is their own id, 0 links). Repeated rows are copies of each other. Rows with a
null id take part; a class of only such rows has a null class id. Extra columns pass
through untouched; names of new columns get underscores where they clash. An empty
table gives an empty table.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import BLOCK, add_columns, binary_rows, free_name, text_bytes
from jobweave.llm.links import components, deal_blocks, exact_links, forest_of_buckets, join_by_key
from jobweave.llm.words import mix, set_key, shingle_sets
from jobweave.session import stage

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BAND = 100, 4
STEP = 20
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
_FACTORS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_SHIFTS = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32)


def minhash(items: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits for a set of 64-bit hashes."""
    x = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        low = np.minimum(low, (x[None, a : a + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1))
    return (mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(threshold: float, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair). With a uniform prior the posterior probability of
    similarity >= t after m matches in n values is P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(step, hashes + 1, step):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return out


def survivors(values: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Positions within (i, j) of the pairs that no step drops; later values are read only for pairs still open."""
    open_, matches, at = np.arange(len(i)), np.zeros(len(i), np.int32), 0
    for n, fewest in least:
        matches = matches + (values[i[open_], at:n] == values[j[open_], at:n]).sum(1, dtype=np.int32)
        keep = matches >= fewest
        open_, matches, at = open_[keep], matches[keep], n
    return open_


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sets."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    order = np.argsort(i, kind="stable")
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    sizes = np.array([len(sets[u]) for u in used])
    names, ids = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(names), bool)
    cut = np.flatnonzero(np.diff(i[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)]):
        one = place[i[order[a]]]
        mine = ids[begin[one] : begin[one + 1]]
        mark[mine] = True
        for c in range(a, b, 256):
            part = order[c : min(c + 256, b)]
            other = place[j[part]]
            n = sizes[other]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            where = np.repeat(begin[other] - starts, n) + np.arange(n.sum())
            out[part] = np.add.reduceat(mark[ids[where]].astype(np.int64), starts)
        mark[mine] = False
    return out


def describe(column: pa.Array) -> list:
    """Set name, bands and MinHash values of each text."""
    names, bands, sketches = [], [], []
    for items in shingle_sets(*text_bytes(column), SHINGLE):
        names.append(set_key(items))
        if names[-1] is None:
            bands.append(None)
            sketches.append(None)
            continue
        values = minhash(items)
        bands.append(values.view("<i8").tolist())
        sketches.append(values.tobytes())
    return [names, bands, sketches]


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, node) and (nodes: node, copies, cls, first_id, class_id, links) of a table of documents.

    ``rid`` is the id of a row, or a hash of its text where the id is null.
    """
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(id_column).cast("long"), F.xxhash64(text)).alias("rid"), F.col(text).alias("text"))
    described = add_columns(plain, "text", [("node", "binary"), ("bands", "array<bigint>"), ("sketch", "binary")], describe)
    rows = stage(described.drop("text"), "sets")
    total = rows.count()
    nodes = stage(
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.min("rid").alias("first_rid"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "nodes",
    )
    least = least_matches(threshold)

    def prune(sketch: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        raw, _ = text_bytes(sketch)
        return survivors(raw.view("<u2").reshape(len(sketch), HASHES), i, j, least)

    buckets = nodes.select("node", F.posexplode("bands").alias("bucket", "key"))
    edges = forest_of_buckets(buckets, nodes.select("node", "sketch"), prune, total)
    comps = stage(components(edges), "components")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    members = comps.join(sizes, "comp").join(nodes.select("node", "copies", "first_rid"), "node").withColumnRenamed("first_rid", "rid")

    # The sets of candidates are made again from their texts: cheaper than keeping the sets of all documents.
    texts = members.withColumnRenamed("node", "wanted").join(plain.select("rid", "text"), "rid")
    bodies = add_columns(texts, "text", [("node", "binary"), ("sketch", "binary"), ("items", "binary")], set_bodies)
    bodies = bodies.where("node = wanted").withColumn("body", F.struct("sketch", "items"))
    dealt = deal_blocks(bodies.select("comp", "size", "node", "copies", "body"), ["comp"], "size", block=BLOCK)

    def verify(body: pa.Array, i: np.ndarray, j: np.ndarray, group: np.ndarray) -> np.ndarray:
        raw, _ = text_bytes(body.field("sketch"))
        open_ = survivors(raw.view("<u2").reshape(len(body), HASHES), i, j, least)
        items = binary_rows(body.field("items"), "<u8")
        both = overlaps(items, i[open_], j[open_])
        sizes_ = np.array([len(x) for x in items], np.int64)
        return open_[both >= threshold * (sizes_[i[open_]] + sizes_[j[open_]] - both) - 1e-9]

    counts, found = exact_links(dealt, verify, total)
    linked = (
        nodes.drop("sketch", "bands", "first_rid")
        .join(found, "node", "left")
        .join(counts, "node", "left")
        .withColumn("cls", F.coalesce("cls", "node"))
        .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    linked = stage(linked, "linked")
    firsts = linked.groupBy("cls").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    return rows.select("id", "rid", "node"), stage(linked.join(firsts, "cls"), "classes")


def set_bodies(column: pa.Array) -> list:
    sets = shingle_sets(*text_bytes(column), SHINGLE)
    return [
        [set_key(s) for s in sets],
        [minhash(s).tobytes() if len(s) else None for s in sets],
        [s.astype("<u8").tobytes() for s in sets],
    ]


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: (id, class_id: smallest id of its class, n_links: other rows at or above the threshold)."""
    rows, nodes = classes(docs, id_column, text, threshold)
    total = rows.count()
    known = join_by_key(
        rows.where("node is not null"), nodes.select("node", "copies", "class_id", "links"), ["node"], "copies", total
    )
    alone = rows.where("node is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return known.select("id", "class_id", "links").unionByName(alone).select(
        F.col("id").alias(id_column), "class_id", F.col("links").alias("n_links")
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id stays."""
    _, nodes = classes(docs, id_column, text, threshold)
    node, kept_id, copies = (free_name(docs, n) for n in ("node", "kept_id", "copies"))
    # Which row of which set stays: one light row per class.
    stays = nodes.where("first_id <=> class_id").groupBy("cls").agg(F.min("node").alias("kept_node"))
    stays = stage(
        stays.join(nodes.select(F.col("node").alias("kept_node"), F.col("first_id").alias("kept_id"), "copies"), "kept_node"), "stays"
    )
    named = add_columns(docs, text, [(node, "binary")], lambda c: [[set_key(s) for s in shingle_sets(*text_bytes(c), SHINGLE)]])
    alone = named.where(F.col(node).isNull()).drop(node)
    # The kept row has its set's name and its smallest id. Only one set of a class is named, so no copies but its own meet.
    named = named.where(F.col(node).isNotNull())
    side = stays.select(F.col("kept_node").alias(node), F.col("kept_id").alias(kept_id), F.col("copies").alias(copies))
    total = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    kept = join_by_key(named, side, [node], copies, total).where(F.col(id_column).eqNullSafe(F.col(kept_id)))
    once = kept.where(F.col(copies) == 1).drop(node, kept_id, copies)
    # Rows repeated with the same id: one of them stays.
    repeated = kept.where(F.col(copies) > 1).dropDuplicates([node]).drop(node, kept_id, copies)
    return once.unionByName(repeated).unionByName(alone).select(*docs.columns)
