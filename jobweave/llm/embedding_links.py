"""Near-duplicate vectors within a label by randomised-rotation binary codes and exact recomputation.

A unit vector is turned by several random rotations (fixed seeds); the signs of the
turned coordinates are its code, and for every rotation the inner product of vector
and code is stored as correction factor. Buckets of 12 code bits bring candidates
together, Hamming distances bound their angle, and what is left spans components
(``links.py``). Inside a component each pair gets an unbiased estimate of its inner
product: code of the one against the other vector quantised to four bits with
random rounding, counted in bit planes and divided by the correction factor, averaged
over the rotations. Only pairs whose upper confidence bound reaches the threshold
are recomputed, in double precision, and only that decides.

A pair at cosine 0.93 shares one of the 26 buckets with probability 0.998; more
similar pairs do so more often.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label, link with nothing (own component, 0
links). Vectors of different lengths do not link. Equal vectors of a label are one
node with copies. Ids may repeat or be null. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import text_bytes
from jobweave.llm.links import components, deal_blocks, exact_links, forest_of_buckets, join_by_key
from jobweave.llm.words import mix
from jobweave.session import stage

THRESHOLD = 0.93
CODE_BITS = 320
BUCKET_BITS, BUCKETS = 12, 26
#: Standard deviations of the confidence bounds.
SURE = 4.5
LEVELS = 15


@lru_cache(maxsize=8)
def rotations(dim: int) -> np.ndarray:
    """Random orthogonal matrices, enough for CODE_BITS sign bits."""
    out = []
    for k in range(-(-CODE_BITS // dim)):
        q, r = np.linalg.qr(np.random.default_rng([dim, k]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def codes_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (rows, rotations, 64-bit words) and correction factors (rows, rotations) of unit vectors."""
    dim = units.shape[1]
    turned = np.einsum("nd,red->nre", units, rotations(dim))
    bits = turned > 0
    factors = np.abs(turned).sum(2) / sqrt(dim)
    pad = -dim % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, pad))), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8"), factors


def bucket_keys(codes: np.ndarray, dim: int, group: np.ndarray) -> np.ndarray:
    """One 64-bit key per table from BUCKET_BITS bits of the code, the group and the dimension."""
    rows = len(codes)
    bits = np.unpackbits(codes.reshape(rows, -1).view(np.uint8), axis=1, bitorder="little")
    bits = bits.reshape(rows, codes.shape[1], -1)[:, :, :dim].reshape(rows, -1)[:, : BUCKETS * BUCKET_BITS]
    value = (bits.reshape(rows, BUCKETS, BUCKET_BITS) * (1 << np.arange(BUCKET_BITS))).sum(2).astype(np.uint64)
    table = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(BUCKET_BITS)
    return mix(mix(group.view(np.uint64) + np.uint64(dim))[:, None] + value + table).view(np.int64)


def estimates(units: np.ndarray, codes: np.ndarray, factors: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimate of the inner product of each pair and the half width of its confidence interval."""
    dim = units.shape[1]
    turned = np.einsum("nd,red->nre", units, rotations(dim))
    low = turned.min(2)
    step = np.maximum((turned.max(2) - low) / LEVELS, 1e-12)
    noise = np.random.default_rng(dim).random(turned.shape[1:])
    level = np.clip(np.floor((turned - low[:, :, None]) / step[:, :, None] + noise), 0, LEVELS).astype(np.uint8)
    pad = -dim % 64
    planes = [
        np.ascontiguousarray(np.packbits(np.pad((level >> b) & 1, ((0, 0), (0, 0), (0, pad))), axis=2, bitorder="little")).view("<u8")
        for b in range(4)
    ]
    count = np.bitwise_count(codes).sum(2, dtype=np.int64)
    total = turned.sum(2)
    value, width = np.zeros(len(i)), np.zeros(len(i))
    for a in range(0, len(i), 1 << 16):
        one, two = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        mine = codes[one]
        dot = sum((np.bitwise_count(mine & p[two]).sum(2, dtype=np.int64) << b) for b, p in enumerate(planes))
        inner = (2 * (step[two] * dot + low[two] * count[one]) - total[two]) / sqrt(dim)
        c = factors[one]
        value[a : a + len(one)] = (inner / c).mean(1)
        spread = np.sqrt(np.maximum(1 - c * c, 0) / max(dim - 1, 1)) / c + step[two] / (2 * c)
        width[a : a + len(one)] = SURE * spread.mean(1) / sqrt(codes.shape[1])
    return value, width


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rid, grp, embedding) -> node, dim, keys, sketch (group, dimension, code, factors), unit vector; null where it cannot link."""
    names = ["id", "rid", "node", "keys", "sketch", "unit"]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows = part.num_rows
            node, keys, sketch, unit = [[None] * rows for _ in range(4)]
            groups = part.column("grp")
            known = groups.is_valid().to_numpy(zero_copy_only=False)
            vectors = part.column("embedding")
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            label = groups.fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            whole = flat.is_valid().to_numpy(zero_copy_only=False)
            value = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]):
                pick = np.flatnonzero((sizes == dim) & known)
                if not len(pick):
                    continue
                where = begin[pick][:, None] + np.arange(dim)
                x = value[where]
                good = whole[where].all(1) & np.isfinite(x).all(1) & (x != 0).any(1)
                pick, x = pick[good], x[good]
                if not len(pick):
                    continue
                raw = x + 0.0  # -0.0 becomes 0.0: equal vectors have equal bytes
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                codes, factors = codes_of(x)
                own = label[pick].astype(np.int64)
                bands = bucket_keys(codes, int(dim), own)
                for k, p in enumerate(pick):
                    head = own[k : k + 1].tobytes()
                    node[p] = hashlib.blake2b(head + raw[k].tobytes(), digest_size=16).digest()
                    keys[p] = bands[k]
                    sketch[p] = head + int(dim).to_bytes(8, "little") + codes[k].tobytes() + factors[k].astype("<f8").tobytes()
                    unit[p] = x[k].tobytes()
            new = [pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(unit, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("rid"), *new], names)


def of_one_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, bytes) of the values of each length."""
    raw, ends = text_bytes(column)
    size = np.diff(ends)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, raw[ends[at][:, None] + np.arange(n)]


def of_one_dimension(sketch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, 64-bit words) of the sketches of each dimension; several dimensions can share a length."""
    for at, raw in of_one_size(sketch):
        words = np.ascontiguousarray(raw).view("<u8")
        for dim in np.unique(words[:, 1]):
            own = words[:, 1] == dim
            yield at[own], words[own]


def neighbours(vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: (id, n_links: other vectors at or above the threshold, component_id: smallest id reachable)."""
    plain = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(id_column).cast("long"), F.xxhash64(embedding)).alias("rid"),
        F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("grp"),
        F.col(embedding).alias("embedding"),
    )
    schema = "id bigint, rid bigint, node binary, keys array<bigint>, sketch binary, unit binary"
    rows = stage(plain.mapInArrow(describe, schema), "vectors")
    total = rows.count()
    nodes = (
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("sketch").alias("sketch"), F.first("unit").alias("unit"), F.first("keys").alias("keys"))
    )
    nodes = stage(nodes, "vector-nodes")
    part = acos(threshold) / pi

    def prune(sketch: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(i), bool)
        place, kind = np.zeros(len(sketch), np.int64), np.full(len(sketch), -1)
        for k, (at, words) in enumerate(of_one_dimension(sketch)):
            place[at], kind[at] = np.arange(len(at)), k
            mine = np.flatnonzero((kind[i] == k) & (kind[j] == k))
            dim = int(words[0, 1])
            bits = dim * len(rotations(dim))
            code = words[:, 2 : 2 + len(rotations(dim)) * -(-dim // 64)]
            a, b = place[i[mine]], place[j[mine]]
            apart = np.bitwise_count(code[a] ^ code[b]).sum(1, dtype=np.int64)
            keep[mine] = (words[a, 0] == words[b, 0]) & (apart <= bits * part + SURE * sqrt(bits * part * (1 - part)))
        return np.flatnonzero(keep)

    buckets = nodes.select("node", F.posexplode("keys").alias("bucket", "key"))
    edges = forest_of_buckets(buckets, nodes.select("node", "sketch"), prune, total)
    comps = stage(components(edges), "components")
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    members = comps.join(sizes, "comp").join(nodes.select("node", "copies", F.struct("sketch", "unit").alias("body")), "node")
    dealt = deal_blocks(members, ["comp"], "size")

    def verify(body: pa.Array, i: np.ndarray, j: np.ndarray, group: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(i), bool)
        place, kind = np.zeros(len(body), np.int64), np.full(len(body), -1)
        heads = np.array([int.from_bytes(x[:8], "little", signed=True) for x in body.field("sketch").to_pylist()])
        for k, (at, raw) in enumerate(of_one_size(body.field("unit"))):
            place[at], kind[at] = np.arange(len(at)), k
            mine = np.flatnonzero((kind[i] == k) & (kind[j] == k) & (heads[i] == heads[j]))
            units = np.ascontiguousarray(raw).view("<f8")
            dim = units.shape[1]
            spins = len(rotations(dim))
            stored = [x for x in body.field("sketch").take(pa.array(at)).to_pylist()]
            stored = np.frombuffer(b"".join(stored), "<u8").reshape(len(at), -1)
            codes = stored[:, 2 : 2 + spins * -(-dim // 64)].reshape(len(at), spins, -1)
            factors = np.ascontiguousarray(stored[:, 2 + codes.shape[1] * codes.shape[2] :]).view("<f8")
            a, b = place[i[mine]], place[j[mine]]
            value, width = estimates(units, codes, factors, a, b)
            open_ = np.flatnonzero(value + width >= threshold)
            for c in range(0, len(open_), 1 << 15):
                part_ = open_[c : c + (1 << 15)]
                cosine = np.einsum("nd,nd->n", units[a[part_]], units[b[part_]])
                keep[mine[part_]] = cosine >= threshold
        return np.flatnonzero(keep)

    counts, found = exact_links(dealt, verify, total)
    linked = (
        nodes.select("node", "copies", "first_id")
        .join(found, "node", "left")
        .join(counts, "node", "left")
        .withColumn("cls", F.coalesce("cls", "node"))
        .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    linked = stage(linked, "linked")
    firsts = linked.groupBy("cls").agg(F.min("first_id").alias("component_id"))
    classes = stage(linked.join(firsts, "cls").select("node", "copies", "component_id", "links"), "classes")
    light = rows.select("id", "node")
    known = join_by_key(light.where("node is not null"), classes, ["node"], "copies", total)
    alone = light.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.select("id", F.col("links").alias("n_links"), "component_id").unionByName(alone).withColumnRenamed("id", id_column)
