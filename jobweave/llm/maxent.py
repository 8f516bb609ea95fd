"""Log probability of whole texts under a hashed maximum-entropy model.

A token is a longest run of characters other than ASCII white space, after A-Z are made
lower case; every text has one more token, its end. Words have a class by the bits of their
hash, one of ``BRANCH`` at each of ``DEPTH`` levels, so a class is a path and its softmax is factored into
``DEPTH`` small ones. Each factor is a maximum-entropy model of the history: the features
are the token before, the two before, and the one before last (a skip), each joined with
the path so far and hashed to one of ``2 ** BITS`` rows of ``BRANCH`` weights. The constant
feature is set to the share of the training tokens. Inside its class a word has its share
of the class's training tokens. All unknown words together have the probability
``1 / (N + V + 1)``, so the probabilities of the V known words and "unknown" add up to one.

Training is by gradient updates. The training texts are dealt into ``ROUNDS`` parts by a
hash of their content; in each round every task sums the expected and the actual branches of its texts of
this part (their difference is the gradient), tasks' sums are added by blocks of rows, and the weights take one damped Newton
step per feature. The weights (a few MB, fixed by the parameters) are what passes through
the driver; sums over texts do not depend on how the texts are partitioned, but for rounding.

The vocabulary is a table, counted over all training texts. Only its most frequent words,
at most ``HEAD``, are sent to the tasks; words beyond it are joined with the table, so rare
words, however many, are exact. Being rare, none is a hot key of that join.

Defined results: a null text is empty, and an empty text has the token "end" only; without
training texts every word is unknown and has the probability 1; null ids are never held
out; repeated rows are texts of their own; words are told apart by 64-bit hashes; long texts
are scored whole, in chunks of ``CHUNK`` tokens; further columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import binary_rows, slices, small_batches, text_bytes
from jobweave.llm.quality import held_out
from jobweave.llm.tally import Tally
from jobweave.llm.words import IS_SOLID, find_words, mix
from jobweave.session import stage

BRANCH, DEPTH, BITS, ROUNDS = 16, 3, 16, 3
#: Words whose counts every task holds; words that a task counts before it hands them on; tokens per numpy pass.
HEAD, HELD, CHUNK = 1 << 19, 1 << 20, 1 << 17
#: Strength of the prior on weights, share of a Newton step, largest step and weight.
PRIOR, STEP, LARGEST_STEP, LARGEST = 6.0, 0.4, 2.0, 8.0
#: Rows of weights that are added up together.
BLOCK = 1024
END, BEGIN = np.uint64(0x7E57_E2D0_0000_0001), np.uint64(0x7E57_BE61_0000_0002)
LEAVES = BRANCH**DEPTH
_NONE = -30.0
_SLICE = 1 << 19


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token, ends included."""
    data, ends = text_bytes(column)
    name, owner, _, _ = find_words(data, ends, IS_SOLID)
    n = len(ends) - 1
    token = np.full(len(name) + n, END, np.uint64)
    of = np.empty(len(token), np.int64)
    token[np.arange(len(name)) + owner] = name
    size = np.bincount(owner, minlength=n) + 1
    of[:] = np.repeat(np.arange(n), size)
    return token, of


def leaf_of(token: np.ndarray) -> np.ndarray:
    """Class of a word: ``DEPTH`` digits to the base ``BRANCH``."""
    return (mix(token ^ np.uint64(0xC1A55)) % np.uint64(LEAVES)).astype(np.int64)


def features(token: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """Hashes of the token before, the two before, and the one before last of every token."""

    def back(k: int) -> np.ndarray:
        out = np.full(len(token), BEGIN, np.uint64)
        if len(token) > k:
            out[k:] = np.where(of[k:] == of[:-k], token[:-k], BEGIN)
        return out

    one, two = back(1), back(2)
    return [mix(one + np.uint64(1)), mix(mix(one + np.uint64(2)) + two), mix(two + np.uint64(3))]


class Model:
    """Weights of all factors; ``bias`` is the constant feature of every inner node of the path."""

    def __init__(self, leaves: np.ndarray):
        """``leaves``: training tokens of every class."""
        self.leaves = leaves.astype(float)
        self.weights = np.zeros((1 << BITS, BRANCH), np.float32)
        parts = []
        for depth in range(DEPTH):
            mass = self.leaves.reshape(BRANCH ** (depth + 1), -1).sum(1).reshape(-1, BRANCH)
            share = mass / np.maximum(mass.sum(1, keepdims=True), 1)
            parts.append(np.where(share > 0, np.log(np.maximum(share, 1e-300)), _NONE))
        self.bias = np.concatenate(parts).astype(np.float32)

    def factors(self, leaf: np.ndarray, context: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of each level: unnormalised probabilities of all branches, the branch taken, rows of the features."""
        first = 0
        for depth in range(DEPTH):
            width = BRANCH ** (DEPTH - depth)
            node = first + leaf // width
            first += BRANCH**depth
            salt = mix(node.astype(np.uint64) + np.uint64(0xFAC701))
            rows = [(mix(f ^ salt) >> np.uint64(64 - BITS)).astype(np.intp) for f in context]
            score = np.take(self.bias, node, axis=0)
            for r in rows:
                score += np.take(self.weights, r, axis=0)
            yield np.exp(score, out=score), leaf // (width // BRANCH) % BRANCH, rows

    def log_probability(self, leaf: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the probability of every token's class, given its history."""
        out = np.zeros(len(leaf))
        for a in range(0, len(leaf), CHUNK):
            b = min(a + CHUNK, len(leaf))
            at = np.arange(b - a)
            for mass, branch, _ in self.factors(leaf[a:b], [f[a:b] for f in context]):
                out[a:b] += np.log(mass[at, branch] / mass.sum(1))
        return out

    def gradient(self, leaf: np.ndarray, context: list[np.ndarray], expected: np.ndarray, taken: np.ndarray) -> None:
        """Add for every branch and row: its probabilities over the uses of the row, and how often it was taken."""
        size = 1 << BITS
        for a in range(0, len(leaf), CHUNK):
            b = min(a + CHUNK, len(leaf))
            for mass, branch, rows in self.factors(leaf[a:b], [f[a:b] for f in context]):
                p = np.ascontiguousarray((mass / mass.sum(1, keepdims=True)).T, float)
                for r in rows:
                    np.add.at(taken.reshape(-1), branch * size + r, np.ones(len(r), taken.dtype))
                    for k in range(BRANCH):
                        expected[k] += np.bincount(r, p[k], size)

    def update(self, expected: np.ndarray, taken: np.ndarray) -> None:
        """One damped Newton step per weight, towards a prior around zero; the curvature is that of a row's mean probabilities."""
        used = np.maximum(taken.sum(0), 1)
        curvature = expected * (1 - expected / used) + PRIOR
        step = np.clip(STEP * (taken - expected - PRIOR * self.weights.T) / curvature, -LARGEST_STEP, LARGEST_STEP)
        self.weights = np.ascontiguousarray(np.clip(self.weights + step.T, -LARGEST, LARGEST), np.float32)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, leaf, n): tokens of all texts by 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Tally()

        def rows() -> Iterator[pa.RecordBatch]:
            keys, n = counts.merge()
            for a in range(0, len(keys), 1 << 16):
                word = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"word": word, "leaf": leaf_of(word.view(np.uint64)).astype(np.int32), "n": n[a : a + (1 << 16)]})

        for batch in batches:
            for a, b in slices(batch.column(0), _SLICE):
                word, n = np.unique(tokens(batch.column(0).slice(a, b - a))[0].view(np.int64), return_counts=True)
                counts.add(word, n)
                if counts.merged > HELD:
                    yield from rows()
                    counts = Tally()
        yield from rows()

    return texts.mapInArrow(run, "word bigint, leaf int, n bigint").groupBy("word", "leaf").agg(F.sum("n").alias("n"))


def summed_gradient(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected and actual branches of every row over all texts. Tasks' sums are added in Spark, by blocks of rows."""
    size = 1 << BITS
    # a row travels as its number, its uses, and the shares of its branches, which need no more than 16 bits
    packed = np.dtype([("row", "<u4"), ("used", "<f4"), ("shares", "<f2", (2, BRANCH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected, taken = np.zeros((BRANCH, size), np.float32), np.zeros((BRANCH, size), np.float32)
        for batch in batches:
            for a, b in slices(batch.column(0), _SLICE):
                token, of = tokens(batch.column(0).slice(a, b - a))
                model.gradient(leaf_of(token), features(token, of), expected, taken)
        for first in range(0, size, BLOCK):
            part = np.stack([expected[:, first : first + BLOCK].T, taken[:, first : first + BLOCK].T], 1)
            uses = part[:, 1].sum(1)
            used = np.flatnonzero(uses)
            if len(used):
                out = np.empty(len(used), packed)
                out["row"], out["used"], out["shares"] = used, uses[used], part[used] / uses[used, None, None]
                yield pa.RecordBatch.from_pydict({"block": [first // BLOCK], "data": [out.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), binary_rows(batch.column(1), packed)):
                sums = blocks.setdefault(block, np.zeros((BLOCK, 2, BRANCH)))
                sums[data["row"]] += data["shares"].astype(float) * data["used"][:, None, None]
        for block, sums in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "data": [sums.astype(np.float32).tobytes()]})

    kind = "block bigint, data binary"
    added = texts.mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).collect()  # at most one row per block
    out = np.zeros((2, BRANCH, size))
    for row in added:
        part = np.frombuffer(row["data"], np.float32).reshape(-1, 2, BRANCH)
        out[:, :, row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part.transpose(1, 2, 0)
    return out[0], out[1]


def train(texts: DataFrame, vocabulary: DataFrame, rounds: int = ROUNDS) -> Model:
    leaves = np.zeros(LEAVES)
    for row in vocabulary.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        leaves[row["leaf"]] = row["n"]
    model = Model(leaves)
    for k in range(rounds):
        model.update(*summed_gradient(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), model))
    return model


def frequent_words(vocabulary: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words: whole classes of equal size, at most ``most`` words."""
    size = F.floor(F.log2("n") * 16)
    bars = vocabulary.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()  # 16 classes per power of two
    total, least = 0, None
    for row in bars:
        total += row["count"]
        if total > most:
            break
        least = row["size"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = vocabulary.where(size >= least).select("word", "n").toPandas().sort_values("word")
    return found["word"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def score_rows(texts: DataFrame, model: Model, words: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> DataFrame:
    """(n_tokens, n_known, base, score, rest) beside the columns of ``texts``: sums over the frequent words, and the other words apart."""
    unknown = 1 / (total + distinct + 1)
    schema = "n_tokens bigint, n_known bigint, base double, score double, rest array<struct<word: bigint, n: bigint, score: double>>"
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema if f.name != "text"}
    at = texts.columns.index("text")
    inside = np.log10(np.maximum(model.leaves, 1)) - np.log10(max(1 - unknown, 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), _SLICE):
                part = batch.slice(a, b - a)
                token, of = tokens(part.column(at))
                leaf = leaf_of(token)
                score = model.log_probability(leaf, features(token, of)) / np.log(10) - inside[leaf]
                word = token.view(np.int64)
                place = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
                known = words[place] == word if len(words) else np.zeros(len(word), bool)
                n = np.where(known, counts[place] if len(words) else 0, 0)
                add = lambda which, x: np.bincount(of[which], x[which], b - a)  # noqa: E731, B023
                # the others, once per text and word
                others = np.flatnonzero(~known)
                order = others[np.lexsort((word[others], of[others]))]
                first = np.ones(len(order), bool)
                first[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
                cut = np.flatnonzero(first)
                own = order[cut]
                sums = np.add.reduceat(score[order], cut) if len(cut) else np.zeros(0)
                items = pa.StructArray.from_arrays(
                    [pa.array(word[own]), pa.array(np.diff(np.append(cut, len(order)))), pa.array(sums)], names=["word", "n", "score"]
                )
                ends = np.searchsorted(of[own], np.arange(b - a + 1)).astype(np.int32)
                columns = [part.column(c) for c in range(part.num_columns) if c != at]
                columns += [
                    pa.array(np.bincount(of, minlength=b - a)),
                    pa.array(np.bincount(of[known], minlength=b - a)),
                    pa.array(add(known, np.log10(n + 1.0))),
                    pa.array(add(known, score + np.log10(np.maximum(n, 1)))),
                    pa.ListArray.from_arrays(pa.array(ends), items),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kinds, "n_tokens", "n_known", "base", "score", "rest"])

    return texts.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", " + schema)


def score_texts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", held: Column | None = None, rounds: int = ROUNDS, head: int = HEAD
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; held-out rows (remainder 2 of 7) teach nothing."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = plain.withColumn("held_out", held_out("doc_id", 7, 2) if held is None else held)
    texts = plain.where(~F.col("held_out")).select("text")
    vocabulary = stage(count_words(texts), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = size["total"], size["distinct"]
    model = train(texts, vocabulary, rounds)
    words, counts = frequent_words(vocabulary, head)
    rows = plain.withColumn("rid", F.monotonically_increasing_id())
    scored = stage(score_rows(rows, model, words, counts, total, distinct), "scored")

    unknown = float(np.log10(total + distinct + 1))
    rest = scored.select("rid", F.explode("rest").alias("e")).select("rid", "e.word", F.col("e.n").alias("times"), "e.score")
    rest = rest.join(vocabulary.select("word", "n"), "word", "left")
    found = F.col("n").isNotNull()
    more = rest.groupBy("rid").agg(
        F.sum(F.when(found, F.col("times")).otherwise(F.lit(0))).alias("more_known"),
        F.sum(F.when(found, F.col("times") * F.log10(F.col("n") + 1.0)).otherwise(F.lit(0.0))).alias("more_base"),
        F.sum(F.when(found, F.col("score") + F.col("times") * F.log10(F.col("n").cast("double"))).otherwise(F.col("times") * -unknown)).alias("more_score"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rest").join(more, "rid", "left").select(
        F.col("doc_id").alias(id_column), "held_out", "n_tokens",
        (F.col("n_known") + none("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + none("more_base") - F.col("n_tokens") * unknown).alias("base_score"),
        (F.col("score") + none("more_score")).alias("score"),
    )
