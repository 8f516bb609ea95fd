"""Text quality by a sparse rule ensemble over text statistics.

Statistics of every whole text are computed in one pass. Boosted trees of depth three
are grown on a sample of labelled rows; every path from the root to a node becomes a
conjunctive rule; a lasso logistic regression weighs the rules and drops most; the
remaining rules are compiled into one Spark column expression that scores all rows.

Learning takes at most ``fit_rows`` labelled rows (chosen by hashes of id and text, so
the same rows at every size of the cluster; equal texts of one id are one row). Labels, language, source and id are no inputs.

Defined results: a null or empty text has zero statistics and gets a score from them
like any other; rows with null ids are scored; labels that are null, or of ids without
a document, are not used; without both labels in the sample the score is the share of
label 1 (0.5 without any). An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.arrow import add_columns, text_bytes
from jobweave.llm.trees import boost, lasso_logistic, paths, rule_matrix
from jobweave.llm.words import find_words

FIT_ROWS = 20_000
#: Different texts of one id that are learned from; ranks up to here are cut before the shuffle.
TEXTS_OF_ID = 1000
PENALTY = 1e-3
STATS = [
    "chars", "words", "mean_word", "upper", "digits", "marks", "symbols", "beyond_ascii", "blanks",
    "distinct_words", "repeated_next", "commonest_word", "distinct_lines", "lines", "word_spread",
]
# Classes of bytes: 0 other lower-case, 1 upper, 2 digit, 3 sentence mark, 4 symbol, 5 lead byte beyond ASCII, 6 white space, 7 continuation
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 3
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 4
_CLASS[192:] = 5
_CLASS[:33] = 6
_CLASS[128:192] = 7


def statistics(column: pa.Array) -> list:
    """One list per name in STATS."""
    data, ends = text_bytes(column)
    n = len(ends) - 1
    size = np.diff(ends)
    by = np.bincount(np.repeat(np.arange(n), size) * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    chars = size - by[:, 7]
    some = np.maximum(chars, 1)
    words, owner, start, stop = find_words(data, ends)
    count = np.bincount(owner, minlength=n)
    most = np.maximum(count, 1)
    length = (stop - start).astype(float)
    mean = np.bincount(owner, length, n) / most
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / most - mean**2, 0))
    next_same = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / most
    distinct, common = np.zeros(n), np.zeros(n)
    cut = np.searchsorted(owner, np.arange(n + 1))
    for k in np.flatnonzero(count):
        _, times = np.unique(words[cut[k] : cut[k + 1]], return_counts=True)
        distinct[k], common[k] = len(times) / count[k], times.max() / count[k]
    # Lines as numbers: the sum of their bytes times powers would do; their words do as well.
    line_of = np.cumsum(data == 10)
    first = line_of[start] if len(start) else np.zeros(0, np.int64)
    lines = by_line(words, owner, first, n)
    upper = np.array(by[:, 1], float)
    # Letters beyond ASCII that are upper case: U+00C0 to U+00DE follow the lead byte C3 as 80 to 9E.
    if len(data) > 1:
        big = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
        upper += np.bincount(np.searchsorted(ends, big, "right") - 1, minlength=n)[:n]
    stats = [
        np.log1p(chars), np.log1p(count), mean, upper / some, by[:, 2] / some, by[:, 3] / some, by[:, 4] / some, by[:, 5] / some,
        by[:, 6] / some, distinct, next_same, common, lines[1], np.log1p(lines[0]), spread,
    ]
    return [np.asarray(s, float).tolist() for s in stats]


def by_line(words: np.ndarray, owner: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with words of each text, and the share of them that differ."""
    if not len(words):
        return np.zeros(n), np.zeros(n)
    head = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]))
    at = np.arange(len(words)) - np.repeat(head, np.diff(np.append(head, len(words))))
    name = np.add.reduceat(words * (2 * at.astype(np.uint64) + np.uint64(1)), head)
    of = owner[head]
    total = np.bincount(of, minlength=n)
    order = np.lexsort((name, of))
    new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (of[order][1:] != of[order][:-1])])
    return total.astype(float), np.bincount(of[order][new], minlength=n) / np.maximum(total, 1)


def held_out(id_column: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, id_column: str = "doc_id") -> DataFrame:
    """(id, label, text) of at most ``rows`` labelled rows for learning, chosen by hashes; equal texts of one id are one row.

    Ids may repeat: first texts of ids come before second ones, and so on, so that no id crowds out others. At most ``rows``
    ids, and at most ``rows`` pairs of id and text hash, are broadcast; the texts stay in place until they are chosen.
    """
    chosen = (
        labels.where(train & F.col(label).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    labelled = docs.join(F.broadcast(chosen), F.col(id_column) == F.col("id")).select("id", "label", "text", F.xxhash64("text").alias("name"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("name"))
    pairs = (
        labelled.select("id", "name").distinct().withColumn("turn", turn).where(F.col("turn") <= TEXTS_OF_ID)
        .orderBy("turn", F.xxhash64("id"), "id").limit(rows)
        .select(F.col("id").alias("own_id"), F.col("name").alias("own_name"))
    )
    bounded = labelled.join(F.broadcast(pairs), (F.col("id") == F.col("own_id")) & (F.col("name") == F.col("own_name")))
    return bounded.groupBy("id", "label", "name").agg(F.min("text").alias("text")).drop("name")


class Rules:
    """Weighted conjunctions over STATS."""

    def __init__(self, base: float, rules: list[tuple], weights: np.ndarray):
        self.base, self.rules, self.weights = base, rules, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Rules:
        if not len(y) or y.min() == y.max():
            share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
            return cls(float(np.log(share / (1 - share))), [], np.zeros(0))
        found = dict.fromkeys(p for t in boost(x, y, trees=30, depth=3, rate=0.3, least=10, part=0.5).trees for p in paths(t))
        rules = list(found)
        base, weights = lasso_logistic(rule_matrix(rules, x), y, penalty)
        kept = np.flatnonzero(np.abs(weights) > 1e-6)
        return cls(base, [rules[k] for k in kept], weights[kept])

    def column(self) -> Column:
        """The score as a Spark expression: each rule is a conjunction of comparisons."""
        z = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights):
            tests = [F.col(STATS[f]) <= b if side == "<=" else F.col(STATS[f]) > b for f, side, b in rule]
            z = z + F.when(reduce(lambda a, b: a & b, tests), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def __str__(self) -> str:
        text = lambda r: " and ".join(f"{STATS[f]} {s} {b:.4g}" for f, s, b in r)
        return "\n".join(f"{w:+.3f} if {text(r)}" for r, w in sorted(zip(self.rules, self.weights), key=lambda p: -abs(p[1])))


def learn(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", fit_rows: int = FIT_ROWS) -> Rules:
    sample = labelled_sample(docs, labels, label, train, fit_rows)
    got = add_columns(sample, "text", [(s, "double") for s in STATS], statistics).drop("text").toPandas()
    got = got.sort_values(["id", *STATS], ignore_index=True)
    return Rules.fit(got[STATS].to_numpy(float), got["label"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every row; held-out rows (remainder 0 of 5) teach nothing."""
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    rules = learn(plain, labels, ~held_out("doc_id", 5, 0), fit_rows=fit_rows)
    stats = add_columns(plain, "text", [(s, "double") for s in STATS], statistics)
    return stats.select(
        F.col("doc_id").alias(id_column),
        held_out("doc_id", 5, 0).alias("held_out"),
        rules.column().alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
