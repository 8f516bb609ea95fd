"""Find and remove passages of test items in training documents with an FM-index per shard of documents.

A phrase to find is a window of ten consecutive words of an item; an item of one to
nine words is one phrase. A shard is a slice of a task's documents. Its words are
mapped to the vocabulary of the items; runs of other words cannot be part of an
occurrence and become one separator, and so do runs of known words shorter than the
shortest phrase. The rest is indexed; all phrases are searched backwards at once
through wavelet ranks, occurrences are located through sampled suffix positions, and
hit words are merged to spans. Documents are read once and not shuffled.

The items reach the tasks in portions of bounded size, one pass inside the same job
for each, so neither a task nor the driver holds them whole however many there are.

Defined results: null and empty texts have no words and no hits. Items with a null
id, a null text or no words are ignored; items with equal ids count once. Repeated
documents are judged each by itself. Extra columns pass through. An empty table of
documents gives an empty table, an empty table of items gives no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import add_columns, free_name, text_bytes
from jobweave.llm.fm_index import FmIndex
from jobweave.llm.words import find_words

WINDOW = 10
#: Bytes of item texts that are searched in one pass.
PORTION_BYTES = 1 << 20
#: Bytes of document text in one index.
SHARD_BYTES = 1 << 21
HIT = "array<struct<a:int,b:int,start:int,stop:int>>"


class Phrases:
    """Distinct windows of a portion of the items as rows of vocabulary numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, ends = text_bytes(pa.array([t for _, t in items], pa.string()))
        hashes, owner, _, _ = find_words(data, ends)
        self.names = [n for n, _ in items]
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        number = number + 1
        first = np.searchsorted(owner, np.arange(len(items) + 1))
        sizes = np.diff(first)
        count = np.where(sizes >= window, sizes - window + 1, (sizes > 0).astype(int))
        item = np.repeat(np.arange(len(items)), count)
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(sizes[item], window)
        rows = np.zeros((len(item), window), np.int32)
        for k in range(window):
            has = k < length
            rows[has, window - 1 - k] = number[start[has] + length[has] - 1 - k]
        self.rows, of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, int))
        order = np.argsort(of.ravel(), kind="stable")
        self.item = item[order]
        self.item_at = np.searchsorted(of.ravel()[order], np.arange(len(self.rows) + 1))
        self.length = (self.rows > 0).sum(1)
        self.shortest = int(self.length.min(initial=window))
        self.flag = np.zeros(1 << 16, bool)
        self.flag[(self.vocabulary & np.uint64(0xFFFF)).astype(int)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 for words of no item."""
        out = np.zeros(len(hashes), np.int32)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.flag[(hashes & np.uint64(0xFFFF)).astype(np.int32)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out

    def occurrences(self, numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence in a shard."""
        none = np.zeros(0, np.int64)
        if not len(numbers) or not len(self.rows):
            return none, none
        known = numbers > 0
        first = known & np.concatenate([[True], ~known[:-1] | (owner[1:] != owner[:-1])])
        begin = np.flatnonzero(first)
        final = known & np.concatenate([~known[1:] | (owner[1:] != owner[:-1]), [True]])
        stop = np.flatnonzero(final) + 1
        keep = stop - begin >= self.shortest
        begin, stop = begin[keep], stop[keep]
        if not len(begin):
            return none, none
        size = stop - begin
        place = np.cumsum(size + 1) - size - 1
        at = np.arange(int((size + 1).sum())) - np.repeat(place, size + 1)
        word = np.where(at < np.repeat(size, size + 1), np.repeat(begin, size + 1) + at, -1)
        index = FmIndex(np.where(word >= 0, numbers[word], 0))
        low, high = index.search(self.rows, self.length)
        found = np.flatnonzero(high > low)
        n = (high - low)[found]
        rows = np.repeat(low[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(found, n), word[index.locate(rows)]

    def judge(self, column: pa.Array) -> list:
        """Words, merged runs of hit words and items found, for each text of a shard."""
        data, ends = text_bytes(column)
        hashes, owner, start, stop = find_words(data, ends)
        texts = len(ends) - 1
        counts = np.bincount(owner, minlength=texts)
        phrase, word = self.occurrences(self.numbers(hashes), owner)
        runs: list[list] = [[] for _ in range(texts)]
        items: list[list] = [[] for _ in range(texts)]
        if len(phrase):
            change = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(change, word, 1)
            np.add.at(change, word + self.length[phrase], -1)
            hit = np.cumsum(change[:-1]) > 0
            edge = np.concatenate([[True], owner[1:] != owner[:-1]])
            head = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
            tail = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]])) + 1
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = np.searchsorted(owner, np.arange(texts))
            for a, b in zip(head, tail):
                d = owner[a]
                zero = point[ends[d]]
                runs[d].append(
                    {"a": int(a - base[d]), "b": int(b - base[d]), "start": int(point[start[a]] - zero), "stop": int(point[stop[b - 1]] - zero)}
                )
            n = (self.item_at[1:] - self.item_at[:-1])[phrase]
            item = self.item[np.repeat(self.item_at[phrase] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            pair = np.unique(np.repeat(owner[word], n) * len(self.names) + item)
            for d, i in zip(pair // len(self.names), pair % len(self.names)):
                items[d].append(self.names[i])
        return [counts.tolist(), runs, items]


def portions(bench: DataFrame, id_column: str, text: str, limit: int) -> list[list[tuple[str, str]]]:
    """Item rows in groups of about ``limit`` bytes of text; each is read by itself."""
    items = bench.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // limit))
    part = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return [[(r.id, r.text) for r in part.where(F.col("part") == k).select("id", "text").collect()] for k in range(n)]


def merged(runs: Column) -> Column:
    """Sorted runs with overlapping and touching ones made one."""
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, x: F.concat(
        F.slice(done, 1, F.size(done) - 1),
        F.array(
            F.struct(
                last(done)["a"].alias("a"),
                F.greatest(last(done)["b"], x["b"]).alias("b"),
                last(done)["start"].alias("start"),
                F.greatest(last(done)["stop"], x["stop"]).alias("stop"),
            )
        ),
    )
    step = lambda done, x: F.when((F.size(done) == 0) | (last(done)["b"] < x["a"]), F.concat(done, F.array(x))).otherwise(
        grown(done, x)
    )
    return F.aggregate(F.array_sort(runs), F.array().cast(HIT), step)


def find_leaks(
    docs: DataFrame,
    bench: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    portion_bytes: int = PORTION_BYTES,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the number of words, the runs of hit words (word and code point borders) and the items found.

    Returns the table and the names of these columns: words, runs, items.
    """
    groups = portions(bench, item_id, item_text, portion_bytes)
    names = {k: free_name(docs, k) for k in ("words", "runs", "items")}
    if len(groups) == 1:
        fields = [(names["words"], "bigint"), (names["runs"], HIT), (names["items"], "array<string>")]
        out = add_columns(docs, text, fields, Phrases(groups[0], window).judge, SHARD_BYTES)
    else:
        out, mine = docs, []
        for k, group in enumerate(groups):
            own = [free_name(out, f"_{x}_{k}") for x in ("words", "runs", "items")]
            mine.append(own)
            out = add_columns(out, text, list(zip(own, ("bigint", HIT, "array<string>"))), Phrases(group, window).judge, SHARD_BYTES)
        out = out.select(
            *docs.columns,
            F.col(mine[0][0]).alias(names["words"]),
            merged(F.concat(*[F.col(x[1]) for x in mine])).alias(names["runs"]),
            F.concat(*[F.col(x[2]) for x in mine]).alias(names["items"]),
        )
    return out.withColumn(names["items"], F.array_sort(F.array_distinct(names["items"]))), names


def hit_words(runs: str) -> Column:
    return F.aggregate(F.col(runs), F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])


def remove_leaks(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with hit passages cut out of the text; documents of which no other word is left are removed."""
    found, names = find_leaks(docs, bench, text, **options)
    runs = F.col(names["runs"])
    gaps = F.concat(
        F.transform(runs, lambda r, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at(runs, i)["stop"]).alias("x"), r["start"].alias("y"))),
        F.array(F.struct(F.element_at(runs, -1)["stop"].alias("x"), F.length(text).alias("y"))),
    )
    rest = F.array_join(F.transform(gaps, lambda g: F.substring(F.col(text), g["x"] + 1, g["y"] - g["x"])), "")
    clean = F.when(F.size(runs) == 0, F.col(text)).otherwise(rest)
    return (
        found.where((F.size(runs) == 0) | (hit_words(names["runs"]) < F.col(names["words"])))
        .withColumn(text, clean)
        .select(*docs.columns)
    )
