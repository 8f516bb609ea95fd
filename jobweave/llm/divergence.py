"""How far the sources of a language differ in their terms, by iceberg refinement of term prefixes.

A term is a longest run of letters a-z and characters beyond ASCII, after A-Z are made
lower case; null text, language and source count as ''. Each row is a document. A language
keeps the terms that at least ``least`` of its documents contain. They are found from
above: byte prefixes of terms are extended level by level (``level_sizes``), the distinct
documents of each prefix are counted, and whatever continues a prefix of too few documents
is dropped before the next, finer level is shuffled; after the last level the complete
kept terms remain. No term of a rare prefix ever takes part in a later shuffle.

One pass over the texts is enough for all levels. Among the sorted terms of a document, a
term is the first with its prefix of L bytes exactly if it differs from the term before it
within these L bytes. So each task counts, by (language, term), the documents in which the
term begins to differ at each level; sums of these counts over all terms of a prefix are its
distinct documents. Texts are read in bounded slices, and a task hands on its counts when
they reach ``HELD``, so nothing grows with the table or with one key.

All values are whole numbers. A source's share of a term is
``1 + floor(10^9 (count + 2) / (N + 2 V))``, also for terms that it lacks; the distance of two
shares is ``floor((p - q)^2 / (p + q))``. The sum over all kept terms for two sources is that
of their shares for a missing term, corrected by each source's own terms (a histogram of its
counts is enough) and by the terms both have. The latter are compared in blocks of terms and
of sources, one numpy pass per pair of blocks.

Defined results: an empty text has no terms, but its group exists; a language without kept
terms has the value 0 for all pairs; a single source has no pairs; repeated rows are
documents of their own; equal values are ranked by the bytes of the item; very long texts and
terms are read whole; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import slices, small_batches, text_bytes, whole_groups
from jobweave.llm.tally import Tally
from jobweave.llm.words import IS_LETTER, LOWER, find_words, mix
from jobweave.operators.ordering import rank_rows, top_rows
from jobweave.session import stage

#: Documents that must hold a kept term; places of the term report.
LEAST, PLACES = 10, 10
#: Counts that a task holds before it hands them on.
HELD = 1 << 21
#: Kept terms and sources that meet in one block.
TERMS, SOURCES = 1024, 512
SCALE = 1_000_000_000
#: For a language and term: documents in which the term differs from the one before it within each level's bytes; occurrences by source.
TERM_ROWS = "lang string, term binary, docs array<bigint>, sources array<string>, counts array<bigint>"
_SHOWN = 24
#: Bytes of text per numpy pass: terms that a slice repeats are handled once.
_SLICE = 1 << 20


def level_sizes(longest: int) -> list[int]:
    """Prefix sizes in bytes: 6, then doubling, until one is longer than the longest term."""
    sizes = [6]
    while sizes[-1] <= longest:
        sizes.append(sizes[-1] * 2)
    return sizes


def same_bytes(a: bytes, b: bytes) -> int:
    """Size of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def sorted_terms(low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different terms at these places: their byte order, the bytes that each shares with the one before in it, and a 64-bit mark of each.

    Terms hold no zero byte, so their first bytes, filled up with zeros, compare like the terms as three numbers;
    only longer terms that begin alike are compared as bytes.
    """
    at = start[:, None] + np.arange(_SHOWN)
    head = np.where(at < stop[:, None], low[np.minimum(at, len(low) - 1)], 0).astype(np.uint8)
    parts = head.view(">u8").astype(np.uint64)
    order = np.lexsort(parts.T[::-1])
    alike = (parts[order][1:] == parts[order][:-1]).all(1)
    for a, b in zip(np.flatnonzero(alike & ~np.append(False, alike[:-1])), np.flatnonzero(alike & ~np.append(alike[1:], False)) + 2):
        order[a:b] = sorted(order[a:b], key=lambda k: low[start[k] : stop[k]].tobytes())
    differs = head[order][1:] != head[order][:-1]
    shared = np.where(differs.any(1), differs.argmax(1), _SHOWN)
    for k in np.flatnonzero(alike):
        shared[k] = same_bytes(*(low[start[x] : stop[x]].tobytes() for x in order[k : k + 2]))
    mark = (stop - start).astype(np.uint64)
    for part in parts.T:
        mark = mix(mark + part)
    return order, shared, mark


class Words:
    """The words that a task holds, numbered as they come: found by a 64-bit key, told apart by a second one, their bytes end to end."""

    def __init__(self):
        self.keys, self.marks, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.langs, self.sizes, self.data = [], [], []

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of words with different keys, and the places of the new ones, to be added next; None if a key belongs to another word here."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        known = np.append(self.keys, np.uint64(0))[at] == keys[order]
        known &= at < len(self)
        old = at[known]
        if (self.marks[old] != marks[order[known]]).any():
            return None
        number = np.empty(len(keys), np.int64)
        number[order[known]] = self.numbers[old]
        fresh, at = order[~known], at[~known]
        new = np.sort(fresh)  # in the order given, terms beside their neighbours
        number[new] = len(self) + np.arange(len(new))
        self.keys, self.marks, self.numbers = (
            np.insert(mine, at, x[fresh]) for mine, x in ((self.keys, keys), (self.marks, marks), (self.numbers, number))
        )
        return number, new

    def add(self, langs: np.ndarray, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        size = stop - start
        self.langs.append(langs)
        self.sizes.append(size)
        self.data.append(low[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())])

    def columns(self, names: list[str]) -> tuple[pa.Array, pa.Array]:
        """Language and bytes of every word, in order of their numbers."""
        none = [np.zeros(0, np.int64)]
        ends = np.append(0, np.cumsum(np.concatenate(self.sizes or none)))
        data = np.concatenate(self.data or [np.zeros(0, np.uint8)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        return pa.array(names, pa.string()).take(pa.array(np.concatenate(self.langs or none))), words


def lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values)


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, a row for each language and term, as ``TERM_ROWS`` says."""
    words, tongues, sources = Words(), {}, {}
    fresh, found = Tally(), Tally()

    def rows() -> Iterator[pa.RecordBatch]:
        # every word is in both: it begins to differ somewhere, and it occurs
        (level_keys, docs), (source_keys, n) = fresh.merge(), found.merge()
        (langs, terms), labels = words.columns(list(tongues)), pa.array(list(sources), pa.string())
        depth = int((level_keys & 255).max(initial=0)) + 1
        for a in range(0, len(words), 1 << 14):
            b = min(a + (1 << 14), len(words))
            i, j = np.searchsorted(level_keys, [a << 8, b << 8])
            by_level = np.zeros((b - a, depth), np.int64)
            by_level[(level_keys[i:j] >> 8) - a, level_keys[i:j] & 255] = docs[i:j]
            by_level = by_level.cumsum(1)
            i, j = np.searchsorted(source_keys, [a << 32, b << 32])
            each = np.bincount((source_keys[i:j] >> 32) - a, minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.slice(a, b - a),
                    terms.slice(a, b - a).cast(pa.binary()),
                    lists(np.full(b - a, depth), pa.array(by_level.ravel())),
                    lists(each, labels.take(pa.array(source_keys[i:j] & 0xFFFFFFFF))),
                    lists(each, pa.array(n[i:j])),
                ],
                names=["lang", "term", "docs", "sources", "counts"],
            )

    for batch in batches:
        texts = batch.column(0)
        langs, origins = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in slices(texts, _SLICE):
            data, ends = text_bytes(texts.slice(a, b - a))
            name, owner, start, stop = find_words(data, ends, IS_LETTER)
            if not len(name):
                continue
            low = LOWER[data]
            name, first, place = np.unique(name, return_index=True, return_inverse=True)
            start, stop, terms = start[first], stop[first], len(first)
            order, shared, mark = sorted_terms(low, start, stop)
            rank = np.empty(terms, np.int64)
            rank[order] = np.arange(terms)
            pair, n = np.unique(owner * terms + rank[place], return_counts=True)
            doc, term = pair // terms, pair % terms
            level = np.zeros(len(pair), np.int64)
            same = doc[1:] == doc[:-1]
            for size in level_sizes(int(shared.max(initial=0))):
                code = np.concatenate([[0], np.cumsum(shared < size)])
                level[1:] += same & (code[term[1:]] == code[term[:-1]])
            own, lang = np.unique(np.array(langs[a:b], object).astype(str), return_inverse=True)
            found_words, place = np.unique(lang[doc] * terms + term, return_inverse=True)
            # a word of a language is looked up once a slice, and its bytes are kept when it first comes
            at = order[found_words % terms]
            tongue = np.array([tongues.setdefault(str(x), len(tongues)) for x in own], np.int64)[found_words // terms]
            keys = mix(name[at] + mix(tongue.astype(np.uint64) + np.uint64(1)))
            marks = mark[at] + tongue.astype(np.uint64)
            known = words.find(keys, marks)
            if known is None:
                yield from rows()
                words, sources, fresh, found = Words(), {}, Tally(), Tally()
                known = words.find(keys, marks)
            number, new = known
            words.add(tongue[new], low, start[at[new]], stop[at[new]])
            number = number[place]
            origin = np.array([sources.setdefault(x, len(sources)) for x in origins[a:b]], np.int64)
            fresh.add(number << 8 | level, np.ones(len(pair), np.int64))
            found.add(number << 32 | origin[doc], n)
            if fresh.merged + found.merged > 2 * HELD or len(words) > HELD // 4:
                yield from rows()
                words, sources, fresh, found = Words(), {}, Tally(), Tally()
    yield from rows()


def kept_terms(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents, out of ``TERM_ROWS``.

    Level by level, what continues a prefix of too few documents is dropped. A term shorter than the prefixes
    of a level is complete there: its prefix is the whole term, and no other term has it.
    """
    longest = words.agg(F.max(F.octet_length("term"))).first()[0] or 0
    live, complete = words.select("lang", "term", "docs"), []
    for number, size in enumerate(level_sizes(longest), 1):
        keyed = live.withColumn("prefix", F.substring("term", 1, size))
        here = F.element_at("docs", F.least(F.lit(number), F.size("docs")))
        frequent = keyed.groupBy("lang", "prefix").agg(F.sum(here).alias("here")).where(F.col("here") >= least)
        kept = stage(frequent.select("lang", "prefix"), "iceberg-prefixes")
        complete.append(kept.where(F.octet_length("prefix") < size).withColumnRenamed("prefix", "term"))
        if size <= longest:
            longer = keyed.where(F.octet_length("term") >= size)
            live = stage(longer.join(kept, ["lang", "prefix"], "left_semi").drop("prefix"), "iceberg")
    return reduce(DataFrame.unionAll, complete)


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 terms))``, exact; null where the denominator is 0."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.nullif(total + 2 * terms, F.lit(0))
    return F.lit(1) + F.call_function("div", F.lit(SCALE) * wide(count + 2), wide(below))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): over the terms that sources a < b of a block share, what their distance differs from one-sided terms."""
    for table, cut in whole_groups(batches, ["lang", "block", "i", "j"]):
        lang, one, two = table.column("lang"), table.column("i").to_numpy(), table.column("j").to_numpy()
        term, at, p, none = (table.column(c).to_numpy() for c in ("name", "at", "p", "none"))
        for a, b in zip(cut[:-1], cut[1:]):
            row = np.unique(term[a:b], return_inverse=True)[1]
            own, first, column = np.unique(at[a:b], return_index=True, return_inverse=True)
            empty = none[a:b][first]
            shares = np.zeros((row.max() + 1, len(own)), np.int64)
            shares[row, column] = p[a:b]
            left = np.flatnonzero((own - 1) // width == one[a])
            right = np.flatnonzero((own - 1) // width == two[a])
            for k in left:
                others = right[right > k]
                has = shares[:, k] > 0
                q, mine = shares[np.ix_(has, others)], shares[has, k][:, None]
                back = empty[others][None, :]
                gain = _distance(mine, np.maximum(q, 1)) - _distance(mine, back) - _distance(empty[k], np.maximum(q, 1)) + _distance(empty[k], back)
                value = np.where(q > 0, gain, 0).sum(0)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang[int(a)].as_py()] * len(others), pa.string()), "a": np.full(len(others), own[k]), "b": own[others], "value": value}
                )


def source_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language.

    ``counts`` are (lang, source, term, n, p) of kept terms; ``groups`` are (lang, source, at, terms, none): place,
    number of kept terms of the language and share of a missing term.
    """
    a, b = groups.alias("a"), groups.alias("b")
    sides = a.join(b, "lang").where(F.col("a.at") != F.col("b.at"))
    missing = sides.select("lang", F.col("a.at").alias("a"), F.col("b.at").alias("b"), F.when(F.col("a.terms") > 0, F.col("a.terms") * distance(F.col("a.none"), F.col("b.none"))).otherwise(F.lit(0)).alias("value"))

    bars = counts.groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("m"))
    own = bars.join(groups, ["lang", "source"]).alias("a").join(b, "lang").where(F.col("a.at") != F.col("b.at"))
    gain = F.col("m") * (distance(F.col("p"), F.col("b.none")) - distance(F.col("a.none"), F.col("b.none")))
    one_sided = own.groupBy("lang", F.col("a.at").alias("a"), F.col("b.at").alias("b")).agg(F.sum(gain).alias("value"))

    blocks = F.ceil(F.max("at").cast("double") / SOURCES).cast("long")
    widths = groups.groupBy("lang").agg(blocks.alias("blocks"))
    numbered = counts.join(groups, ["lang", "source"]).join(widths, "lang").withColumn("k", F.floor((F.col("at") - 1) / SOURCES))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = numbered.select("lang", F.xxhash64("term").alias("name"), "at", "p", "none", "terms", "k", other.alias("other")).select(
        "lang", F.pmod("name", F.ceil(F.col("terms") / TERMS).cast("long")).alias("block"), F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "name", "at", "p", "none"
    )
    keys = ["lang", "block", "i", "j"]
    width = SOURCES
    both = dealt.repartition(*keys).sortWithinPartitions(*keys)
    both = both.mapInArrow(lambda batches: shared_terms(batches, width), "lang string, a bigint, b bigint, value bigint")
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    parts = missing.unionByName(one_sided).unionByName(turned(one_sided)).unionByName(both).unionByName(turned(both))
    name = lambda at, to: groups.select("lang", F.col("at").alias(at), F.col("source").alias(to))
    return (
        parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        .join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
        .select("lang", "source", "item", "value")
    )


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, places: int = PLACES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and the terms that each overuses most."""
    small_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(blank(text).alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))
    words = stage(plain.mapInArrow(term_rows, TERM_ROWS), "terms")
    kept = stage(kept_terms(words, least), "kept-terms")
    found = words.select("lang", "term", "sources", "counts").join(kept, ["lang", "term"], "left_semi")
    found = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    found = stage(found.groupBy("lang", F.col("c.sources").alias("source"), "term").agg(F.sum("c.counts").alias("n")), "term-counts")

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = rank_rows(groups.na.fill(0, ["total", "terms"]), ["lang"], ["source"], "at")
    groups = stage(groups.withColumn("none", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    shares = found.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    counts = stage(shares.select("lang", "source", "term", "n", "p"), "shares")

    pairs = source_distances(counts, groups)
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    usual = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang")
    usual = usual.select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    over = counts.join(usual, ["lang", "term"]).where(F.col("p") > F.col("q"))
    terms = over.select("lang", "source", F.col("term").cast("string").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    ranked = rank_rows(pairs.withColumn("fall", -F.col("value")), ["lang", "source"], ["fall", "item"]).drop("fall")
    parts = [("pair", ranked), ("term", top_rows(terms, ["lang", "source"], order, places))]
    one, two = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in parts)
    return one.unionByName(two)
