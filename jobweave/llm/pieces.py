"""SentencePiece BPE encoding and decoding with flat numpy symbol arrays, exactly as the library does.

A text gets one leading space, spaces become U+2581, and it is cut before every
U+2581 that follows another character: no piece of the vocabulary crosses such a
cut (checked on loading), so merges inside the cuts are independent. The distinct
words of a slice of texts are encoded together: symbols of all words lie in one
flat array; each round looks up the rank of every neighbouring pair, takes the least
rank per word, merges its occurrences from left to right and compacts the array,
until no pair is left. Where a merge can make a pair of a better rank, only the
leftmost occurrence is merged in that round, so the order of merges is the library's.
Characters without a piece become byte pieces. Decoding gathers the bytes of the
pieces and drops the leading space.

Defined results: null and empty texts encode to the begin and end ids alone and
decode to the empty text. Texts of any length are encoded whole. Repeated rows and
extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.arrow import add_columns, free_name, text_bytes
from jobweave.llm.words import mix, powers

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a BPE model as arrays: pair -> (rank, merged piece), character -> piece, piece -> bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        normal = [
            i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        if len(byte) != 256:
            raise ValueError("a model with byte pieces is needed")
        if any(SPACE in texts[i].lstrip(SPACE) for i in normal):
            raise ValueError("pieces that cross a word border are not supported")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte = np.zeros(256, np.int32)
        for i in byte:
            self.byte[int(texts[i][3:5], 16)] = i
        known = {texts[i]: i for i in normal}
        scores = sorted({-model.get_score(i) for i in normal})
        place = {s: k for k, s in enumerate(scores)}
        rank = {i: place[-model.get_score(i)] for i in normal}
        # Symbols: pieces, and from n on characters that have no piece.
        self.base = n
        self.char = np.full(0x110000, -1, np.int32)
        pairs, ranks, made = [], [], []
        better = np.full(n, len(scores), np.int64)  # best rank of a pair that a piece can take part in
        for i in normal:
            t = texts[i]
            if len(t) == 1:
                self.char[ord(t)] = i
                continue
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                # Single characters are symbols whether they have a piece or not, but a pair needs both halves to have one.
                if a is not None and b is not None:
                    pairs.append(a * n + b)
                    ranks.append(rank[i])
                    made.append(i)
                    better[a] = min(better[a], rank[i])
                    better[b] = min(better[b], rank[i])
        missing = sorted({c for i in normal for c in texts[i] if len(texts[i]) > 1} - set(known))
        if missing:
            raise ValueError("every character of a piece must be a piece")
        order = np.argsort(pairs)
        self.pairs, self.rank, self.made = np.array(pairs)[order], np.array(ranks)[order], np.array(made, np.int32)[order]
        #: Whether all occurrences of the merge may be done at once: nothing it makes has a better rank.
        self.safe = better[self.made] > self.rank
        self.none = len(scores)
        self.limit = n
        bits = 1 << 21
        self.slots = bits - 1
        self.filter = np.zeros(bits, bool)
        self.filter[self._slot(self.pairs)] = True
        out = [b""] * n
        for i in normal:
            out[i] = texts[i].replace(SPACE, " ").encode()
        for v in range(256):
            out[self.byte[v]] = bytes([v])
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & self.slots

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair among the known ones, or -1."""
        pair = a.astype(np.int64) * self.limit + b
        out = np.full(len(pair), -1, np.int32)
        maybe = np.flatnonzero(self.filter[self._slot(pair)] & (a < self.limit) & (b < self.limit))
        at = np.searchsorted(self.pairs, pair[maybe])
        at = np.minimum(at, len(self.pairs) - 1)
        out[maybe] = np.where(self.pairs[at] == pair[maybe], at, -1)
        return out

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of many words (``word`` is the word of each symbol, ascending)."""
        done_s, done_w = [], []
        pair = np.full(len(symbols), -1, np.int32)
        if len(symbols) > 1:
            same = word[1:] == word[:-1]
            at = np.flatnonzero(same)
            pair[at] = self.look_up(symbols[at], symbols[at + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = np.where(pair >= 0, self.rank[pair], self.none)
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(least < self.none, size)
            if not live.all():
                done_s.append(symbols[~live])
                done_w.append(word[~live])
                symbols, word, pair, rank = symbols[live], word[live], pair[live], rank[live]
                if not len(symbols):
                    break
                keep = least < self.none
                size, least = size[keep], least[keep]
                first = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            # Of hits in a row every second one, from the left; where it is not safe only the leftmost of the word.
            at = np.flatnonzero(hit)
            head = np.concatenate([[True], (np.diff(at) > 1)])
            start = np.maximum.accumulate(np.where(head, at, 0))
            at = at[(at - start) % 2 == 0]
            owner = np.searchsorted(first, at, "right") - 1
            leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
            unsafe = np.zeros(len(first), bool)
            np.logical_or.at(unsafe, owner, ~self.safe[pair[at]])
            at = at[leftmost | ~unsafe[owner]]
            symbols[at] = self.made[pair[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            keep = ~gone
            new = np.cumsum(keep) - 1
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            # Only pairs beside a merge change.
            moved = new[at]
            beside = np.zeros(len(symbols), bool)
            beside[moved] = beside[np.maximum(moved - 1, 0)] = True
            look = np.flatnonzero(beside[:-1])
            inside = word[look] == word[look + 1]
            pair[moved] = -1
            pair[look[~inside]] = -1
            look = look[inside]
            pair[look] = self.look_up(symbols[look], symbols[look + 1])
        if not done_s:
            return symbols, word
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, with begin and end ids, and the n + 1 borders of the texts."""
        raw, ends = text_bytes(column)
        texts = len(ends) - 1
        filled = np.flatnonzero(np.diff(ends) > 0)
        # One space before every text that is not empty.
        data = np.full(len(raw) + len(filled), 32, np.uint8)
        shift = np.zeros(texts + 1, np.int64)
        shift[1:] = np.cumsum(np.diff(ends) > 0)
        is_text = np.ones(len(data), bool)
        is_text[ends[filled] + shift[filled]] = False
        data[is_text] = raw
        ends = ends + shift
        # U+2581 itself counts as a space: both are cut before and written as the same piece.
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, int)
        blank = data == 32
        blank[marks] = True
        before = np.concatenate([[False], blank[:-1]])
        before[marks + 1] = False
        if len(marks):
            follows = marks + 3
            before[follows[follows < len(data)]] = True
        cut = blank & ~before
        cut[ends[:-1][filled]] = True
        start = np.flatnonzero(cut)
        owner = np.searchsorted(ends, start, "right") - 1
        stop = np.append(start[1:], len(data))
        if not len(start):
            ids = np.tile(np.array([self.begin, self.end], np.int32), texts)
            return ids, np.arange(texts + 1) * 2
        up, down = powers(len(data))
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * up, start) * down[start]
        names = mix(sums + (stop - start).astype(np.uint64))
        _, example, of = np.unique(names, return_index=True, return_inverse=True)
        ids, at = self._encode_words(data, start[example], stop[example])
        size = np.diff(at)[of]
        total = np.bincount(owner, weights=size, minlength=texts).astype(np.int64) + 2
        border = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(int(border[-1]), np.int32)
        out[border[:-1]], out[border[1:] - 1] = self.begin, self.end
        body = np.ones(len(out), bool)
        body[border[:-1]] = body[border[1:] - 1] = False
        source = np.repeat(at[of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[body] = ids[source]
        return out, border

    def _encode_words(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = stop - start
        place = np.cumsum(size) - size
        part = data[np.repeat(start - place, size) + np.arange(int(size.sum()))]
        # Code points from UTF-8 lead and continuation bytes.
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        b = part[lead].astype(np.int32)
        more = (b >= 0xC0).astype(int) + (b >= 0xE0) + (b >= 0xF0)
        point = np.where(more == 0, b, np.where(more == 1, b & 0x1F, np.where(more == 2, b & 0x0F, b & 0x07)))
        for k in range(1, 4):
            has = more >= k
            point[has] = (point[has] << 6) | (part[lead[has] + k] & 0x3F)
        point[point == 32] = ord(SPACE)
        word = np.searchsorted(place, lead, "right") - 1
        symbols = self.char[point]
        # A character without a piece keeps its code point beyond all pieces until it is written as bytes.
        symbols = np.where(symbols < 0, self.base + point, symbols).astype(np.int32)
        symbols, word = self.merge(symbols, word)
        odd = np.flatnonzero(symbols >= self.base)
        if len(odd):
            encoded = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[odd] - self.base).tolist()]
            n = np.ones(len(symbols), int)
            n[odd] = [len(e) for e in encoded]
            at = np.cumsum(n) - n
            symbols = np.repeat(symbols, n)
            word = np.repeat(word, n)
            where = np.repeat(at[odd], n[odd]) + np.concatenate([np.arange(len(e)) for e in encoded])
            symbols[where] = self.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        return symbols, np.searchsorted(word, np.arange(len(start) + 1))

    def decode(self, ids: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts of encoded ids, end to end, and their n + 1 borders."""
        size = (self.out_at[1:] - self.out_at[:-1])[ids]
        begin = np.concatenate([[0], np.cumsum(size)])
        data = self.out[np.repeat(self.out_at[ids] - begin[:-1], size) + np.arange(int(begin[-1]))]
        at = begin[border]
        filled = at[1:] > at[:-1]
        keep = np.ones(len(data), bool)
        keep[at[:-1][filled & (data[np.minimum(at[:-1], max(len(data) - 1, 0))] == 32 if len(data) else filled)]] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return data[keep], at - gone[at]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def reachable(path: str) -> str:
    """The model's path on this machine: as given, or the one the tokenizers package has here under the same name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def digests(path: str, with_ids: bool, with_text: bool):
    def fn(column: pa.Array) -> list:
        model = load(reachable(path))
        ids, border = model.encode(column)
        data, at = model.decode(ids, border)
        wide = ids.astype("<u4")
        out = [
            np.diff(border).tolist(),
            [hashlib.sha256(wide[a:b].tobytes()).hexdigest() for a, b in zip(border[:-1], border[1:])],
            [hashlib.sha256(data[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])],
        ]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids)))
        if with_text:
            out.append(pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))))
        return out

    return fn


def encode_texts(docs: DataFrame, text: str = "text", model: str | None = None, ids: bool = True, decoded: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text themselves."""
    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    fields = [(free_name(docs, n), t) for n, t in fields]
    return add_columns(docs, text, fields, digests(model or default_model(), ids, decoded))


def token_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    plain = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return encode_texts(plain, model=model, ids=False).drop("text").withColumnRenamed("id", id_column)
