import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from jobweave.llm import divergence, maxent, whitening

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# --- whitening ---------------------------------------------------------------------


def whole(v):
    return np.floor(1024 * np.asarray(v, float)).astype(np.int64) + 100000


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 5)
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(12, 12)) * np.linspace(3, 0.5, 12)
    good = [(k if k % 9 else None, (rng.normal(size=12) @ mixing).astype(np.float32).tolist()) for k in range(150)]
    good += [good[3], good[3]]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]
    rows = [(*r, "n", 1) for r in good + bad]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, at string, deviation int").repartition(7)
    got = whitening.whiten(df).toPandas()
    x = np.stack([whole(v) for _, v in good])
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    z = centred @ axes[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and (got.n == n).all() and set(got.component) == set(range(1, 9))
    want = Counter((r[0], int(d)) for r, d in zip(good, ((n * x - sums) ** 2).sum(1)))
    one = got[got.component == 1]
    assert Counter((None if math.isnan(i) else int(i), int(d)) for i, d in zip(one.vec_id, one.deviation)) == want
    for k in range(8):
        mine = np.sort(np.abs(got[got.component == k + 1].whitened))
        assert np.allclose(mine, np.sort(np.abs(z[:, k])), atol=1e-9)
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 901")).collect() == []


def test_vectors_without_variance(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "vec_id string, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    line = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(5)], "vec_id int, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: True} and got[0].identity_error < 1e-12
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], "vec_id int, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(huge).collect()] == [None] * 4


# --- language model ----------------------------------------------------------------


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


@pytest.mark.parametrize("head", [5, 1 << 19])
def test_base_scores_equal_plain_counts(spark, docs, pairs, head):
    got = maxent.score_texts(docs, head=head, rounds=1).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in pairs if not out(i) for w in plain_tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in pairs:
        w = plain_tokens(t)
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want.append((i, out(i), len(w), sum(x in counts for x in w), total, round(base, 4)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == sorted(want, key=repr)


def test_scores_do_not_depend_on_where_counts_are_looked_up(spark, docs):
    a, b = (sorted((r.score for r in maxent.score_texts(docs.repartition(p), head=h).collect())) for p, h in ((2, 3), (5, 1 << 19)))
    assert np.allclose(a, b, rtol=1e-4)


def test_class_probabilities_add_up_and_training_helps():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    chain = [0]
    for _ in range(6000):  # each word has two likely followers
        chain.append((chain[-1] * 7 + 3 + (rng.random() < 0.3)) % 50)
    token = words[np.array(chain)]
    of = np.arange(len(token)) // 500
    leaf, context = maxent.leaf_of(token), maxent.features(token, of)
    model = maxent.Model(np.bincount(leaf, minlength=maxent.LEAVES))
    before = model.log_probability(leaf, context).mean()
    for _ in range(4):
        expected, taken = np.zeros((2, maxent.BRANCH, 1 << maxent.BITS))
        model.gradient(leaf, context, expected, taken)
        assert taken.sum() == len(token) * 3 * maxent.DEPTH and expected.sum() == pytest.approx(taken.sum(), rel=1e-4)
        model.update(expected, taken)
    after = model.log_probability(leaf, context).mean()
    assert after > before + 0.5
    every = np.arange(maxent.LEAVES)
    one = [np.repeat(f[100:101], maxent.LEAVES) for f in context]
    assert np.exp(model.log_probability(every, one)).sum() == pytest.approx(1, abs=1e-3)
    first, mass = context[0][1], np.exp(model.log_probability(leaf, context))
    assert maxent.features(token[:1], of[:1])[0][0] != first and (mass > 0).all()


def test_texts_of_nothing(spark, no_docs):
    assert maxent.score_texts(no_docs).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (None, " \t")], "doc_id bigint, text string")
    got = maxent.score_texts(df).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(1, 1, 3 - sum(r.held_out for r in got))] * 3


# --- source divergence -------------------------------------------------------------


def plain_audit(rows, least):
    """Rows of the audit out of [(text, lang, source)]."""
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {f[0] for f in found}:
        docs = Counter(t for own, _, w in found if own == lang for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: Counter(t for own, of, w in found if own == lang and of == s for t in w if docs[t] >= least) for s in {f[1] for f in found if f[0] == lang}}

        def share(count, t):
            return 1 + 10**9 * (count[t] + 2) // (sum(count.values()) + 2 * len(kept))

        far = lambda p, q: (p - q) ** 2 // (p + q)
        usual = sum(counts.values(), Counter())
        for source, own in counts.items():
            pairs = [(s, sum(far(share(own, t), share(c, t)) for t in kept)) for s, c in counts.items() if s != source]
            terms = [(t, far(share(own, t), share(usual, t))) for t in kept if own[t] and share(own, t) > share(usual, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= 10]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_counts(spark, monkeypatch, small):
    if small:  # many hand-overs, blocks and levels
        monkeypatch.setattr(divergence, "SOURCES", 2)
        monkeypatch.setattr(divergence, "TERMS", 3)
    rng = np.random.default_rng(7)
    stems = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "Ünï", "日本", "日本語", "x" * 40, "x" * 41, "x" * 40 + "y", "no1no", "THE", "the"]
    rows = []
    for k in range(260):
        n = int(rng.integers(0, 25))
        text = " ".join(rng.choice(stems + [f"w{'abcdefghij'[k % 10]}", f"rare{'abcdefgh'[k % 8]}{'klmn'[k % 4]}"], n))
        rows.append((text, ["en", "de", "fr", None][k % 4], [f"s{k % 5}", "", None][k % 3]))
    rows += [(None, "en", "only nulls"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("word", "lone", "s"), ("z" * 3000, "en", "s1")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, at int").repartition(6)
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == plain_audit(rows, 10)
    assert divergence.audit(df.limit(0)).collect() == []


def test_a_prefix_counts_each_document_once():
    import pyarrow as pa

    batch = pa.record_batch({"text": ["abcdef abcdeg abcdefghi ABCDEF", "abcdex", "abcdef"], "lang": ["l"] * 3, "source": ["s", "s", "t"]})
    rows = [r for b in divergence.term_rows(iter([batch])) for r in b.to_pylist()]
    by = {r["term"]: r for r in rows}
    assert {t: r["docs"][-1] for t, r in by.items()} == {b"abcdef": 2, b"abcdeg": 1, b"abcdefghi": 1, b"abcdex": 1}
    assert by[b"abcdef"]["docs"][0] == 2 and by[b"abcdefghi"]["docs"][0] == 0  # its first six bytes are another term's
    assert dict(zip(by[b"abcdef"]["sources"], by[b"abcdef"]["counts"])) == {"s": 2, "t": 1}


def test_terms_are_sorted_and_marked_as_numbers():
    """Byte order, shared beginnings and marks of terms, also of long ones that begin alike."""
    terms = [b"b", b"ab", b"a", b"x" * 24, b"x" * 25, b"x" * 40 + b"y", b"x" * 40, "日本".encode(), "é".encode(), b"abcdefgh", b"abcdefghi"]
    low, stop = np.frombuffer(b"".join(terms), np.uint8), np.cumsum([len(t) for t in terms])
    order, shared, mark = divergence.sorted_terms(low, stop - [len(t) for t in terms], stop)
    assert [terms[k] for k in order] == sorted(terms)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert shared.tolist() == [common(a, b) for a, b in zip(sorted(terms), sorted(terms)[1:])]
    assert len(set(mark.tolist())) == len(terms)


def test_a_task_keeps_the_bytes_of_a_word_once():
    words, low = divergence.Words(), np.frombuffer(b"onetwothree", np.uint8)
    keys, marks = np.array([9, 0, 5], np.uint64), np.array([1, 2, 3], np.uint64)
    number, new = words.find(keys, marks)
    words.add(np.zeros(3, np.int64)[new], low, np.array([0, 3, 6])[new], np.array([3, 6, 11])[new])
    again, none = words.find(keys[::-1], marks[::-1])
    assert again.tolist() == number.tolist()[::-1] and not len(none) and len(words) == 3
    langs, terms = words.columns(["l"])
    assert [terms.to_pylist()[k] for k in number] == [b"one", b"two", b"three"] and langs.to_pylist() == ["l"] * 3
    assert words.find(keys[:1], marks[1:2]) is None  # the key of another word


def test_words_of_one_key_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "mix", lambda x: x * np.uint64(0))  # every word has the same key
    monkeypatch.setattr(divergence, "_SLICE", 1)
    real = divergence.sorted_terms
    monkeypatch.setattr(divergence, "sorted_terms", lambda low, start, stop: (*real(low, start, stop)[:2], low[start].astype(np.uint64)))
    batch = pa.record_batch({"text": ["one", "two", "one", "one"], "lang": ["l"] * 4, "source": ["s"] * 4})
    rows = [r for b in divergence.term_rows(iter([batch])) for r in b.to_pylist()]
    assert [(r["term"], r["counts"]) for r in rows] == [(b"one", [1]), (b"two", [1]), (b"one", [2])]
