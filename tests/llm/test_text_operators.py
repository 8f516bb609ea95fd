import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobweave.llm import decontaminate, ngram_join, pieces, pii, quality, token_counts, toxicity
from jobweave.llm.fm_index import FmIndex
from tests.llm import brute
from tests.llm.conftest import sentence


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


# --- near duplicates ---------------------------------------------------------------


def test_near_duplicates_equal_brute_force(docs, pairs):
    got = rows(ngram_join.near_duplicates(docs), "doc_id", "class_id", "n_links")
    assert got == sorted(brute.near_classes(pairs), key=repr)


def test_large_group_is_dealt_out_in_blocks(spark):
    rng = random.Random(2)
    base = sentence(rng, 60).split()
    texts = []
    for k in range(1300):
        w = list(base)
        w[rng.randrange(60)] = f"w{k % 700}"
        texts.append(" ".join(w))
    pairs = list(enumerate(texts))
    got = ngram_join.near_duplicates(spark.createDataFrame(pairs, "doc_id bigint, text string")).toPandas()
    sets = [brute.shingle_set(t) for t in texts]
    for i in range(0, 1300, 97):
        links = sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for s in sets) - 1
        assert got.n_links[got.doc_id == i].item() == links
    assert set(got.class_id) == {0}


def test_keep_one_keeps_one_row_of_each_class(docs, pairs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    want = brute.near_classes(pairs)
    alone = [i for (i, _, _), (_, t) in zip(want, pairs) if not brute.words(t)]
    classes = {c for (_, c, _), (_, t) in zip(want, pairs) if brute.words(t) and c is not None}
    assert got == Counter([*alone, *classes]) + Counter({None: sum(c is None and bool(brute.words(t)) for (_, c, _), (_, t) in zip(want, pairs))})


def test_pruning_keeps_true_pairs():
    least = ngram_join.least_matches(0.8)
    assert all(m < n * 0.8 for n, m in least) and [n for n, _ in least] == [20, 40, 60, 80, 100]
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    other = np.concatenate([items[:270], rng.integers(0, 2**63, 30, dtype=np.uint64)])
    far = rng.integers(0, 2**63, 300, dtype=np.uint64)
    values = np.stack([ngram_join.minhash(x) for x in (items, other, far)])
    assert ngram_join.survivors(values, np.array([0, 0]), np.array([1, 2]), least).tolist() == [0]


# --- decontamination ---------------------------------------------------------------


@pytest.fixture(scope="module")
def bench(spark, texts):
    rows = [(1, " ".join(texts[2].split()[5:30])), (2, "one"), (10, " ".join(texts[30].split()[-12:])), (None, texts[4]), (4, None), (5, ""), (6, "never found here at all")]
    return spark.createDataFrame([*rows, rows[0]], "item_id bigint, text string")


@pytest.mark.parametrize("portion", [1 << 20, 60])
def test_leaks_equal_brute_force(docs, bench, pairs, portion):
    items = [tuple(r) for r in bench.collect()]
    found, n = decontaminate.find_leaks(docs, bench, portion_bytes=portion)
    got = [
        (r["doc_id"], (r[n["words"]], sum(x.b - x.a for x in r[n["runs"]]), list(r[n["items"]])))
        for r in found.select("doc_id", *n.values()).collect()
    ]
    want = [(i, brute.leaks(t, items)) for i, t in pairs]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_removal_leaves_no_leak_and_no_other_change(docs, bench):
    clean = decontaminate.remove_leaks(docs, bench)
    assert clean.columns == docs.columns
    found, n = decontaminate.find_leaks(clean, bench)
    assert found.where(f"size({n['runs']}) > 0").count() == 0
    before = {r.text for r in docs.select("text").collect()}
    changed = [r.text for r in clean.select("text").collect() if r.text not in before]
    assert changed and all(t is not None for t in changed)


def test_no_items_no_hits(docs, bench):
    found, n = decontaminate.find_leaks(docs, bench.limit(0))
    assert found.where(f"size({n['runs']}) > 0").count() == 0


def test_index_counts_and_places():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 300)
    index = FmIndex(text)
    for n in (1, 2, 5):
        for _ in range(30):
            at = int(rng.integers(0, 300 - n))
            phrase = text[at : at + n]
            low, high = index.search(phrase[None, :], np.array([n]))
            want = [k for k in range(300 - n + 1) if (text[k : k + n] == phrase).all()]
            assert sorted(index.locate(np.arange(low[0], high[0]))) == want


# --- personal data -----------------------------------------------------------------


def test_base_spans_follow_the_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789+.-() @aZ_é\n4") for _ in range(rng.randint(0, 60)))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                    continue
                if kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                    continue
                want.append((kind, m.start(), m.end()))
        assert pii.base_spans(t)[0] == want


def test_trees_add_what_a_failed_match_hid(spark):
    rng = random.Random(4)
    texts = []
    for k in range(900):
        phone, ip = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"{rng.randint(1, 99)}.2.{rng.randint(0, 255)}.7"
        other = f"{rng.randint(1, 99)} of {rng.randint(10**6, 10**9)} and {rng.randint(10**15, 10**16)}"
        texts.append(sentence(rng, 8) + f" {phone} word {ip} " + sentence(rng, 4) + f" {other}. a{k}@mail.example.com")
    hidden = "call +1 (415) 555-2671 4929 1234 5678 9012 3456 now"
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, hidden, None, ""])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert "phone:5:22" in got[900].spans and got[900].n_phone == 0
    assert got[900].redacted.startswith("call [PHONE] ")
    assert got[901].spans == "" and got[901].redacted is None and got[902].base_sha256 == hashlib.sha256(b"").hexdigest()
    base = "".join(f"{k}:{a}:{b}," for k, a, b in pii.base_spans(texts[0])[0]).strip(",")
    assert got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(got[0].spans.split(","))


def test_formats_are_counted_and_drawn_by_their_counts(spark):
    texts = [f"4929 1234 5678 {k:04d} or 12 of {10**6 + k}" for k in range(400)] + ["+1 (415) 555-2671"] * 300
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    formats = pii.count_formats(df)
    rows = formats.collect()
    want = sum(len(pii.examples(t)) for t in texts)
    assert sum(r.fit + r.held for r in rows) == want and len({(r.kind, tuple(r.x)) for r in rows}) == len(rows) < 30
    # A kind with many distinct formats is not lost to another one, and the weights keep its size.
    many = spark.range(5000).selectExpr("if(id < 60, 'ip', '') kind", "array(double(id)) x", "bigint(1 + id % 3) fit", "0L held")
    totals = {r.kind: (r.n, r.fit) for r in many.groupBy("kind").agg(F.count("*").alias("n"), F.sum("fit").alias("fit")).collect()}
    drawn = pii.fit_sample(many, totals, 500).toPandas()
    assert (drawn.kind == "ip").sum() == 60 and 350 < (drawn.kind == "").sum() < 650
    assert abs(drawn[drawn.kind == ""].weight.sum() / totals[""][1] - 1) < 0.2


def test_candidates_have_any_number_of_groups(spark):
    assert (0, 17) in pii.candidates("+33 6 12 34 56 78 4111 1111 1111 1111")
    assert (0, 23) in pii.candidates("41 11 11 11 11 11 11 11") and (3, 40) in pii.candidates("no " + " ".join("1" * 19))
    assert max(b - a for a, b in pii.candidates("7 " * 50)) == 37
    text = "+33 6 12 34 56 78 4111 1111 1111 1111"
    model = pii.learn(spark.createDataFrame([], "text string"))
    assert set(model.models) == set(pii.KINDS) and pii.joined(model.spans(text)[1]) == "card:18:37,phone:0:17"
    long = "a" * 100 + " [at] example.com"
    assert (0, len(long)) in pii.candidates(long) and pii.candidates("b" * 200_000) == []


def test_a_hidden_span_is_found_in_a_table_of_any_size(spark):
    hidden = "+1 (826) 555-4081 190.137.223.204"
    for others in (0, 400):
        texts = [hidden, *[f"+1 (415) 555-{1000 + k} word {k}" for k in range(others)], "+1 (415) 555 12, 10 of 1234567 and v1.2.3.4.5"]
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
        got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
        assert got[0] == "ip:18:33,phone:0:17"
        assert got[len(texts) - 1] == pii.joined(pii.base_spans(texts[-1])[0])


def test_redaction_keeps_columns(docs):
    out = pii.redact_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


# --- pieces and token files --------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_equal_the_library(library, texts):
    rng = random.Random(7)
    signs = "ab ee▁  theinrsotn\n\té日🧿=-_.,019\x00\ufeff\u3000"
    odd = ["", " ", "  a  b ", "▁▁ ▁", "<s> </s> <0x41>", "aaaaaaaaaaaa", "\U0010ffff", None]
    own = pieces.load(pieces.default_model())
    for batch in (odd, texts, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]):
        ids, border = own.encode(pa.array(batch, pa.string()))
        data, at = own.decode(ids, border)
        for k, t in enumerate(batch):
            want = library.encode(t or "", add_bos=True, add_eos=True)
            assert ids[border[k] : border[k + 1]].tolist() == want
            assert data[at[k] : at[k + 1]].tobytes().decode() == library.decode(want)


def test_pieces_of_a_table(docs, library):
    out = pieces.encode_texts(docs, decoded=True)
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.select("text", "_n_tokens", "_ids", "decoded", "ids_sha256").collect():
        assert r._ids == library.encode(r.text or "", add_bos=True, add_eos=True) and r._n_tokens == len(r._ids)
        assert r.decoded == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(r._ids, "<u4").tobytes()).hexdigest()


def test_token_counts_of_documents(docs, pairs, library):
    got = rows(token_counts.document_tokens(docs), "doc_id", "n_tokens")
    assert got == sorted([(i, len(library.encode(t or ""))) for i, t in pairs], key=repr)


def test_separator_scan_over_any_cuts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 3)
    rng = np.random.default_rng(9)
    files, want = [], []
    for f in range(4):
        stream = np.where(rng.random(400) < 0.08, 2, rng.integers(3, 9, 400)).astype("<u2")
        cuts = np.unique(np.concatenate([[0], rng.integers(0, 400, 40), [400]]))
        files += [(f, k, stream[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))] + [(f, len(cuts), b"")]
        ends = np.flatnonzero(stream == 2)
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        want += [(f, k, int(n), True) for k, n in enumerate(lengths)]
        if 399 > ends[-1]:
            want.append((f, len(ends), int(399 - ends[-1]), False))
    blocks = spark.createDataFrame(files, "file bigint, block bigint, tokens binary").repartition(3)
    assert rows(token_counts.count_tokens(blocks), "file", "doc_no", "n_tokens", "ended") == sorted(want, key=repr)
    assert token_counts.count_tokens(blocks.limit(0)).count() == 0


# --- learned scores ----------------------------------------------------------------


def labelled(spark, bad, good, n=600):
    rng = random.Random(3)
    data = [(k, (bad if k % 3 == 0 else good)(rng), int(k % 3 == 0)) for k in range(n)]
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id bigint, text string")
    return docs, data


def test_toxicity_on_held_out_rows(spark):
    insults = ["loweit", "loweima", "idiot", "scum"]

    def toxic(rng):
        w = sentence(rng, 40).split()
        for _ in range(3):
            w.insert(rng.randrange(40), rng.choice(insults))
        return " ".join(w)

    docs, data = labelled(spark, toxic, lambda rng: sentence(rng, 40))
    labels = spark.createDataFrame([(i, x) for i, _, x in data] + [(None, 1), (10**6, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[i].predicted, x) for i, _, x in data if got[i].held_out]
    assert len(held) > 100 and sum(p == x for p, x in held) >= 0.98 * len(held)


def test_grammar_tells_clauses_apart():
    lexicon = toxicity.Lexicon()
    plain, denied, said = (lexicon.features(t) for t in ("you idiot", "you are not an idiot", "he said idiot"))
    assert plain[4] > 0 and denied[1] + denied[5] > 0 and said[2] + said[6] > 0
    assert not any(lexicon.features("a kind day. nothing else")) and not any(lexicon.features(""))


def plain_matches(lexicon, text):
    """Scores of the clauses with words, by looking around each trigger; no automaton."""
    words, scores = toxicity.WORDS, []
    of = lambda t, kind: t in words[kind].split()
    for line in text.lower().split("\n"):
        tokens, quoted, clauses = toxicity.TOKEN.findall(line), False, [[]]
        for t in tokens:
            if t in toxicity.QUOTES:
                quoted = not quoted
            elif t in toxicity.END:
                clauses.append([])
            else:
                clauses[-1].append((t, quoted))
        for clause in clauses:
            total = 0.0
            for k, (t, inside) in enumerate(clause):
                kind, weight = lexicon.look_up(t)
                before = lambda kind, n: any(of(w, kind) for w, _ in clause[max(k - n, 0) : k])  # noqa: E731, B023
                heard = max((j + 1 for j in range(k) if of(clause[j][0], toxicity.REPORT)), default=0)
                aimed = any(of(w, toxicity.TARGET) for w, _ in clause[max(k - 4, heard, 0) : k]) or any(of(w, toxicity.TARGET) for w, _ in clause[k + 1 : k + 4])
                if kind == toxicity.INSULT or kind == toxicity.THREAT and aimed:
                    total += weight * (0.01 if before(toxicity.NEGATION, 3) else 1) * (0.25 if inside or before(toxicity.REPORT, k) else 1) * (2 if aimed else 1)
            if clause:
                scores.append(total)
    return scores


def test_composed_transducers_equal_a_plain_clause_matcher():
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({"blork": 2.5}, {"zwab": 3.0})
    some = ["idiot", "scum", "blork", "zwabbel", "kill", "hurt", "you", "them", "not", "never", "said", "calls", "tree", "runs", "green", '"', "»", ".", "!", "\n"]
    for _ in range(600):
        text = " ".join(rng.choices(some, k=rng.randrange(40)))
        got = [sum(w for _, w in c) for c in lexicon.clauses(text)]
        assert np.allclose(got, plain_matches(lexicon, text)), text


def test_equal_words_in_other_clauses_get_other_verdicts(spark):
    fixed = toxicity.fixed_scorer(toxicity.Lexicon())
    rng = random.Random(5)
    data = [(k, f"{sentence(rng, 6)}. {'you are an idiot' if k % 2 else 'you are not an idiot'}. {sentence(rng, 6)}", k % 2) for k in range(200)]
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in data], "doc_id bigint, toxic int")
    learned = toxicity.learn(docs, labels, F.lit(True))
    for scorer in (fixed, learned):
        assert (scorer.weights >= 0).all()
        bad, denied, quoted = scorer.score(["you are an idiot", "you are not an idiot, never an idiot", '"you are fine. you are an idiot"'])
        assert bad >= 0.3 > denied and quoted < bad
    said, direct, frost, threat = fixed.score(["he said idiot", '"Stop." you idiot', "the frost will kill the plants", "I will kill you"])
    assert direct > said and threat > frost == fixed.score([""])[0]
    assert direct >= 0.3 > max(said, frost)


def test_quality_on_held_out_rows(spark):
    def junk(rng):
        return rng.choice([" ".join([w] * 9) for w in sentence(rng, 3).split()]) + sentence(rng, 20).upper().replace(" ", "!! ")

    docs, data = labelled(spark, junk, lambda rng: sentence(rng, 40).capitalize() + ".")
    labels = spark.createDataFrame([(i, 1 - x) for i, _, x in data], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [(got[i].predicted, 1 - x) for i, _, x in data if got[i].held_out]
    assert len(held) > 80 and sum(p == x for p, x in held) >= 0.98 * len(held)


def test_rules_as_column_equal_rules_as_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    model = quality.Rules.fit(x, y)
    df = spark.createDataFrame([[float(v) for v in r] for r in x[:50]], quality.STATS).withColumn("p", model.column())
    from jobweave.llm.trees import rule_matrix, squash

    want = squash(model.base + rule_matrix(model.rules, x) @ model.weights)[:50]
    assert np.allclose([r.p for r in df.collect()], want) and ((want > 0.5) == y[:50]).mean() > 0.95


def test_repeated_ids_do_not_pass_the_bound_of_labelled_rows(spark):
    rows = [(1, f"text {k % 300}") for k in range(900)] + [(k, f"own {k}") for k in range(2, 30)] + [(30, None), (None, "x"), (31, "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 31)], "doc_id bigint, quality int")
    got = [tuple(r) for r in quality.labelled_sample(docs, labels, "quality", F.lit(True), 100).collect()]
    assert len(got) == len(set(got)) == 100 and {r[0] for r in got} == set(range(1, 31))
    assert all(r[1] == r[0] % 2 and (r[0], r[2]) in set(rows) for r in got)


@pytest.mark.parametrize("score,label", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_of_odd_rows(spark, docs, no_docs, score, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (77777, 0)], f"doc_id bigint, {label} int")
    for given in (labels, labels.limit(0)):
        out = score(docs, given).collect()
        assert len(out) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in out)
    assert score(no_docs, labels).count() == 0


@pytest.mark.parametrize(
    "fn",
    [
        lambda d: ngram_join.near_duplicates(d),
        lambda d: ngram_join.keep_one(d),
        lambda d: pii.find_personal_data(d),
        lambda d: pieces.token_digests(d),
        lambda d: token_counts.document_tokens(d),
        lambda d: decontaminate.find_leaks(d, d.selectExpr("doc_id as item_id", "text"))[0],
    ],
)
def test_empty_tables_give_empty_tables(no_docs, fn):
    assert fn(no_docs).count() == 0
