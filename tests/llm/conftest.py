import random

import pytest

SYLLABLES = "the re an on er in ti es or ha wh nd st en ed to is it".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Clean texts, copies, near copies, and the odd ones: null, empty, one word, signs only, a very long one."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(25)]
    near = [b.replace(b.split()[3], "changed", 1) for b in base[:6]]
    long = sentence(rng, 60_000)
    return [*base, *base[:4], *near, None, "", "one", "one", "... !!!", "naïve Ünïcode 日本語 🙂 ", long, "x" * 50_000]


EXTRA = ["node", "score", "words", "runs", "items", "redacted", "ids", "rid", "n_tokens", "keys", "_kept"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """A documents table with null and repeated ids and with columns named like the operators' own."""
    rows = [(k if k % 13 else None, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "src0", 1), (3, texts[3], "en", "src0", 1), (None, None, None, None, None)]
    rows = [(*r, *[f"e{k}" for k in range(len(EXTRA))]) for r in rows]
    names = ", ".join(f"{e} string" for e in EXTRA)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}").repartition(3)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
