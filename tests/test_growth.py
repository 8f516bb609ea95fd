"""Intermediate tables grow no faster than the input, and cuts into blocks do not change results."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.operators import bundles, embedding, mutual_info, ordering, regression, silhouette, skills
from tests.test_models import SCHEMA, brute_mi


def salaries(n=400, seed=5):
    rng = random.Random(seed)
    odds = {"common": 0.6, "most": 0.95, "some": 0.15, "rare": 0.02}
    return [
        (i, "g", round(rng.lognormvariate(9, 0.4), 2), 1.0, [s for s, p in odds.items() if rng.random() < p] + ["run"] * (100 < i < 160) + ["few"] * (i % 50 == 7))
        for i in range(n)
    ]


def staged_rows(monkeypatch, *modules):
    """The number of rows of every table staged from now on by ``modules``."""
    seen = {}
    keep = modules[0].stage

    def counted(df, name):
        out = keep(df, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "stage", counted)
    return seen


def test_mutual_information_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANK_BLOCK", 32)
    monkeypatch.setattr(mutual_info, "REACH", 12)
    rows = salaries()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.skill: r.mi for r in mutual_info.mutual_information(df, skills.industry_sizes(df)).collect()}
    ticks = {r.job_id: r.t for r in df.select("job_id", mutual_info.salary_ticks(F.col("avg_salary"), F.col("job_id")).alias("t")).collect()}
    assert set(got) == {"common", "most", "some", "rare", "few", "run"}
    for skill, mi in got.items():
        assert mi == pytest.approx(brute_mi([ticks[r[0]] for r in rows], [skill in r[4] for r in rows]), abs=1e-8), skill


def test_mutual_information_keeps_no_row_per_token(spark, monkeypatch):
    rows = salaries(600, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    seen = staged_rows(monkeypatch, mutual_info, ordering)
    mutual_info.mutual_information(df, skills.industry_sizes(df)).collect()
    assert sum(len(r[4]) for r in rows) > 1.5 * len(rows)
    assert max(seen.values()) <= len(rows)


def test_repeated_job_ids_take_the_joins(spark):
    """Each copy is counted as the joins count it, in its industry only."""
    rows = salaries(120, 7)
    mixed = spark.createDataFrame([*rows, *rows[:5], *[(r[0], "h", *r[2:]) for r in rows]], SCHEMA)
    got = mutual_info.mutual_information(mixed, skills.industry_sizes(mixed))
    for name, part in (("g", rows + rows[:5]), ("h", [(r[0], "h", *r[2:]) for r in rows])):
        df = spark.createDataFrame(part, SCHEMA)
        want = {r.skill: r.mi for r in mutual_info.mutual_information(df, skills.industry_sizes(df)).collect()}
        assert {r.skill: r.mi for r in got.where(F.col("industry_group") == name).collect()} == pytest.approx(want, abs=1e-9)


def test_a_gram_is_hashed_once():
    calls, counts = [], np.zeros((3, 8))
    bucket = lambda gram: calls.append(gram) or len(calls) % 8
    embedding._count_grams(["abab" * 50, "ab", "babab"], 3, bucket, counts)
    assert sorted(calls) == ["a b a", "ab", "b a b"] and counts.sum(1).tolist() == [198, 1, 3]


def test_grams_do_not_depend_on_batches(spark, monkeypatch):
    texts = ["", "x", "héllo wörld", "日本語のテキスト", "🙂🙂🙂a", "aaaa" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id long, t string")
    got = {r.job_id: r.v for r in embedding.hashed_ngrams(16)(df, "t", "v").collect()}
    for i, t in enumerate(texts):
        grams = [" ".join(t[k : k + 3]) for k in range(len(t) - 2)] or [t]
        want = np.zeros(16)
        for g in grams:
            want[int(hashlib.md5(g.encode()).hexdigest()[:6], 16) % 16] += 1
        assert got[i] == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-12)


def test_pairs_are_found_once(spark, monkeypatch):
    rows = [(i, "g", ["a", "b", "c"][: 1 + i % 3] + (["d", "e"] if i % 2 else [])) for i in range(40)]
    df = spark.createDataFrame(rows, "job_id long, industry_group string, skills_list array<string>")
    seen = staged_rows(monkeypatch, bundles)
    assert {r.skill for r in bundles.bundle_members(df).collect()} == {"d", "e"}
    assert seen["pairs"] == 1


def test_products_leave_a_task_as_sums(spark, monkeypatch):
    """Repeated features add up, zeros are kept where both occur, and no product of a row is a row."""
    rows = [("g", [("a", 1.0), ("b", float(i % 2)), ("b", 2.0)] + ([("c", 0.0)] if i == 3 else [])) for i in range(200)]
    df = spark.createDataFrame(rows, f"industry_group string, vec {regression.FEATURES}").coalesce(1)
    got = {(r.f, r.g): r.s for r in regression.gram(df, "vec").collect()}
    assert got == {("a", "a"): 200, ("a", "b"): 500, ("b", "b"): 1300, ("a", "c"): 0, ("b", "c"): 0, ("c", "c"): 0}
    assert "Generate" not in regression.gram(df, "vec")._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_meets_few_blocks():
    """Chosen_k ships a row once per block of the clusters it asks: at 4,096 rows a block that was 147 GB at 6 GB of input."""
    assert silhouette.BLOCK_ROWS >= 16384 and silhouette.BLOCK_ROWS * silhouette.CHUNK_ROWS <= 4 << 20


def test_term_vectors_are_made_once(spark, monkeypatch):
    rows = [("g", i, [("t", 1.0), ("u", float(i))]) for i in range(20)]
    df = spark.createDataFrame(rows, f"industry_group string, job_id long, vec {regression.FEATURES}")
    seen = staged_rows(monkeypatch, regression)
    assert regression.residual_context(df).count() == 20 and seen["tfidf"] == 20
