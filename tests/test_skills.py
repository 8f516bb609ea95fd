import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from jobweave.functions.scalars import add_skills
from jobweave.operators import bundles, robust, skew, skills
from jobweave.operators.ordering import rank_rows, running_total, with_neighbours


def jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, industry_group string, job_skills string").transform(add_skills)


def test_counts_tokens_and_jobs(spark):
    df = jobs(spark, [(1, "i", "a,a"), (2, "i", "b"), (3, "i", "c"), (4, "i", "x;c"), (5, None, "a,a")])
    got = {r["skill"]: (r["token_cnt"], r["job_cnt"]) for r in skills.skill_counts(skills.job_skills(df)).collect()}
    assert got == {"a": (2, 1), "c": (2, 2)}


def test_merge_fixtures(spark):
    rows = [(i, "i", s) for i, s in enumerate(["p,q,all", "p,q,all", "r,all", "r,all", "z,all", "all"])]
    preview = bundles.merge_preview(bundles.bundle_members(jobs(spark, rows))).collect()
    assert [(r["suggested_label"], r["original_skills"]) for r in preview] == [("q技能包", "p;q")]


def test_chain_is_one_bundle_and_merge_keeps_first_position(spark):
    # a-b and b-c correlate above the threshold, a-c does not
    sets = ["a,b,c"] * 10 + ["a,b"] * 3 + ["b,c"] * 3 + ["x" + str(i) for i in range(28)]
    rows = [(i, "i", s) for i, s in enumerate(sets)] + [(99, "i", "x,c,y,a"), (100, "other", "a,b,a"), (101, None, "b,b")]
    df = jobs(spark, rows)
    members = bundles.bundle_members(df)
    assert {r["skill"] for r in members.collect()} == {"a", "b", "c"}
    merged = {r["job_id"]: r["merged_job_skills"] for r in bundles.apply_merges(df, members).collect()}
    label = next(r["suggested_label"] for r in members.collect())
    assert merged[0] == label and merged[99] == f"x,{label},y" and merged[100] == "a,b" and merged[101] == "b"


def test_nothing_to_merge_leaves_table(spark):
    df = jobs(spark, [(1, "i", "a,b"), (2, "i", "a"), (3, "i", "b")])
    assert "merged_job_skills" not in bundles.apply_merges(df, bundles.bundle_members(df)).columns


@pytest.mark.parametrize("seed", [1, 2])
def test_correlations_and_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        have = [s for s in "abcdefgh" if rng.random() < 0.4]
        have += [s + "2" for s in have if s in "abc" and rng.random() < 0.93]
        rows.append((i, f"g{i % 3}", ",".join(have)))
    df = jobs(spark, rows)
    got = {(r["industry_group"], r["skill"]): r["bundle"] for r in bundles.bundle_members(df, 0.6).collect()}
    want = {}
    for g in ("g0", "g1", "g2"):
        lists = [r[2].split(",") if r[2] else [] for r in rows if r[1] == g]
        count = Counter(s for x in lists for s in x)
        names = sorted(s for s, n in count.items() if n >= 2)
        m = np.array([[s in x for s in names] for x in lists], dtype=float)
        parent = {s: s for s in names}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.corrcoef(m.T)
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                if r[i, j] > 0.6:
                    x, y = sorted((find(a), find(names[j])))
                    parent[y] = x
        sizes = Counter(find(s) for s in names)
        want.update({(g, s): find(s) for s in names if sizes[find(s)] > 1})
    assert got == want and want


def test_copied_postings_fold_before_pairing(spark):
    many = ",".join(f"s{i:03d}" for i in range(60))
    rows = [(i, "i", many) for i in range(5)] + [(10 + i, "i", "z") for i in range(5)]
    df = jobs(spark, rows)
    tokens = skills.job_skills(df)
    found = bundles.bundle_members(df).collect()
    assert len(found) == 60 and len({r["bundle"] for r in found}) == 1
    counts = skills.skill_counts(tokens, extra=bundles.fingerprints())
    assert bundles.twins(counts).select("twin_of").distinct().count() == 2


def test_feature_names_stay_unique(spark):
    df = jobs(spark, [(1, "i", "a b,a-b,a b 1,数,据"), (2, "i", "a b,a-b,a b 1,数,据")])
    counts = skills.skill_counts(skills.job_skills(df))
    got = {r["skill"]: r["feature"] for r in skills.feature_names(counts).collect()}
    assert got["a b"] == "skill_a_b" and got["数"] == "skill_empty" and got["据"] == "skill_empty_1"
    assert len(set(got.values())) == 5


def test_running_total_and_neighbours_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, id long")
    got = rank_rows(df, ["k"], ["v", "id"], "r")
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted(x[1:] for x in rows if x[0] == key), 1):
            want[r[1]] = n
    assert {r["id"]: r["r"] for r in got.collect()} == want
    from pyspark.sql import functions as F

    total = running_total(df, ["k"], ["v", "id"], F.col("v"), "t")
    assert total.groupBy("k").agg(F.max("t").alias("t")).join(df.groupBy("k").agg(F.sum("v").alias("s")), "k").where("t <> s").isEmpty()
    import jobweave.operators.ordering as ordering

    block, ordering.RANK_BLOCK = ordering.RANK_BLOCK, 16
    try:
        near = {(r["k"], r["r"]): r["near"] for r in with_neighbours(got, ["k"], "r", "id", 3, "near").collect()}
    finally:
        ordering.RANK_BLOCK = block
    at = defaultdict(dict)
    for k, v, i in rows:
        at[k][want[i]] = i
    assert len(near) == 900
    for (k, r), ids in near.items():
        assert ids == [at[k][x] for x in range(r - 3, r + 4) if x in at[k]]


def test_routes_and_budgets(spark):
    rows = [(i, name) for name, n in (("a", 9), ("b", 10), ("c", 69), ("d", 70), ("e", 90), ("f", 90)) for i in range(n)]
    df = spark.createDataFrame(rows + [(0, None)], "job_id long, industry_group string")
    sizes = skills.industry_sizes(df)
    routes = {r["industry_group"]: r["route"] for r in skills.route_industries(sizes).collect()}
    assert routes == {"a": "none", "b": "robust", "c": "robust", "d": "regression", "e": "regression", "f": "regression"}
    assert {r["industry_group"]: r["skill_budget"] for r in skills.skill_budgets(sizes).collect()} == {"e": 16, "f": 10, "d": 5}


def test_eight_budgets(spark):
    sizes = spark.createDataFrame([(f"g{i}", 100 - i) for i in range(8)], "industry_group string, n_jobs long")
    got = sorted((r["skill_budget"] for r in skills.skill_budgets(sizes).collect()), reverse=True)
    assert got == [16, 14, 13, 11, 10, 8, 7, 5]


def sample(spark, rows):
    return spark.createDataFrame(
        rows, "job_id long, industry_group string, avg_salary double, exp_years double, skills_list array<string>"
    )


def test_robust_values_and_gates(spark):
    rng = random.Random(3)
    rows = []
    for g, names in (("keep", "pqr"), ("drop", "pq")):
        for i in range(20):
            have = [s for n, s in enumerate(names) if (i >> n) & 1]
            pay = 1000.0 + 500 * len(have) + rng.random()
            rows.append((i, g, pay, float(rng.randrange(8)), have))
    out = robust.robust_skill_values(sample(spark, rows)).collect()
    assert {r["industry_group"] for r in out} == {"keep"}
    for r in out:
        has = [x for x in rows if x[1] == "keep" and r["skill"] in x[4]]
        lacks = [x for x in rows if x[1] == "keep" and r["skill"] not in x[4]]
        med = lambda xs: float(np.median([x[2] for x in xs]))
        assert r["median_premium"] == pytest.approx(med(has) - med(lacks))
        diffs = [
            (len(h), med(h) - med(n))
            for h, n in (
                ([x for x in has if x[3] < 4], [x for x in lacks if x[3] < 4]),
                ([x for x in has if x[3] >= 4], [x for x in lacks if x[3] >= 4]),
            )
            if h and n
        ]
        assert r["matched_bucket_count"] == len(diffs) > 0
        assert r["coarse_match_premium"] == pytest.approx(sum(w * d for w, d in diffs) / sum(w for w, _ in diffs))
        assert r["n_with_skill"] + r["n_without_skill"] == r["n_samples"] == 20
        assert np.sign(r["median_premium"]) == np.sign(r["coarse_match_premium"]) and r["pure_skill_value"] == r["coarse_match_premium"]


@pytest.mark.parametrize("listed", [128, 3, 0])
def test_pairs_of_short_and_long_industries(spark, monkeypatch, listed):
    """A list of skills per industry and a join of tokens find the same pairs, with repeated and missing job ids and hot industries."""
    monkeypatch.setattr(bundles, "LISTED", listed)
    monkeypatch.setattr(skew, "HEAVY_ROWS", 30)
    rng = random.Random(3)
    rows = [(i // 2 if i % 7 == 0 else i if i % 11 else None, "gh"[i % 3 > 1], rng.choices("abcde" if i % 3 > 1 else "abc", k=rng.randint(0, 6))) for i in range(150)]
    rows += [(500 + i, "lone", ["a"] * (i % 2)) for i in range(4)] + [(600, None, ["a", "b"])]
    df = spark.createDataFrame(rows, "job_id long, industry_group string, skills_list array<string>")
    valid = bundles.varying_skills(skills.plain_counts(df), skills.industry_sizes(df))
    got = {(r.industry_group, r.skill_a, r.skill_b): (r.n_a, r.n_b, r.n_both) for r in bundles.skill_correlations(df, valid, 0.0).collect()}
    want = {}
    for g in ("g", "h", "lone"):
        mine, n = {}, sum(r[1] == g for r in rows)
        for job, own, tokens in rows:
            if own == g:
                mine.setdefault(job, []).extend(set(tokens))
        cnt = Counter(t for x in mine.values() for t in x)
        tokens = Counter(t for _, own, x in rows if own == g for t in x)
        both = Counter((x[i], x[j]) for x in (sorted(t for t in x if tokens[t] > 1 and cnt[t] < n) for x in mine.values()) for i in range(len(x)) for j in range(i + 1, len(x)))
        for (a, b), k in both.items():
            if n * k > cnt[a] * cnt[b]:
                want[g, a, b] = (cnt[a], cnt[b], k)
    assert got == want and len(want) > 3


def test_counts_without_first_appearances(spark):
    rows = [(1, "g", ["a", "b", "a"]), (2, "g", ["a"]), (2, "g", ["b", "c"]), (3, "h", ["c", "c"]), (4, None, ["a", "a"]), (5, "h", [])]
    df = spark.createDataFrame(rows, "job_id long, industry_group string, skills_list array<string>")
    columns = ["industry_group", "skill", "token_cnt", "job_cnt"]
    want = sorted(skills.skill_counts(skills.job_skills(df)).select(*columns).collect())
    assert sorted(skills.plain_counts(df).select(*columns).collect()) == want == [("g", "a", 3, 2), ("g", "b", 2, 2), ("h", "c", 2, 1)]


def test_no_token_is_joined(spark):
    """Skill lists are one row per industry: the tokens of postings are neither exploded nor joined."""
    df = spark.createDataFrame([(i, "g", ["a", "b", "c"][: 1 + i % 3]) for i in range(30)], "job_id long, industry_group string, skills_list array<string>")
    valid = bundles.varying_skills(skills.plain_counts(df), skills.industry_sizes(df))
    assert "Generate" not in bundles.listed_skills(df, valid)._jdf.queryExecution().optimizedPlan().toString()
