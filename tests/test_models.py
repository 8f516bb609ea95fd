import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.operators import embedding, kmeans, mutual_info, regression, silhouette, skills


def psi(n):
    return -0.5772156649015328606 + sum(1.0 / i for i in range(1, n))


def brute_mi(ticks, flags):
    n_all, parts = 0, []
    for label in (True, False):
        at = [i for i, f in enumerate(flags) if f == label]
        if len(at) < 2:
            continue
        k = min(3, len(at) - 1)
        for i in at:
            d = sorted(abs(ticks[i] - ticks[j]) for j in at if j != i)[k - 1]
            m = max(1, sum(abs(t - ticks[i]) < d for t in ticks))
            parts.append((psi(k), psi(len(at)), psi(m)))
        n_all += len(at)
    mean = np.mean(parts, axis=0)
    return max(0.0, psi(n_all) + mean[0] - mean[1] - mean[2])


def salary_rows(seed, n=90, tied=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        have = [s for s, p in (("common", 0.95), ("half", 0.5), ("rare", 0.05), ("solo", 0.0)) if rng.random() < p]
        pay = 5000 + 2500 * ("half" in have) + rng.gauss(0, 800)
        rows.append((i, "i", float(round(pay, -3)) if tied else pay, float(rng.randrange(10)), have))
    rows[0][4].extend(["solo", "solo"])
    rows[1][4].extend(["all_but"])
    for r in rows[1:]:
        if "all_but" not in r[4]:
            r[4].append("all_but")
    return rows


SCHEMA = "job_id long, industry_group string, avg_salary double, exp_years double, skills_list array<string>"


@pytest.mark.parametrize("seed,tied", [(1, False), (2, True), (3, True)])
def test_mutual_information_matches_brute_force(spark, seed, tied):
    rows = salary_rows(seed, tied=tied)
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = skills.industry_sizes(df)
    got = {r["skill"]: r["mi"] for r in mutual_info.mutual_information(df, sizes).collect()}
    ticks = {
        r["job_id"]: r["t"]
        for r in df.select("job_id", mutual_info.salary_ticks(F.col("avg_salary"), F.col("job_id")).alias("t")).collect()
    }
    order = [ticks[r[0]] for r in rows]
    assert set(got) == {"common", "half", "rare", "solo", "all_but"}
    for skill, mi in got.items():
        assert mi == pytest.approx(brute_mi(order, [skill in r[4] for r in rows]), abs=1e-8), skill


def test_digamma(spark):
    df = spark.range(1, 400, 7).select(F.col("id").alias("n"), mutual_info.digamma(F.col("id")).alias("v"))
    for r in df.collect():
        assert r["v"] == pytest.approx(psi(r["n"]), abs=1e-9)


def regression_sample(spark, n=120):
    rng = random.Random(11)
    names = [f"s{i}" for i in range(9)] + ["two words", "more words"]
    rows = []
    for g in ("a", "b"):
        for i in range(n - 30 * (g == "b")):
            have = [s for s in names if rng.random() < 0.3]
            exp = float(rng.choice([0, 0.5, 1, 2, 3, 5, 6, 8]))
            pay = 6000 + 900 * exp + 60 * exp**1.5 + 700 * ("s0" in have) + rng.gauss(0, 400)
            rows.append((i, g, pay, exp, have))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_regression_equals_dense_least_squares(spark):
    rows, df = regression_sample(spark)
    design, coefs = regression.fit_industries(df)
    impact = regression.skill_impact(design, coefs).collect()
    curve = regression.exp_curve(coefs).collect()
    assert {r["industry_group"]: sum(x["industry_group"] == r["industry_group"] for x in impact) for r in impact} == {"a": 11, "b": 5}
    for g in ("a", "b"):
        feats = {r["job_id"]: {x["f"]: x["v"] for x in r["feats"]} for r in design.where(F.col("industry_group") == g).collect()}
        names = sorted({f for x in feats.values() for f in x})
        mine = [r for r in rows if r[1] == g]
        x = np.array([[feats[r[0]].get(f, 0.0) for f in names] for r in mine])
        y = np.array([r[2] for r in mine])
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        se = np.sqrt(np.abs(np.diag(np.linalg.pinv(x.T @ x))) * ((y - x @ beta) ** 2).sum() / (len(y) - rank))
        for r in impact:
            if r["industry_group"] != g:
                continue
            i = names.index("skill:" + r["skill"])
            assert r["coefficient"] == pytest.approx(beta[i], rel=1e-6, abs=1e-6)
            if rank == len(names):
                assert r["std_err"] == pytest.approx(se[i], rel=1e-6)
            assert r["p_value"] == pytest.approx(math.erfc(abs(r["coefficient"] / r["std_err"]) / math.sqrt(2)), rel=1e-12)
            assert r["ci_upper"] - r["ci_lower"] == pytest.approx(2 * 1.96 * r["std_err"])
            assert r["n_samples"] == len(mine)
        b = dict(zip(names, beta))
        for r in curve:
            if r["industry_group"] == g:
                e = r["years_experience"]
                want = b["intercept"] + b["exp"] * e + b["exp_smooth"] * e**1.5
                assert r["predicted_salary"] == pytest.approx(want, rel=1e-6)
    assert len(curve) == 22


def test_residual_context_matches_dense_svd(spark):
    _, df = regression_sample(spark)
    sizes = skills.industry_sizes(df)
    selected = spark.createDataFrame([("a", "s0"), ("b", "s1")], "industry_group string, skill string")
    terms = regression.leftover_terms(skills.job_skills(df), selected)
    rows = regression.tfidf_rows(terms, regression.term_weights(terms, sizes))
    context = regression.residual_context(rows).where("industry_group = 'a'").collect()
    dense = {r["job_id"]: {x["f"]: x["v"] for x in r["vec"]} for r in rows.where("industry_group = 'a'").collect()}
    names = sorted({f for v in dense.values() for f in v})
    assert "words" in names and "s0" not in names
    x = np.array([[v.get(f, 0.0) for f in names] for v in dense.values()])
    assert np.allclose((x * x).sum(1), 1.0)
    got = np.array([[r[f"residual_context_{i}"] for i in (1, 2, 3)] for r in context])
    assert np.allclose(np.linalg.norm(got, axis=0), np.linalg.svd(x, compute_uv=False)[:3])


def blobs(seed=0, groups=("a", "b"), n=60, k=3, dims=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        centers = rng.normal(0, 6, (k, dims))
        for i in range(n):
            rows.append((g, len(rows), [float(v) for v in centers[i % k] + rng.normal(0, 0.5, dims)], i % k))
    return rows


def test_clusters_recover_blobs(spark):
    rows = blobs() + [("tiny", 1000 + i, [float(i)] * 5, 0) for i in range(9)] + [("same", 2000 + i, [1.0] * 5, 0) for i in range(12)]
    points = spark.createDataFrame([r[:3] for r in rows], "industry_group string, job_id long, features array<double>")
    out = silhouette.cluster_industries(points, kmeans.Settings(max_k=5, restarts=4)).collect()
    by = {}
    for r in out:
        by.setdefault(r["industry_group"], {})[r["job_id"]] = r
    assert set(by) == {"a", "b", "same"}
    for g in ("a", "b"):
        assert {r["k"] for r in by[g].values()} == {3}
        truth = {r[1]: r[3] for r in rows if r[0] == g}
        pairs = {(truth[j], r["cluster"]) for j, r in by[g].items()}
        assert len(pairs) == 3 and {c for _, c in pairs} == {1, 2, 3}
    assert {r["cluster"] for r in by["same"].values()} == {1}


def test_portions_do_not_change_the_result(spark, monkeypatch):
    points = spark.createDataFrame([r[:3] for r in blobs(4)], "industry_group string, job_id long, features array<double>")
    settings = kmeans.Settings(max_k=4, restarts=3)
    whole = sorted(map(str, kmeans.fit_all(points, settings).collect()))
    assert sorted(map(str, kmeans.fit_all(points.repartition(3), settings).collect())) == whole
    monkeypatch.setattr(kmeans, "LOCAL_BYTES", 0)  # from here on by passes over the rows
    assert sorted(map(str, kmeans.fit_all(points, settings).collect())) == whole
    monkeypatch.setattr(kmeans, "CENTROID_BYTES", 1)
    assert sorted(map(str, kmeans.fit_all(points.repartition(3), settings).collect())) == whole


def test_dealt_restarts_do_not_change_the_result(spark, monkeypatch):
    points = spark.createDataFrame([r[:3] for r in blobs(4)], "industry_group string, job_id long, features array<double>")
    settings = kmeans.Settings(max_k=4, restarts=5)
    whole = sorted(map(str, kmeans.fit_all(points, settings).collect()))
    seen, fit = [], kmeans._fit_split
    monkeypatch.setattr(kmeans, "_fit_split", lambda points, deals, *rest: seen.append(deals) or fit(points, deals, *rest))
    monkeypatch.setattr(kmeans, "SPLIT_BYTES", 0)  # three industries on four cores: two tasks each
    assert sorted(map(str, kmeans.fit_all(points.repartition(3), settings).collect())) == whole and seen == [2]


def test_moving_centroids_meet_the_rows_together(monkeypatch):
    """One pass over the rows a round, whatever the number of models; of equally near centroids the first has the row."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(700, 4)), np.zeros((5, 4))])
    square, seeds = (x * x).sum(1), [x[:2], x[5:7], np.zeros((3, 4)), x[9:12]]
    passes, assigned = [], kmeans._assigned
    monkeypatch.setattr(kmeans, "_assigned", lambda *a: passes.append(len(a[3])) or assigned(*a))
    settled, inertia = kmeans._settle(x, square, seeds, 1e-9, 300)
    assert passes[0] == passes[-1] == 4 and len(passes) < 100
    for start, found, total in zip(seeds, settled, inertia):
        alone, mine = kmeans._settle(x, square, [start], 1e-9, 300)
        assert found == pytest.approx(alone[0], abs=1e-9) and total == pytest.approx(mine[0])
    n, sums, _ = assigned(x, square, seeds[2], np.array([3]))
    assert n.tolist() == [len(x), 0, 0] and sums[0] == pytest.approx(x.sum(0))


def plain_kmeans(ids, x, counts, restarts, seed=42):
    """Labels of every k as lists: weighted draws, then moves until they are small, one row and centroid at a time."""
    tolerance = x.var(0, ddof=1).mean() * kmeans.TOLERANCE
    best = {}
    for restart in range(restarts):
        seeds, weight = [], np.ones(len(x))
        for step in range(max(counts)):
            keys = [(-np.log(u) / w, i) for i, (u, w) in enumerate(zip(kmeans._uniform(ids, seed, restart, step), weight)) if w >= 1e-12]
            if not keys:
                break
            seeds.append(x[min(keys)[1]])
            weight = np.array([min(((row - s) ** 2).sum() for s in seeds) for row in x])
        for k in counts:
            if k > min(len(seeds), len(x) - 1):
                continue
            centres = np.array(seeds[:k])
            for _ in range(300):
                near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
                moved = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
                shift, centres = ((moved - centres) ** 2).sum(), moved
                if shift <= tolerance:
                    break
            square = ((x[:, None] - centres[None]) ** 2).sum(-1)
            rank = (float(f"{square.min(1).sum():.9e}"), restart)
            if k not in best or rank < best[k][0]:
                best[k] = (rank, square.argmin(1).tolist())
    return [best[k][1] if k in best else [None] * len(x) for k in counts]


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_whole_fit_equals_a_plain_one(spark, monkeypatch, local):
    monkeypatch.setattr(kmeans, "LOCAL_BYTES", local)
    rng = np.random.default_rng(5)
    rows = [("a", k, rng.normal(size=3).tolist()) for k in range(60)] + [("b", 100 + k, rng.normal(size=3).tolist()) for k in range(4)]
    rows += [("twice", 200 + k, [float(k % 2), 0.0, 0.0]) for k in range(7)]
    points = spark.createDataFrame(rows, "industry_group string, job_id long, features array<double>")
    settings = kmeans.Settings(max_k=5, restarts=3)
    got = {r.job_id: r.labels for r in kmeans.fit_all(points.repartition(3), settings).collect()}
    hashes = {r.job_id: r.h for r in points.select("job_id", F.xxhash64("job_id").alias("h")).collect()}
    for industry in ("a", "b", "twice"):
        own = sorted((r for r in rows if r[0] == industry), key=lambda r: hashes[r[1]])
        labels = plain_kmeans(np.array([hashes[r[1]] for r in own]), np.array([r[2] for r in own]), settings.counts, 3, settings.seed)
        assert [got[r[1]] for r in own] == [list(t) for t in zip(*labels)]
    assert len(got) == len(rows) and kmeans.fit_all(points.limit(0), settings).count() == 0


def test_inertia_never_rises(spark):
    points = spark.createDataFrame(
        [r[:3] for r in blobs(2, groups=("a",), n=80, k=6)], "industry_group string, job_id long, features array<double>"
    ).withColumn("row_hash", F.xxhash64("job_id"))
    models = kmeans._seed_models(points, {"a": 0.0}, kmeans.Settings(max_k=5, restarts=2))
    assert [len(m.centroids) for m in models] == [2, 3, 4, 5] * 2
    last = None
    for _ in range(6):
        kmeans._lloyd(points, models, 1)
        now = [m.inertia for m in models]
        assert last is None or all(b <= a + 1e-9 for a, b in zip(last, now))
        last = now


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_over_many_blocks_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 16)
    monkeypatch.setattr(silhouette, "CHUNK_ROWS", 5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    labels = rng.integers(0, 4, (90, 2))
    labels[:, 1] = np.where(np.arange(90) == 7, 9, labels[:, 1] % 2)
    rows = [("g", i, [float(v) for v in x[i]], [int(v) for v in labels[i]]) for i in range(90)]
    points = spark.createDataFrame(rows, "industry_group string, job_id long, features array<double>, labels array<int>")
    got = {(r["model"], r["job_id"]): r["score"] for r in silhouette.row_scores(points).collect()}
    for model in (0, 1):
        want = brute_silhouette(x, labels[:, model])
        assert np.allclose([got[model, i] for i in range(90)], want, atol=1e-9)


@pytest.mark.parametrize("apart", [0.0, 12.0])
def test_bounds_choose_the_same_k_with_fewer_pairs(spark, monkeypatch, apart):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 64)
    monkeypatch.setattr(silhouette, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(8)
    rows, want, n = [], {}, 240
    for industry in ("g", "h"):
        groups = rng.integers(0, 5 if industry == "g" else 3, n)
        x = rng.normal(size=(n, 3)) + apart * rng.normal(size=(5, 3))[groups]
        labels = np.stack([groups % k for k in (2, 3, 4, 5)], 1)
        labels[0, 2] = 9  # a row alone in its cluster
        rows += [(industry, f"{industry}{i}", x[i].tolist(), labels[i].tolist()) for i in range(n)]
        scores = [brute_silhouette(x, labels[:, m]).mean() if len(set(labels[:, m])) > 1 else -2 for m in range(4)]
        want[industry] = (int(np.argmax(scores)) + 2, max(scores))
    rows.append(("alone", "z", [1.0, 2.0, 3.0], [0, None, None, None]))
    points = spark.createDataFrame(rows, "industry_group string, job_id string, features array<double>, labels array<int>").repartition(3)
    got = {r.industry_group: (r.k, r.silhouette) for r in silhouette.choose_k(points, kmeans.Settings(max_k=5)).collect()}
    assert set(got) == {"g", "h"}
    for industry, (k, score) in want.items():
        assert got[industry][0] == k and got[industry][1] == pytest.approx(score, abs=1e-9)
    bounds = silhouette.score_bounds(points)
    low = {(r.industry_group, r.job_id, r.model): r for r in bounds.collect()}
    exact = {(r.industry_group, r.job_id, r.model): r.score for r in silhouette.row_scores(points).collect()}
    assert set(low) == set(exact) and all(r.low - 1e-9 <= exact[k] <= r.high + 1e-9 for k, r in low.items())
    _, sizes = silhouette.meetings(bounds, silhouette.open_models(bounds))
    pairs = sum(r.n * r.wanted for r in sizes.collect())
    if apart:  # two industries of n rows under four models, all pairs of each once
        assert pairs < 0.25 * 2 * 4 * n * n
    assert silhouette.choose_k(points.limit(0), kmeans.Settings(max_k=5)).collect() == []


def test_a_distance_is_taken_once_for_all_models(spark, monkeypatch):
    """Industries that fit into a task get the scores that bounds and pairs give, in blocks, and no distance is taken per model."""
    for name, value in (("TILE_ROWS", 31), ("CHUNK_ROWS", 7), ("LEAST_PAIRS", 1500)):
        monkeypatch.setattr(silhouette, name, value)
    rng = np.random.default_rng(9)
    rows = []
    for industry, n in (("g", 150), ("h", 40), ("twice", 30)):
        x = rng.normal(size=(n, 3)) + 3 * rng.normal(size=(4, 3))[rng.integers(0, 4, n)]
        labels = np.stack([(x[:, 0] * k).astype(int) % k for k in (2, 3, 4)], 1).tolist()
        labels[0], labels[1] = [0, 7, None], [1, 1, 1]  # a cluster of one row, a row without a label
        rows += [(industry, i % 29 if industry == "twice" else i, x[i].tolist(), labels[i]) for i in range(n)]
    rows.append(("alone", 1, [1.0, 2.0, 3.0], [0, None, None]))
    points = spark.createDataFrame(rows, "industry_group string, job_id long, features array<double>, labels array<int>").repartition(3)
    pruned, seen = silhouette._pruned_scores, []
    monkeypatch.setattr(silhouette, "_pruned_scores", lambda p: seen.append({r[0] for r in p.select("industry_group").distinct().collect()}) or pruned(p))
    settings = kmeans.Settings(max_k=4)
    whole = {r.industry_group: (r.k, round(r.silhouette, 9)) for r in silhouette.choose_k(points, settings).collect()}
    assert seen == [{"twice"}] and set(whole) == {"g", "h", "twice"}
    exact = {(r.industry_group, r.model): r.silhouette for r in silhouette.silhouette_scores(points).collect()}
    sizes = points.groupBy("industry_group").agg(F.count(F.lit(1)).alias("n_jobs")).where("industry_group in ('g', 'h')")
    scores = {(r.industry_group, r.model): r.silhouette for r in silhouette.whole_scores(points, sizes).collect()}
    assert scores == pytest.approx({k: v for k, v in exact.items() if k[0] in ("g", "h")}, abs=1e-9) and len(scores) == 6
    monkeypatch.setattr(silhouette, "WHOLE_BYTES", 0)
    assert {r.industry_group: (r.k, round(r.silhouette, 9)) for r in silhouette.choose_k(points, settings).collect()} == whole


def test_vectors(spark):
    lookup = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "tag string, vec array<double>")
    df = spark.createDataFrame([(1, "a,a,b,zz"), (2, "zz"), (3, None)], "job_id long, job_skills string")
    from jobweave.functions.text import tag_list

    out = embedding.tag_vectors(df, tag_list(F.col("job_skills")), lookup, 2)
    got = {r["job_id"]: r["skill_vec"] for r in out.collect()}
    assert got[1] == pytest.approx([2 / 3, 1.0]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_text_vectors_for_strings_and_lists(spark):
    encode = embedding.hashed_ngrams(16)
    df = spark.createDataFrame([(1, "hello world", ["hello world", " "]), (2, " ", []), (3, "ab", ["ab", "hello world"])],
                               "job_id long, s string, l array<string>")
    one = {r["job_id"]: r["other_vec"] for r in embedding.text_vectors(df, "s", encode, 16).collect()}
    many = {r["job_id"]: r["other_vec"] for r in embedding.text_vectors(df, "l", encode, 16).collect()}
    assert one[1] == pytest.approx(many[1]) and one[2] == many[2] == [0.0] * 16
    assert many[3] == pytest.approx([(a + b) / 2 for a, b in zip(one[3], one[1])])
    assert np.linalg.norm(one[3]) == pytest.approx(1.0)
