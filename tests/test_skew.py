import random

import pytest
from pyspark.sql import functions as F

from jobweave.operators import bundles, embedding, skew
from jobweave.functions.text import tag_list


def labels_of(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for industry, a, b in edges:
        a, b = sorted((root((industry, a)), root((industry, b))))
        parent[b] = a
    return {x: root(x)[1] for x in list(parent)}


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_components_of_stars_chains_and_random_edges(spark, monkeypatch, heavy):
    monkeypatch.setattr(skew, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(bundles, "HEAVY_ROWS", heavy)
    rng = random.Random(heavy)
    edges = [("star", "hub", f"s{k}") for k in range(400)] + [("star", f"s{k}", f"t{k}") for k in range(0, 400, 7)]
    chain = [f"c{k:04}" for k in range(700)]
    rng.shuffle(chain)
    edges += [("chain", a, b) for a, b in zip(chain, chain[1:])]
    edges += [("random", f"r{rng.randrange(300)}", f"r{rng.randrange(300)}") for _ in range(200)]
    df = spark.createDataFrame(edges + edges[:50], "industry_group string, a string, b string").repartition(3)
    got = {(r.industry_group, r.node): r.label for r in bundles.connected_components(df).collect()}
    assert got == labels_of(edges)
    assert bundles.connected_components(df.limit(0)).collect() == []


def test_heavy_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
    monkeypatch.setattr(skew, "MOST_HEAVY", 2)
    keys = ["x"] * 50 + ["y"] * 20 + ["z"] * 9 + ["u", "v", "v"] + [None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    side = spark.createDataFrame([("x", 1, 50), ("y", 2, 20), ("z", 3, 9), ("u", 4, 1), ("w", 5, 0)], "k string, v int, n long")
    got = sorted(tuple(r) for r in skew.join_one(rows, side, ["k"], "n").select("id", "k", "v").collect())
    value = {"x": 1, "y": 2, "z": 3, "u": 4}
    assert got == [(i, k, value[k]) for i, k in enumerate(keys) if k in value]


def test_a_tag_in_every_posting(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 10)
    rows = spark.createDataFrame([(i, "a,b" if i % 2 else "a,a,zz") for i in range(40)], "job_id long, job_skills string")
    lookup = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "tag string, vec array<double>")
    out = {r.job_id: r.skill_vec for r in embedding.tag_vectors(rows, tag_list(F.col("job_skills")), lookup, 2).collect()}
    assert len(out) == 40 and all(out[i] == ([0.5, 1.5] if i % 2 else [1.0, 0.0]) for i in out)


@pytest.mark.parametrize("sent", [1 << 20, 32, 1])
def test_tag_means_where_the_rows_lie(spark, monkeypatch, sent):
    """Repeated and missing job ids, tags and vectors that are listed twice, tags beyond those sent: as by joins."""
    monkeypatch.setattr(embedding, "TAG_BYTES", sent)
    rng = random.Random(7)
    rows = [(i // 2 if i < 20 else i, [rng.choice("abcdefz") for _ in range(i % 6)] + [None] * (i % 2)) for i in range(120)]
    rows += [(None, ["a"]), (500, None), (501, [None])]
    lookup = [("a", [1.0, 0.0]), ("b", [0.0, 3.0]), ("c", [2.5, -1.0]), ("d", [7.0, 7.0]), ("e", [0.5, 0.25]), ("b", [8.0, 1.0]), ("unused", [9.0, 9.0])]
    df = spark.createDataFrame(rows, "job_id long, tags array<string>").repartition(3)
    out = embedding.tag_vectors(df, F.col("tags"), spark.createDataFrame(lookup, "tag string, vec array<double>"), 2).collect()
    named, vecs = {}, {}
    for job_id, tags in rows:
        named.setdefault(job_id, []).extend(tags or [])
    for tag, vec in lookup:
        vecs.setdefault(tag, []).append(vec)
    for r in out:
        own = [v for t in named[r.job_id] for v in vecs.get(t, [])] if r.job_id is not None else []
        assert r.skill_vec == pytest.approx([sum(v[d] for v in own) / len(own) if own else 0.0 for d in range(2)]), r.job_id
    assert sorted((str(r.job_id), str(r.tags)) for r in out) == sorted((str(i), str(t)) for i, t in rows)


def test_tag_vectors_do_not_move(spark, tmp_path):
    spark.createDataFrame([(i, "a,b" if i % 2 else "a,a,zz") for i in range(40)], "job_id long, job_skills string").write.parquet(f"{tmp_path}/jobs")
    rows = spark.read.parquet(f"{tmp_path}/jobs")
    lookup = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "tag string, vec array<double>")
    plan = embedding.tag_vectors(rows, tag_list(F.col("job_skills")), lookup, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_tag_without_a_vector_is_an_error(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], "job_id long, tags array<string>")
    lookup = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "tag string, vec array<double>")
    with pytest.raises(ValueError, match="vector of 2 values"):
        embedding.tag_vectors(rows, F.col("tags"), lookup, 2)
