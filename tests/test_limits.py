"""Nothing is cut off by a constant, and odd values do not stop a run."""

import pytest
from pyspark.sql import functions as F

from jobweave.functions import text, vectors
from jobweave.operators import embedding, mutual_info, silhouette, skills
from jobweave.sources import files


def test_every_label_gets_a_number(spark):
    rows = [("g", k, k % 12) for k in range(24)] + [("g", 100, 5)]
    out = silhouette.number_clusters(spark.createDataFrame(rows, "industry_group string, job_id long, label int")).collect()
    assert len(out) == 25 and {r.cluster for r in out} == set(range(1, 13))
    assert {r.cluster for r in out if r.job_id in (5, 17, 100)} == {1}


def test_budget_alone_limits_the_skills(spark):
    scores = spark.createDataFrame([("g", f"s{k:02d}", k, 0, 0.5) for k in range(40)], "industry_group string, skill string, first_job long, first_pos int, mi double")
    budgets = spark.createDataFrame([("g", 30)], "industry_group string, skill_budget int")
    got = [r.skill for r in mutual_info.select_skills(scores, budgets).orderBy("rank").collect()]
    assert got == [f"s{k:02d}" for k in range(30)]


def test_a_wrong_salary_does_not_stop_the_ranks(spark):
    df = spark.createDataFrame([(1, 1e12), (2, 1e12), (3, 5000.0)], "job_id long, v double")
    ticks = [r.t for r in df.select(mutual_info.salary_ticks(F.col("v"), F.col("job_id")).alias("t")).collect()]
    assert len(set(ticks)) == 3 and ticks[2] < min(ticks[:2])


def test_a_taken_name_gets_the_next_free_number_of_its_base(spark):
    names = ["a b 1", "a b", "a-b", "x", "a_b_2", "a.b"]
    counts = spark.createDataFrame([("g", s, k, 0) for k, s in enumerate(names)], "industry_group string, skill string, first_job long, first_pos int")
    got = {r.skill: r.feature for r in skills.feature_names(counts).collect()}
    base = {s: skills_base(spark, s) for s in names}
    used, want = set(), {}
    for s in names:
        name, k = base[s], 1
        while name in used:
            name, k = f"{base[s]}_{k}", k + 1
        used.add(name)
        want[s] = name
    assert got == want and got["a-b"] == f"{base['a b']}_2"


def skills_base(spark, skill):
    return spark.createDataFrame([(skill,)], "s string").select(skills.safe_base_name(F.col("s")).alias("b")).first().b


def test_short_vectors_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="three values"):
        df.select(*vectors.half_split(F.col("v"))).collect()


def test_reply_cache_starts_empty_and_grows(spark, tmp_path):
    path = str(tmp_path / "cache.json")
    assert files.read_reply_cache(spark, path).count() == 0
    row = lambda k, n: spark.createDataFrame([(k, n, ["r"])], "cache_key string, profile_name string, other_requirements array<string>")
    files.update_reply_cache(spark, path, row("a", "one").union(row("a", "two")))
    files.update_reply_cache(spark, path, row("b", "three").union(row("a", "four")))
    assert sorted((r.cache_key, r.profile_name) for r in files.read_reply_cache(spark, path).collect()) == [("a", "four"), ("b", "three")]


def test_listed_tags_are_not_cut(spark):
    df = spark.createDataFrame([([" a b ", "", None, "c,d"],), (None,)], "v array<string>")
    assert [r.t for r in df.select(text.tag_items(F.col("v")).alias("t")).collect()] == [["a b", "c,d"], []]


def test_result_sink(spark, tmp_path):
    df = spark.createDataFrame([("g", 1.5)], "industry_group string, v double")
    files.write_result(df.limit(0), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    files.write_result(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().v == "1.5"


def test_matrix_of_one_industry(spark):
    rows = [(1, "g", ["a b", "a-b", "c"]), (2, "g", ["a b", "a-b", "a b"]), (3, "g", []), (4, "h", ["a b", "a b"])]
    df = spark.createDataFrame(rows, "job_id long, industry_group string, skills_list array<string>")
    got = skills.industry_matrix(df, "g")
    assert got.columns[2:] == ["skill_a_b", "skill_a_b_1"]
    assert sorted(tuple(r[c] for c in ("job_id", *got.columns[2:])) for r in got.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 0)]


def test_any_number_of_seeds(spark, monkeypatch):
    points = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(6)], "job_id long, vec array<double>")
    seeds = spark.createDataFrame([(c, [float(k), 3.0, n]) for k in range(9) for c, n in (("skill", 1.0), ("other", 2.0))], "class string, vec array<double>")
    look = lambda: sorted(map(tuple, embedding.seed_similarity(points, "vec", seeds).drop("vec").collect()), key=lambda r: r[0])
    whole = look()
    monkeypatch.setattr(embedding, "SEED_PORTION", 4)
    assert look() == whole and all(r[1] is None and r[2] is not None for r in whole)
