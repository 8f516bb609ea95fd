import importlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from jobweave.operators import prompts, warehouse
from jobweave.plans import flows
from jobweave.operators.embedding import hashed_ngrams
from jobweave.operators.kmeans import Settings
from jobweave.session import stage, staging_root
from jobweave.sources import files, tables


@pytest.mark.parametrize(
    "reply,name,items",
    [
        ('{"profile_name":"A","other_requirements":["x"," ","y"]}', "A", ["x", "y"]),
        ('```json\n{"profile_name":" B ","other_requirements":["x"]}\n```', "B", ["x"]),
        ('sure: {"profile_name":"C","other_requirements":[]} bye', "C", []),
        ('{"profile_name":"' + "n" * 30 + '","other_requirements":["1","2","3","4","5","6"]}', "n" * 20, list("12345")),
        ('{"other_requirements":["x"]}', None, ["x"]),
        ("no json", None, None),
        ("{broken", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_reply_parsing(spark, reply, name, items):
    df = spark.createDataFrame([("k", reply)], "cache_key string, reply string")
    got = prompts.read_replies(df).collect()
    if items is None:
        assert got == []
    else:
        assert (got[0]["profile_name"], got[0]["other_requirements"]) == (name, items)


def test_csv_round_trip_with_mark_and_quotes(spark, tmp_path):
    rows = [(1, 'say "hi"\nsecond, line', ["a", "b"], float("nan")), (2, " lead ", [], 1.5), (3, None, None, None)]
    df = spark.createDataFrame(rows, "job_id long, t string, l array<string>, x double").coalesce(1)
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfjob_id,")
    back = files.read_csv(spark, path, files.T.StructType.fromDDL("job_id long, t string, l string, x double"))
    got = {r["job_id"]: (r["t"], r["l"], r["x"]) for r in back.collect()}
    assert got[1] == ('say "hi"\nsecond, line', "a,b", None) and got[2][0] == " lead " and got[2][2] == 1.5
    assert got[3] == (None, None, None)


def test_raw_postings_are_strings(spark, tmp_path):
    path = tmp_path / "raw.csv"
    names = files.RAW_POSTING.fieldNames()
    path.write_text("﻿" + ",".join(names) + '\n007,t,"任职要求：a\nb",i,s,e,d,1,2,万,月\n', encoding="utf-8")
    row = files.read_raw_postings(spark, str(path)).first()
    assert row["job_id"] == "007" and row["job_description"] == "任职要求：a\nb" and row["salary_min"] == "1"


def test_wide_vectors(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(12)])], "job_id long, job_vec array<double>")
    wide = files.scatter_vector(df, 12)
    assert files.gather_vector(wide).first()["job_vec"] == [float(i) for i in range(12)]
    assert files.drop_vectors(wide).columns == ["job_id", "exp_numeric"]
    with pytest.raises(ValueError):
        files.drop_vectors(df)


def test_saved_table(spark):
    tables.save_table(spark.range(3), "saved_range")
    assert tables.load_table(spark, "saved_range").count() == 3
    spark.sql("DROP TABLE saved_range")


def test_job_features_tolerate_bad_values(spark):
    df = spark.createDataFrame(
        [(1, "t", "c", "oops", "5", "x", " ", " ", "面议", "e", "d"), (2, "t", "c", "1", None, "x", "i", "a,b", "3-5年", "e", "d")],
        "job_id long, job_title string, company_name string, min_salary string, max_salary string, city string, industry string,"
        " required_skills string, experience_requirement string, education_requirement string, job_description string",
    )
    a, b = warehouse.job_features(df).orderBy("job_id").collect()
    assert (a["salary_min"], a["industry"], a["skills_required"], a["experience_required"]) == (None, "未分类", [], None)
    assert (b["salary_min"], b["industry"], b["skills_required"], b["experience_required"]) == (1.0, "i", ["a", "b"], 3)


def test_key_figures_of_empty_tables(spark):
    jobs = spark.createDataFrame([], "location string, industry string, salary_min double, salary_max double")
    empty = spark.range(0)
    got = {r["stat_key"]: (r["metric_value"], r["metric_text"]) for r in warehouse.key_figures(jobs, empty, empty, empty).collect()}
    assert got["topLocation"] == (None, "N/A") and got["avgSalaryMax"] == (0.0, None) and got["totalJobs"] == (0.0, None)


def test_stage_uses_the_configured_folder(spark):
    assert staging_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    staged = stage(spark.range(5), "t")
    assert staged.count() == 5 and staged.inputFiles()[0].split("file://")[-1].startswith(staging_root(spark))


def postings(spark, n=160):
    rows = []
    for i in range(n):
        group = "大行业" if i < 100 else "中 行/业" if i < 150 else None
        tags = ["Java" if i % 2 else "销售", "Spring" if i % 2 else "谈判", f"t{i % 5}", "办公软件" if i % 3 else "英语"]
        text = "介绍\n任职要求：本科以上学历；" + ("责任心强，能适应长期出差的工作" if i % 2 else "形象气质佳，18-45岁") + "\n福利待遇：好"
        rows.append(
            (i, f"岗位{i % 4}", text, group, ",".join(tags), ["无需经验", "1-3年", "3-5年", "5年及以上"][i % 4],
             "本科" if i % 3 else None, 0.5 + (i % 9) / 10 + i % 2, 1.0 + (i % 7) / 10 + i % 2, "万", "月")
        )
    return spark.createDataFrame(
        rows, "job_id long, job_title string, job_description string, industry_group string, job_skills string,"
        " experience_required string, education_required string, salary_min double, salary_max double, salary_unit string,"
        " salary_period string",
    )


def test_flows_end_to_end(spark, tmp_path):
    clean = flows.extract_requirements(postings(spark))
    built = flows.build_job_vectors(clean, hashed_ngrams(16), 16)
    labels = {r["suggested_label"] for r in built.merge_preview.collect()}
    assert labels and all(label.endswith("技能包") for label in labels)
    jobs = stage(built.jobs, "jobs")
    assert jobs.count() == 160 and jobs.select(F.size("job_vec")).distinct().collect()[0][0] == 33

    clusters = flows.cluster_jobs(jobs, Settings(max_k=4, restarts=2))
    profiles = clusters.profiles.collect()
    assert {r["industry_group"] for r in profiles} == {"大行业", "中 行/业"}
    for g, n in (("大行业", 100), ("中 行/业", 50)):
        mine = [r for r in profiles if r["industry_group"] == g]
        assert sum(r["job_count"] for r in mine) == n
        assert sum(r["cluster_percentage_in_industry"] for r in mine) == pytest.approx(100, abs=0.05)
        assert sorted(r["cluster_id"] for r in mine) == list(range(1, len(mine) + 1))
    assert any(r["llm_prompt_file"] == "prompt_中_行_业_1.txt" for r in profiles)
    files.write_clustered(clusters.jobs, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").glob("industry_key=*")} == {"industry_key=大行业", "industry_key=中_行_业"}

    asked = clusters.prompts
    cache = prompts.read_replies(
        asked.where("cluster = 1").select("cache_key", F.lit('{"profile_name":"名","other_requirements":["一","二"]}').alias("reply"))
    )
    named = prompts.apply_replies(clusters.profiles, asked, cache).collect()
    assert all((r["profile_name"], r["other_requirements"]) == ("名", "一；二") for r in named if r["cluster_id"] == 1)
    assert all(r["profile_name"].startswith("Cluster ") for r in named if r["cluster_id"] > 1)
    assert prompts.open_prompts(asked, cache).where("cluster = 1").isEmpty()

    salaries = flows.analyse_salaries(jobs)
    curve = salaries.exp_curve.collect()
    assert len(curve) == 11 and {r["industry_group"] for r in curve} == {"大行业"}
    impact = salaries.skill_impact.collect()
    assert impact and all(r["n_samples"] == 100 and r["selection_method"] == "Mutual Information" for r in impact)
    robust = salaries.skill_value_robust.collect()
    assert all(r["industry_group"] == "中 行/业" and r["n_samples"] == 50 for r in robust)


def test_an_industry_is_one_file_and_few_tasks_list_them(spark, tmp_path, monkeypatch):
    rows = [(i, f"g {i % 40}/x", 1 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "job_id long, industry_group string, cluster int").coalesce(1)
    path, name = str(tmp_path / "c"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    files.write_clustered(df, path)
    folders = [p for p in (tmp_path / "c").iterdir() if p.is_dir()]
    assert len(folders) == 40 and all(len(list(p.iterdir())) == 1 for p in folders)  # no checksum file beside it
    before = spark.conf.get(name)
    got = files.read_clustered(spark, path)
    assert sorted((r.job_id, r.industry_key, r.cluster) for r in got.collect()) == [(i, f"g_{i % 40}_x", c) for i, _, c in rows]
    assert spark.conf.get(name) == before


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["industry_group", "skill"]


def test_folders_on_a_local_path_are_written_by_the_tasks(spark, tmp_path):
    """The folders and rows that Spark's own writer makes, and no process for each of them."""
    names = ["a/b c", "50% of: 'x'=[y]", "中文", "", "plain", "q?*#\\^{\x7f", "dots.."]
    rows = [(n, i, f"t{i}" if i % 3 else None, [1.0]) for i, n in enumerate(names * 5)] + [(None, 99, "none", [2.0])]
    df = spark.createDataFrame(rows, "industry_group string, job_id long, job_title string, job_vec array<double>").repartition(3)
    mine, theirs = f"{tmp_path}/mine", f"{tmp_path}/theirs"
    files.write_clustered(df, f"file://{mine}")
    df.drop("job_vec").withColumn("industry_key", files.file_key(F.col("industry_group"))).write.partitionBy("industry_key").parquet(theirs)
    folders = lambda path: sorted(p.name for p in Path(path).iterdir() if not p.name.startswith("."))
    assert folders(mine) == folders(theirs)
    assert sorted(map(str, files.read_clustered(spark, mine).collect())) == sorted(map(str, spark.read.parquet(theirs).collect()))
    assert files.read_clustered(spark, mine).schema == spark.read.parquet(theirs).schema
    written = list(Path(mine).rglob("*.parquet"))
    assert written and all("arrow" in pq.read_metadata(p).created_by for p in written)
    with pytest.raises(AnalysisException):
        files.write_clustered(df, mine)
