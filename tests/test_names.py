import random
import re

import pytest

from jobweave.operators import skills

WORDS = ["x", "x 1", "x_1_1", "x 2", "x-2-1", "x 01", "y", "y 3", "技能", "数据", "1", "_1", "empty", "empty 1", "x 1 2", "x 99999999999999999999"]


def named_in_order(rows):
    """Names as they are given one after the other."""
    used, names = {}, {}
    for industry, skill, job, pos in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        safe = re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", skill)).strip("_")
        base = name = f"skill_{safe}" if safe else "skill_empty"
        taken, k = used.setdefault(industry, set()), 0
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        names[industry, skill] = name
    return names


def table(spark, rows):
    return spark.createDataFrame(rows, "industry_group string, skill string, first_job bigint, first_pos int")


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_those_given_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for industry in ("a", "b", "c"):
        names = [w + d for w in WORDS for d in ("", "!", " ", "??", "#") if rng.random() < 0.6]
        names = list(dict.fromkeys(n.replace(" ", rng.choice(" -_")) for n in names))
        rng.shuffle(names)
        rows += [(industry, n, k // 3, k % 3) for k, n in enumerate(names)]
    got = {(r.industry_group, r.skill): r.feature for r in skills.feature_names(table(spark, rows).repartition(3)).collect()}
    assert got == named_in_order(rows) and len(got) == len(rows)


def test_a_hundred_thousand_names_share_one_base(spark):
    n = 100_000
    skill = "translate(CAST(id AS STRING), '0123456789', '零一二三四五六七八九') AS skill"
    rows = spark.range(n).selectExpr("'i' AS industry_group", skill, "id AS first_job", "0 AS first_pos")
    got = skills.feature_names(rows)
    assert got.select("feature").distinct().count() == n
    first = {r.skill: r.feature for r in got.where("length(skill) = 1").collect()}
    assert first["零"] == "skill_empty" and first["九"] == "skill_empty_9"


def test_no_names_at_all(spark):
    assert skills.feature_names(table(spark, [])).collect() == []
