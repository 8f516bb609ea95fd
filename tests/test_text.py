import pytest
from pyspark.sql import functions as F

from jobweave.functions import text
from jobweave.functions.scalars import experience_score, safe_base_name, skill_tokens, yuan_per_month
from jobweave.operators import embedding


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(fn(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "value,label",
    [
        ("五险一金", "ignore"),
        ("薪资 3000", "ignore"),
        ("hrbp优先", "ignore"),
        ("本科学历优先", "other"),
        ("18-45岁", "other"),
        ("年龄18岁", "other"),
        ("3年工作经验", "experience"),
        ("３年", "experience"),
        ("熟悉SQL", "skill"),
        ("沟通能力强", "skill"),
        ("责任心强", "other"),
        ("", "ignore"),
        ("：", "ignore"),
    ],
)
def test_classify(spark, value, label):
    assert one(spark, value, text.classify_line) == label


def test_age_rule_is_blocked_by_year(spark):
    assert one(spark, "年龄18岁", lambda c: text.classify_line(c, unmatched=None)) is None
    assert one(spark, "18-45岁", lambda c: text.classify_line(c, unmatched=None)) == "other"


@pytest.mark.parametrize(
    "value,expected",
    [("- 【负责】", "负责"), ("  • a b •", "a b"), ("：：x：", "x："), ("　 [y]\x1f", "y"), (None, "")],
)
def test_clean_line(spark, value, expected):
    assert one(spark, value, text.clean_line) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("上班9:00到18:00", ["上班9:00到18:00"]),
        ("要求:a;b。c", ["要求:", "a;", "b。", "c"]),
        ("任职要求：\n1、x\r\n 2、y\x0b\x85z", ["1、x", "2、y", "z"]),
        ("任职条件\n工作内容", ["任职条件"]),
        ("a：：b", ["a：", "b"]),
        ("   ", []),
        (None, []),
    ],
)
def test_split_lines(spark, value, expected):
    assert one(spark, value, text.split_lines) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("介绍\n任职要求：会A\n岗位职责：做B\n福利", "：会A\n"),
        ("介绍\n 要求:会A", "会A"),
        ("内部要求：会A", "内部要求：会A"),
        ("岗位要求x任职资格y", "x任职资格y"),
        (" 全文 ", "全文"),
        (None, ""),
    ],
)
def test_requirement_section(spark, value, expected):
    assert one(spark, value, text.requirement_section) == expected


def test_other_requirement_keeps_order(spark):
    value = "公司\n任职要求：\n1、本科以上学历，熟悉SQL；责任心强，五险一金\n- 3年经验,能出差\n福利待遇：好"
    assert one(spark, value, text.other_requirement) == "1、本科以上学历；责任心强；能出差"


def test_one_line_and_phrases(spark):
    assert one(spark, "\na\r\nb ", text.one_line) == "；a；；b"
    assert one(spark, None, text.one_line) == ""
    assert one(spark, "0123456789,short.  abcdefghij \n", text.phrases) == ["0123456789", "abcdefghij"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("无需经验", 0.0), ("1年以内", 0.05), ("11年以内", 0.05), ("1-3年", 0.2), ("3 - 4 年", 0.35),
        ("5年及以上", 0.5), ("10年以上", 1.1), ("3年", 0.3), (None, 0.0), ("面议", 0.0), ("３　年以上", 0.4),
    ],
)
def test_experience(spark, value, expected):
    assert one(spark, value, experience_score) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "value,unit,period,expected",
    [
        (1.5, "万", "月", 15000), (24.0, "万", "年", 20000), (8.0, "千", "月", 8000), (300.0, "元", "天", 9000),
        (50.0, "元", "单", 50), (5000.0, None, None, 5000), (5000.0, "美元", "周", 5000), (None, "万", "月", None),
        (float("nan"), "万", "月", None),
    ],
)
def test_salary(spark, value, unit, period, expected):
    df = spark.createDataFrame([(value, unit, period)], "v double, u string, p string")
    got = df.select(yuan_per_month(F.col("v"), F.col("u"), F.col("p"))).first()[0]
    assert got == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize(
    "value,expected",
    [("a, b;；c,,", ["a", "b", "c"]), ("a，b", ["a，b"]), ("a,a", ["a", "a"]), (None, []), ("", [])],
)
def test_skill_tokens(spark, value, expected):
    assert one(spark, value, skill_tokens) == expected


def test_tags_and_names(spark):
    assert one(spark, " a b,c；d　e ", text.tag_list) == ["a", "b", "c", "d", "e"]
    assert one(spark, "C++ / Qt!", safe_base_name) == "skill_C_Qt"
    assert one(spark, "数据", safe_base_name) == "skill_empty"


def test_seed_decision_table(spark):
    rows = [
        (0.5, 0.5, 0.5, "experience"), (0.2, 0.5, 0.5, "skill"), (0.45, 0.3, 0.44, "other"), (0.46, 0.3, 0.47, "other"),
        (0.1, 0.2, 0.3, "skill"), (0.3, 0.2, 0.35, "experience"), (0.2, 0.2, 0.1, "other"), (0.44, 0.44, 0.4, "other"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "sim_experience double, sim_skill double, sim_other double")
    assert [r[0] for r in df.select(embedding.seed_label()).collect()] == [r[3] for r in rows]


def test_seeded_other_requirement_uses_model_once_per_segment(spark):
    def load():
        return lambda texts: [[1.0, 0.0, 0.0] if "x" in t else [0.0, 0.0, 1.0] for t in texts]

    encode = embedding.batch_encoder(load)
    seeds = spark.createDataFrame(
        [("experience", [0.0, 1.0, 0.0]), ("skill", [1.0, 0.0, 0.0]), ("other", [0.0, 0.0, 1.0])], "class string, vec array<double>"
    )
    docs = spark.createDataFrame([(1, "x1，本科，y1；y2"), (2, "x2"), (3, None)], "job_id long, d string")
    out = embedding.add_other_requirement(docs, "d", encode, seeds)
    assert {r["job_id"]: r["other_requirement"] for r in out.collect()} == {1: "本科；y1；y2", 2: "", 3: ""}
