"""A table of job postings derived from whole given tables, in Spark and in SQL.

Every order is a posting, every line of it names two or three skills. Industries are of three
kinds: whole nations and market segments (large), single customers (1 to about
25 postings each, so both sides of the size gates are met at any scale), and
missing. Some brands carry further skills on the same lines, so that bundles exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.text import TextRules

# The given documents are invented prose in Latin letters: word families for each
# rule, so that every branch of sectioning and classification is met.
LATIN = TextRules(
    header=r"(their|dans|nicht|para)",
    line_start=r"(^|\n)\s*Re[:：]?",
    end=r"(which|leur|sein|como)",
    heading=r"^(The|An|El|La|Der|Les)[:：]?$",
    ignore=(r"https?|@|\d+\s*%|token", r"blea|quem", r"sch.*ung"),
    education=r"tion|ción|heit",
    age=r"ing|ando",
    age_blocked_by=r"the|und",
    experience=r"\d+\s*en|ent|ando",
    skill=r"ou|er|ar",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_SKILLS = """
    p_brand || ',' || p_type
    || CASE WHEN p_brand = 'Brand#3' THEN ',Brand#3_kit'
            WHEN p_brand = 'Brand#7' AND l_quantity > 4 THEN ',Brand#7_set; Brand#7_pro'
            WHEN p_brand = 'Brand#7' THEN ', Brand#7_set'
            WHEN p_brand = 'Brand#11' AND l_quantity > 9 THEN '；Brand#11_kit'
            ELSE '' END
"""

INDUSTRY = """
    CASE WHEN n_regionkey <= 1 THEN n_name
         WHEN n_regionkey <= 3 THEN n_name || '/' || CAST(c_custkey AS VARCHAR(20))
         WHEN o_orderstatus = 'P' THEN NULL
         ELSE c_mktsegment || ' market' END
"""

EXPERIENCE = """
    CASE o_orderpriority
      WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN '5年及以上' WHEN 'O' THEN '10年以上' ELSE ' 8 年 及以上 ' END
      WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN '3-5年' WHEN 'O' THEN '3 - 4 年' ELSE '5-10年经验' END
      WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN '1-3年' WHEN 'O' THEN '2年' ELSE '3年 以上' END
      WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN '面议' WHEN 'O' THEN '11年以内' ELSE NULL END
      ELSE CASE o_orderstatus WHEN 'F' THEN '无需经验' WHEN 'O' THEN '1年以内' ELSE '1年内' END
    END
"""

SALARY_UNIT = "CASE o_orderstatus WHEN 'F' THEN '元' WHEN 'O' THEN ' 千' WHEN 'P' THEN '万' END"
SALARY_PERIOD = """CASE o_orderpriority WHEN '1-URGENT' THEN '年' WHEN '2-HIGH' THEN '月'
    WHEN '3-MEDIUM' THEN '天' WHEN '4-NOT SPECIFIED' THEN '单' END"""
# what one unit of the posted number is worth per month, so that salaries are comparable
SALARY_WORTH = """(CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'O' THEN 1e3 ELSE 1e4 END)
    * (CASE o_orderpriority WHEN '1-URGENT' THEN 0.08e0 WHEN '3-MEDIUM' THEN 30e0 ELSE 1e0 END)"""
SALARY_LEVEL = "(o_totalprice * 0.05192837465192e0 + 500e0 * LENGTH(o_orderpriority))"

POSTINGS_SQL = f"""
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_name, {LINE_SKILLS} AS skills
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
listed AS (
  SELECT l_orderkey,
         string_agg(skills, ';' ORDER BY l_linenumber, l_partkey, l_quantity) AS job_skills,
         string_agg('works with ' || p_name, '；' ORDER BY l_linenumber, l_partkey, l_quantity) AS other_requirement,
         first(p_name ORDER BY l_linenumber, l_partkey, l_quantity) AS job_title
  FROM lines GROUP BY l_orderkey
),
postings AS (
  SELECT o_orderkey AS job_id, {INDUSTRY} AS industry_group, job_title, job_skills, other_requirement,
         {EXPERIENCE} AS experience_required,
         CASE o_orderstatus WHEN 'F' THEN '本科' WHEN 'O' THEN '大专' END AS education_required,
         {SALARY_UNIT} AS salary_unit, {SALARY_PERIOD} AS salary_period,
         CASE WHEN o_totalprice >= 5000 THEN 0.9e0 * {SALARY_LEVEL} / ({SALARY_WORTH}) END AS salary_min,
         1.1e0 * {SALARY_LEVEL} / ({SALARY_WORTH}) AS salary_max
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN listed ON l_orderkey = o_orderkey
)
"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings table; ``POSTINGS_SQL`` is the same in SQL."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.expr("l_partkey = p_partkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "p_name", F.expr(LINE_SKILLS).alias("skills"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "p_name", "skills")))
    listed = lines.groupBy("l_orderkey").agg(in_order.alias("lines")).select(
        "l_orderkey",
        F.array_join(F.col("lines.skills"), ";").alias("job_skills"),
        F.array_join(
            F.transform(F.col("lines.p_name"), lambda p: F.concat(F.lit("works with "), p)), "；"
        ).alias("other_requirement"),
        F.col("lines.p_name")[0].alias("job_title"),
    )
    offers = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .select(
            F.col("o_orderkey").alias("job_id"),
            F.expr(INDUSTRY).alias("industry_group"),
            F.expr(EXPERIENCE).alias("experience_required"),
            F.expr("CASE o_orderstatus WHEN 'F' THEN '本科' WHEN 'O' THEN '大专' END").alias("education_required"),
            F.expr(SALARY_UNIT).alias("salary_unit"),
            F.expr(SALARY_PERIOD).alias("salary_period"),
            F.expr(f"CASE WHEN o_totalprice >= 5000 THEN 0.9e0 * {SALARY_LEVEL} / ({SALARY_WORTH}) END").alias("salary_min"),
            F.expr(f"1.1e0 * {SALARY_LEVEL} / ({SALARY_WORTH})").alias("salary_max"),
        )
    )
    # derived below the join, so that the many uses of a column do not repeat its expression
    return offers.join(listed, F.expr("l_orderkey = job_id"), "left").drop("l_orderkey")
