"""Cluster profiles: counts, top values, averages, phrases, one row per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.functions.scalars import skill_tokens
from jobweave.functions.text import phrases
from jobweave.operators.ordering import top_rows
from jobweave.session import stage

KEYS = ["industry_group", "cluster"]


def cluster_sizes(df: DataFrame) -> DataFrame:
    """Jobs per cluster and their share of the industry in percent."""
    return with_shares(df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("job_count")))


def with_shares(sizes: DataFrame) -> DataFrame:
    totals = sizes.groupBy("industry_group").agg(F.sum("job_count").alias("_n"))
    share = F.bround(100 * F.col("job_count") / F.col("_n"), 2)
    return sizes.join(totals, "industry_group").withColumn("cluster_percentage_in_industry", share).drop("_n")


def top_values(df: DataFrame, keys: list[str], value: Column, limit: int) -> DataFrame:
    """Most frequent non-null values per group, ties by value: rows (keys, value, n, rank).

    Counting comes first, with map-side combine; only counts are ranked.
    """
    counts = (
        df.select(*keys, value.alias("value"))
        .where("value is not null")
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_rows(counts, keys, [F.desc("n"), F.asc("value")], limit)


def joined(top: DataFrame, keys: list[str], name: str, separator: str) -> DataFrame:
    """Ranked values of a group as one text, best first."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    return top.groupBy(*keys).agg(F.array_join(in_order, separator).alias(name))


def top_titles(df: DataFrame) -> DataFrame:
    return top_values(df, KEYS, F.col("job_title"), fv.TOP_TITLES)


def skills_column(df: DataFrame) -> Column:
    return skill_tokens(F.col("merged_job_skills" if "merged_job_skills" in df.columns else "job_skills"))


def core_skills(df: DataFrame) -> DataFrame:
    tokens = df.select(*KEYS, F.explode(skills_column(df)).alias("skill"))
    return top_values(tokens, KEYS, F.col("skill"), fv.TOP_SKILLS)


def most_common(df: DataFrame, column: str) -> DataFrame:
    return top_values(df, KEYS, F.coalesce(column, F.lit(fv.UNKNOWN)), 1).select(*KEYS, F.col("value").alias(column))


def frequent_phrases(
    df: DataFrame, keys: list[str], column: str, limit: int = fv.PHRASE_TOP, min_chars: int = fv.PHRASE_MIN_CHARS
) -> DataFrame:
    pieces = df.where(F.col(column).isNotNull()).select(*keys, F.explode(phrases(F.col(column), min_chars)).alias("phrase"))
    return top_values(pieces, keys, F.col("phrase"), limit)


def mean_salaries() -> list[Column]:
    return [F.bround(F.avg(f"salary_{x}_norm"), 2).alias(f"salary_{x}_avg") for x in ("min", "max")]


def salary_means(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(*mean_salaries())


def sample_texts(
    df: DataFrame, keys: list[str], column: str, size: int = fv.TEXT_SAMPLE, seed: int = fv.CLUSTER_SEED, row_id: str = "job_id"
) -> DataFrame:
    """At most ``size`` texts per group, chosen by a seeded hash of the row id: same rows on every run."""
    drawn = df.where(F.col(column).isNotNull()).select(
        *keys, row_id, F.col(column).alias("value"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))).alias("_draw")
    )
    return top_rows(drawn, keys, [F.col("_draw"), F.col(row_id)], size).drop("_draw")


def file_key(industry: Column) -> Column:
    return F.translate(industry, "/ ", "__")


def profile_values(df: DataFrame) -> DataFrame:
    """The most frequent values of every kind per cluster, counted together in one shuffle."""
    kinds = {
        "top_titles": (F.array("job_title"), fv.TOP_TITLES, "; "),
        "core_skills": (skills_column(df), fv.TOP_SKILLS, "; "),
        "other_requirements": (phrases(F.col("other_requirement")), fv.PHRASE_TOP, fv.OTHER_JOINER),
        "experience": (F.array(F.coalesce("experience_required", F.lit(fv.UNKNOWN))), 1, ""),
        "education": (F.array(F.coalesce("education_required", F.lit(fv.UNKNOWN))), 1, ""),
    }

    def of_kind(name: str, listed: Column) -> Column:
        return F.transform(listed, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("value")))

    listed = F.concat(*[of_kind(name, values) for name, (values, _, _) in kinds.items()])
    values = df.select(*KEYS, F.explode(listed).alias("x")).select(*KEYS, "x.kind", "x.value")
    top = top_values(values, [*KEYS, "kind"], F.col("value"), max(n for _, n, _ in kinds.values()))
    texts = []
    for name, (_, most, separator) in kinds.items():
        mine = F.collect_list(F.when((F.col("kind") == name) & (F.col("rank") <= most), F.struct("rank", "value")))
        text = F.array_join(F.transform(F.array_sort(mine), lambda x: x["value"]), separator)
        texts.append(text.alias(name))
    return top.groupBy(*KEYS).agg(*texts)


def cluster_profiles(df: DataFrame) -> DataFrame:
    """One profile row per (industry, cluster) of clustered, prepared postings: two scans, one of values and one of rows."""
    industry, cluster = F.col("industry_group"), F.col("cluster").cast("string")
    sizes = stage(df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("job_count"), *mean_salaries()), "cluster-sizes")
    out = with_shares(sizes).join(profile_values(df), KEYS, "left")
    return out.select(
        "industry_group",
        F.col("cluster").alias("cluster_id"),
        F.concat(F.lit("Cluster "), cluster, F.lit(" ("), industry, F.lit(")")).alias("profile_name"),
        F.concat(F.lit("profile_name_prompt_"), file_key(industry), F.lit("_"), cluster, F.lit(".txt")).alias(
            "profile_name_prompt_file"
        ),
        "job_count",
        "cluster_percentage_in_industry",
        F.coalesce("top_titles", F.lit("")).alias("top_titles"),
        F.coalesce("core_skills", F.lit("")).alias("core_skills"),
        "experience",
        F.coalesce("other_requirements", F.lit("")).alias("other_requirements"),
        "education",
        "salary_min_avg",
        "salary_max_avg",
        F.concat(F.lit("prompt_"), file_key(industry), F.lit("_"), cluster, F.lit(".txt")).alias("llm_prompt_file"),
    )


def staged_clusters(df: DataFrame) -> DataFrame:
    """The columns profiles read, written once because each statistic reads them again."""
    wanted = [
        "industry_group", "cluster", "job_id", "job_title", "job_skills", "merged_job_skills", "other_requirement",
        "experience_required", "education_required", "salary_min_norm", "salary_max_norm",
    ]
    return stage(df.select(*[c for c in wanted if c in df.columns]), "clustered")
