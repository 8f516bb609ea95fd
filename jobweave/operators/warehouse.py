"""Feature tables and key figures of the warehouse path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv


def job_features(jobs: DataFrame) -> DataFrame:
    skills = F.trim("required_skills")
    industry = F.trim("industry")
    return jobs.select(
        "job_id",
        "job_title",
        "company_name",
        F.col("min_salary").try_cast("double").alias("salary_min"),
        F.col("max_salary").try_cast("double").alias("salary_max"),
        F.col("city").alias("location"),
        F.coalesce(F.nullif(industry, F.lit("")), F.lit(fv.UNCLASSIFIED)).alias("industry"),
        F.when(skills.isNull() | (skills == ""), F.array().cast("array<string>"))
        .otherwise(F.split(skills, ","))
        .alias("skills_required"),
        F.regexp_extract("experience_requirement", r"(\d+)", 1).try_cast("int").alias("experience_required"),
        F.col("education_requirement").alias("education_required"),
        "job_description",
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )


def user_features(users: DataFrame) -> DataFrame:
    lists = ("skills", "industry_preference", "location_preference")
    return users.select(
        "user_id",
        "age",
        "education",
        "work_experience",
        *[F.split(c, ",").alias(c) if c in lists else F.col(c) for c in
          ("skills", "industry_preference", "salary_expectation", "location_preference")],
        "created_at",
        F.current_timestamp().alias("updated_at"),
    )


def interactions(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("id").alias("interaction_id"), "user_id", "job_id", "interaction_type", "interaction_time", "created_at"
    )


def _figure(key: str, name: str, category: str, dimension: str, source: str, value: Column, text: Column) -> Column:
    return F.struct(
        F.lit(key).alias("stat_key"),
        F.lit(name).alias("stat_name"),
        F.lit(category).alias("metric_category"),
        F.lit(dimension).alias("dimension"),
        value.cast("double").alias("metric_value"),
        text.cast("string").alias("metric_text"),
        F.lit(source).alias("source_table"),
    )


def key_figures(jobs: DataFrame, users: DataFrame, events: DataFrame, static_source: DataFrame) -> DataFrame:
    """One row per figure. Every table is read once: the jobs are counted whole, by location and by industry in one pass."""
    none = F.lit(None)
    counts = jobs.groupingSets([["location"], ["industry"], []], "location", "industry").agg(
        F.count(F.lit(1)).alias("n"), F.avg("salary_max").alias("hi"), F.avg("salary_min").alias("lo"), F.grouping_id().alias("_set")
    )
    whole = F.col("_set") == 3

    def top(column: str, number: int) -> Column:
        order = F.when((F.col("_set") == number) & F.col(column).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
        return F.coalesce(F.min_by(column, order), F.lit(fv.NO_VALUE))

    job_stats = counts.agg(
        F.coalesce(F.max(F.when(whole, F.col("n"))), F.lit(0)).alias("n"),
        F.max(F.when(whole, F.col("hi"))).alias("hi"),
        F.max(F.when(whole, F.col("lo"))).alias("lo"),
        top("location", 1).alias("location"),
        top("industry", 2).alias("industry"),
    )
    job_rows = job_stats.select(
        F.explode(
            F.array(
                _figure("totalJobs", "Total Jobs", "job", "all", "job_feature_table", F.col("n"), none),
                _figure("avgSalaryMax", "Average Max Salary", "job", "all", "job_feature_table", F.coalesce("hi", F.lit(0.0)), none),
                _figure("avgSalaryMin", "Average Min Salary", "job", "all", "job_feature_table", F.coalesce("lo", F.lit(0.0)), none),
                _figure("topLocation", "Top Job Location", "job", "location", "job_feature_table", none, F.col("location")),
                _figure("topIndustry", "Top Job Industry", "job", "industry", "job_feature_table", none, F.col("industry")),
            )
        ).alias("f")
    )
    count = F.count(F.lit(1))
    parts = [
        job_rows,
        users.agg(count.alias("n")).select(
            _figure("totalUsers", "Total Users", "user", "all", "user_feature_table", F.col("n"), none).alias("f")
        ),
        events.agg(count.alias("n")).select(
            _figure("totalInteractions", "Total Interactions", "interaction", "all", "interaction_table", F.col("n"), none).alias("f")
        ),
        static_source.agg(count.alias("n")).select(
            _figure("staticSourceRecords", "Static Report Source Records", "static", "all", "report_static_source", F.col("n"), none).alias("f")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    now = F.current_timestamp()
    return out.select(
        "f.stat_key", "f.stat_name", "f.metric_category", "f.dimension", "f.metric_value", "f.metric_text",
        now.alias("metric_time"), "f.source_table", now.alias("created_at"), now.alias("updated_at"),
    )
