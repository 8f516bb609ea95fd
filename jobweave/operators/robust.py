"""Matched-median skill premium for industries of medium size.

An industry has at most ``REGRESSION_MIN_JOBS - 1`` jobs here. Its salaries are
kept as one short sorted array; a skill brings the list of jobs that name it,
and every count and median of the skill is read off those two arrays in its own
row. So the jobs are never multiplied by the skills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.functions.scalars import experience_bucket
from jobweave.operators.skills import industry_sizes, job_skills
from jobweave.session import stage

KEY = "industry_group"
BUCKETS = ("<4", ">=4")


def _median(ordered: Column) -> Column:
    """Median of an array that is already in order; null if it is empty."""
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _salaries(jobs: str, bucket: str | None = None) -> Column:
    kept = F.col(jobs) if bucket is None else F.filter(jobs, lambda j: j["bucket"] == bucket)
    return F.transform(kept, lambda j: j["y"])


def skill_contrasts(sample: DataFrame) -> DataFrame:
    """Per (industry, skill) of medium industries: counts, median difference, and the same per bucket.

    ``buckets`` holds (bucket, w, diff) for both experience buckets; ``diff`` is
    null where one side is empty.
    """
    sizes = industry_sizes(sample, fv.ROBUST_MIN_JOBS, fv.REGRESSION_MIN_JOBS - 1)
    medium = sample.join(sizes.select(KEY), KEY, "left_semi")
    job = F.struct(
        F.col("avg_salary").alias("y"), "job_id", experience_bucket(F.col("exp_years")).alias("bucket")
    )
    jobs = medium.groupBy(KEY).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    holders = (
        job_skills(medium)
        .groupBy(KEY, "skill")
        .agg(F.sum("times").alias("_tokens"), F.collect_list("job_id").alias("holders"))
        .where("_tokens >= 2")
    )
    split = holders.join(jobs, KEY).select(
        KEY,
        "skill",
        F.filter("jobs", lambda j: F.array_contains("holders", j["job_id"])).alias("has"),
        F.filter("jobs", lambda j: ~F.array_contains("holders", j["job_id"])).alias("lacks"),
    )

    def diff(bucket: str | None = None) -> Column:
        return _median(_salaries("has", bucket)) - _median(_salaries("lacks", bucket))

    per_bucket = [
        F.struct(F.lit(b).alias("bucket"), F.size(_salaries("has", b)).alias("w"), diff(b).alias("diff")) for b in BUCKETS
    ]
    contrasts = split.select(
        KEY,
        "skill",
        (F.size("has") + F.size("lacks")).alias("n_samples"),
        F.size("has").alias("n_with_skill"),
        F.size("lacks").alias("n_without_skill"),
        diff().alias("median_premium"),
        F.array(*per_bucket).alias("buckets"),
    )
    return stage(contrasts, "contrasts")  # later filters would repeat these expressions if pushed below them


def robust_skill_values(sample: DataFrame, min_rows: int = fv.ROBUST_MIN_ROWS) -> DataFrame:
    """Skill value per medium industry; industries with too few usable skills are left out."""
    matched = F.filter("buckets", lambda b: b["diff"].isNotNull())
    total = F.aggregate(matched, F.lit(0.0), lambda s, b: s + b["w"] * b["diff"])
    weight = F.aggregate(matched, F.lit(0.0), lambda s, b: s + b["w"])
    match, median = F.col("coarse_match_premium"), F.col("median_premium")
    rows = (
        skill_contrasts(sample)
        .where("n_with_skill >= 2 and n_without_skill >= 2")
        .withColumns(
            {
                "coarse_match_premium": total / F.nullif(weight, F.lit(0.0)),
                "matched_bucket_count": F.size(matched),
            }
        )
        .where(match.isNull() | (F.signum(match) == F.signum(median)))
        .select(
            KEY, "skill", "n_samples", "n_with_skill", "n_without_skill", "median_premium", "coarse_match_premium",
            F.coalesce(match, median).alias("pure_skill_value"), "matched_bucket_count", F.lit(fv.ROBUST_METHOD).alias("method"),
        )
    )
    # a medium industry names few skills, so its rows fit one window
    return rows.withColumn("_usable", F.count(F.lit(1)).over(Window.partitionBy(KEY))).where(
        F.col("_usable") >= min_rows
    ).drop("_usable")
