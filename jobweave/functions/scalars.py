"""Experience, salary and skill-list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.functions.text import strip, wide


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, wide(pattern), group).try_cast("double")


def experience_score(text: Column) -> Column:
    """Experience text to years / 10. The order of the tests is part of the meaning."""
    t = strip(F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９", "0123456789"))
    within = F.lit(False)
    for mark in fv.WITHIN_ONE_YEAR:
        within = within | t.contains(mark)
    return (
        F.when(t.contains(fv.NO_EXPERIENCE), 0.0)
        .when(within, 0.5 / 10.0)
        .when(t.rlike(wide(fv.YEAR_RANGE)), (_number(t, fv.YEAR_RANGE, 1) + _number(t, fv.YEAR_RANGE, 2)) / 2.0 / 10.0)
        .when(t.rlike(wide(fv.YEARS_AND_UP)), _number(t, fv.YEARS_AND_UP, 1) / 10.0)
        .when(t.rlike(wide(fv.YEARS_OVER)), (_number(t, fv.YEARS_OVER, 1) + 1.0) / 10.0)
        .when(t.rlike(wide(fv.YEARS)), _number(t, fv.YEARS, 1) / 10.0)
        .otherwise(0.0)
    )


def _factor(label: Column, factors: dict[str, float]) -> Column:
    trimmed, out = strip(label), None
    for name, factor in factors.items():
        out = F.when(trimmed == name, factor) if out is None else out.when(trimmed == name, factor)
    return out.otherwise(1.0)


def yuan_per_month(value: Column, unit: Column, period: Column) -> Column:
    """Salary in yuan per month; unknown or missing labels count as yuan and month."""
    return nan_to_null(value.cast("double")) * _factor(unit, fv.UNIT_FACTOR) * _factor(period, fv.PERIOD_FACTOR)


def skill_tokens(skills: Column) -> Column:
    """Skill string to its list of trimmed, non-empty tokens (duplicates kept)."""
    parts = F.split(F.coalesce(skills, F.lit("")), fv.SKILL_BREAK)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def experience_bucket(years: Column) -> Column:
    return F.when(years < fv.EXPERIENCE_SPLIT_YEARS, "<4").when(years >= fv.EXPERIENCE_SPLIT_YEARS, ">=4")


def safe_base_name(skill: Column) -> Column:
    """Formula-safe form of a skill, before collisions are numbered."""
    bare = F.btrim(F.regexp_replace(skill, "[^0-9a-zA-Z]+", "_"), F.lit("_"))
    return F.when(bare != "", F.concat(F.lit("skill_"), bare)).otherwise("skill_empty")


def column_or(df: DataFrame, name: str, default=None) -> Column:
    """A column if the table has it, else a constant."""
    return F.col(name) if name in df.columns else F.lit(default)


def add_experience(df: DataFrame) -> DataFrame:
    return df.withColumn("exp_numeric", experience_score(F.col("experience_required")))


def add_salary(df: DataFrame) -> DataFrame:
    unit, period = column_or(df, "salary_unit", "元"), column_or(df, "salary_period", "月")
    return df.withColumns(
        {
            "salary_min_norm": yuan_per_month(F.col("salary_min"), unit, period),
            "salary_max_norm": yuan_per_month(F.col("salary_max"), unit, period),
        }
    ).withColumn("avg_salary", (F.col("salary_min_norm") + F.col("salary_max_norm")) / 2)


def add_skills(df: DataFrame) -> DataFrame:
    return df.withColumn("skills_list", skill_tokens(F.col("job_skills")))


def prepare_postings(df: DataFrame) -> DataFrame:
    """Experience, salary and skill columns of a posting: one projection."""
    return df.transform(add_experience).transform(add_salary).transform(add_skills)


def salary_sample(df: DataFrame) -> DataFrame:
    """Rows the salary analysis works on, cut to its columns.

    ``avg_salary`` is taken if present, else the mean of the raw or the
    normalised bounds; skills come from the merged column when there is one.
    """
    cols = set(df.columns)
    if "avg_salary" in cols:
        salary = F.col("avg_salary")
    elif {"salary_min", "salary_max"} <= cols:
        salary = (F.col("salary_min").cast("double") + F.col("salary_max").cast("double")) / 2
    elif {"salary_min_norm", "salary_max_norm"} <= cols:
        salary = (F.col("salary_min_norm") + F.col("salary_max_norm")) / 2
    else:
        raise ValueError("need avg_salary, or lower and upper salary columns")
    source = "merged_job_skills" if "merged_job_skills" in cols else "job_skills"
    # plain comparisons, so that they reach the file scan; NaN counts as missing
    kept = df.where(
        F.col("industry_group").isNotNull() & (salary > 0) & ~F.isnan(salary)
        & F.col("exp_numeric").isNotNull() & ~F.isnan("exp_numeric")
    )
    return kept.select(
        "job_id",
        "industry_group",
        salary.alias("avg_salary"),
        (F.col("exp_numeric") * 10.0).alias("exp_years"),
        skill_tokens(F.col(source)).alias("skills_list"),
    )
