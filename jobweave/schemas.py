"""Table schemas. Reading never infers types."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_POSTING = strings(
    "job_id", "job_title", "job_description", "industry_group", "job_skills", "experience_required",
    "education_required", "salary_min", "salary_max", "salary_unit", "salary_period",
)

POSTING = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        *strings("industry_group", "job_title", "job_skills", "other_requirement", "experience_required",
                 "education_required", "salary_unit", "salary_period").fields,
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
    ]
)

REPLY_CACHE = T.StructType(
    [
        *strings("cache_key", "profile_name").fields,
        T.StructField("other_requirements", T.ArrayType(T.StringType())),
    ]
)
