"""Flows. Each takes and returns DataFrames; writing is left to ``jobweave.sources``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.functions.scalars import prepare_postings, salary_sample
from jobweave.functions.text import DEFAULT_RULES, TextRules, other_requirement
from jobweave.functions.vectors import half_split, weighted_features
from jobweave.operators import bundles, embedding, profiles, prompts, regression, robust, silhouette, warehouse
from jobweave.operators.kmeans import Settings
from jobweave.session import stage
from jobweave.sources.tables import save_table


def extract_requirements(
    raw: DataFrame,
    encode: embedding.Encoder | None = None,
    seeds: DataFrame | None = None,
    rules: TextRules = DEFAULT_RULES,
) -> DataFrame:
    """Raw postings with ``other_requirement``; with an encoder, open segments go to the nearest seed."""
    if encode is None:
        return raw.withColumn("other_requirement", other_requirement(F.col("job_description"), rules))
    seeds = seeds if seeds is not None else embedding.default_seeds(raw.sparkSession, encode)
    return embedding.add_other_requirement(raw, "job_description", encode, seeds, rules)


@dataclass
class JobVectors:
    jobs: DataFrame
    merge_preview: DataFrame


def build_job_vectors(
    postings: DataFrame,
    encode: embedding.Encoder,
    dims: int,
    lookup: DataFrame | None = None,
    lookup_dims: int | None = None,
    threshold: float = fv.MERGE_MIN_CORRELATION,
) -> JobVectors:
    """Postings to comparable numbers, merged skills and vectors, and the preview of the merges."""
    prepared = stage(prepare_postings(postings), "prepared")
    members = bundles.bundle_members(prepared.select("job_id", "industry_group", "skills_list"), threshold)
    merged = bundles.apply_merges(prepared, members)
    if lookup is not None:  # then it is read several times
        merged = stage(merged, "merged")
    jobs = embedding.vectorize(merged, encode, dims, lookup, lookup_dims)
    return JobVectors(jobs, bundles.merge_preview(members))


@dataclass
class Clusters:
    jobs: DataFrame
    profiles: DataFrame
    prompts: DataFrame


def cluster_jobs(jobs: DataFrame, settings: Settings | None = None, compat_half_split: bool = False) -> Clusters:
    """Cluster every industry with enough jobs and describe the clusters.

    ``compat_half_split`` cuts the flat vector into halves instead of using its
    skill and text segments; the two agree when both segments have one length.
    """
    segments = F.col("exp_numeric"), F.col("skill_vec"), F.col("other_vec")
    features = weighted_features(*(half_split(F.col("job_vec")) if compat_half_split else segments))
    points = jobs.where("industry_group is not null").select("industry_group", "job_id", features.alias("features"))
    assigned = silhouette.cluster_industries(stage(points, "features"), settings)
    slim = jobs.drop("skill_vec", "other_vec", "job_vec", "skills_list")
    clustered = slim.join(assigned.select("job_id", "cluster"), "job_id")
    clustered = profiles.staged_clusters(clustered)
    return Clusters(clustered, profiles.cluster_profiles(clustered), prompts.cluster_prompts(clustered))


@dataclass
class Salaries:
    skill_impact: DataFrame
    exp_curve: DataFrame
    skill_value_robust: DataFrame


def analyse_salaries(jobs: DataFrame) -> Salaries:
    """Regression for large industries, matched medians for medium ones."""
    sample = stage(salary_sample(jobs), "sample")
    rows, coefs = regression.fit_industries(sample)
    return Salaries(
        regression.skill_impact(rows, coefs), regression.exp_curve(coefs), robust.robust_skill_values(sample)
    )


def build_warehouse(jobs: DataFrame, users: DataFrame, events: DataFrame, static_source: DataFrame) -> dict[str, DataFrame]:
    """Source tables to the tables of the warehouse, by name; ``warehouse.key_figures`` reads them."""
    return {
        "job_feature_table": warehouse.job_features(jobs),
        "user_feature_table": warehouse.user_features(users),
        "interaction_table": warehouse.interactions(events),
        "report_static_source": static_source,
    }


def save_warehouse(built: dict[str, DataFrame], prefix: str = "", root: str | None = None) -> None:
    """Every table into the catalog (``prefix`` may name a database); below ``root`` they are external tables."""
    for name, rows in built.items():
        save_table(rows, f"{prefix}{name}", path=f"{root}/{name}" if root else None)
