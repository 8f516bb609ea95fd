"""Skill statistics: the job x skill matrix as a long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.functions.scalars import safe_base_name
from jobweave.operators.ordering import rank_rows, running_total
from jobweave.session import stage

KEY = "industry_group"


def job_skills(df: DataFrame) -> DataFrame:
    """One row per (job, distinct skill): times named and first position.

    De-duplication happens inside the row's own list, so this is a narrow
    projection: no shuffle, and no count-distinct later on.
    """
    skills = F.col("skills_list")
    entries = F.transform(
        F.array_distinct(skills),
        lambda s: F.struct(
            s.alias("skill"),
            F.size(F.filter(skills, lambda x: x == s)).alias("times"),
            F.array_position(skills, s).alias("pos"),
        ),
    )
    return (
        df.where("industry_group is not null")
        .select("industry_group", "job_id", F.explode(entries).alias("e"))
        .select("industry_group", "job_id", "e.skill", "e.times", "e.pos")
    )


def distinct_skills(df: DataFrame) -> DataFrame:
    """``job_skills`` without counts and positions."""
    return df.where("industry_group is not null").select(
        "industry_group", "job_id", F.explode(F.array_distinct("skills_list")).alias("skill")
    )


def skill_counts(tokens: DataFrame, min_tokens: int = 2, extra: Sequence[Column] = ()) -> DataFrame:
    """Token and job counts per (industry, skill), and where the skill first appears.

    A skill is kept from ``min_tokens`` tokens on, counted as tokens: one job
    naming a skill twice is enough. A skill is at most once per job in
    ``tokens``, so plain minima find its first appearance and the aggregate
    stays a hash aggregate when job ids are numbers.
    """
    return (
        tokens.groupBy("industry_group", "skill")
        .agg(
            F.sum("times").alias("token_cnt"),
            F.count(F.lit(1)).alias("job_cnt"),
            F.min("job_id").alias("first_job"),
            F.min_by("pos", "job_id").alias("first_pos"),
            *extra,
        )
        .where(F.col("token_cnt") >= min_tokens)
    )


def plain_counts(df: DataFrame, min_tokens: int = 2) -> DataFrame:
    """``skill_counts`` without first appearances, counted from the lists as they are.

    A token stands for its job where it is the first of its kind in the list.
    """
    first = F.array_position("skills_list", F.col("skill")) == F.col("at") + 1
    tokens = df.where("industry_group is not null").select("industry_group", "skills_list", F.posexplode("skills_list").alias("at", "skill"))
    counts = tokens.where("skill is not null").groupBy("industry_group", "skill")
    return counts.agg(F.count(F.lit(1)).alias("token_cnt"), F.count(F.when(first, 1)).alias("job_cnt")).where(F.col("token_cnt") >= min_tokens)


def wide_matrix(tokens: DataFrame, skills: list[str]) -> DataFrame:
    """0/1 columns for the named skills, one row per job that names any skill."""
    flags = [F.max(F.when(F.col("skill") == s, 1).otherwise(0)).alias(s) for s in skills]
    return tokens.groupBy("industry_group", "job_id").agg(*flags)


def industry_matrix(df: DataFrame, industry: str) -> DataFrame:
    """0/1 columns for every valid skill of one industry under its feature name, a row for every job of it.

    The skills are the columns of the result, so their names come to the driver.
    """
    mine = df.where(F.col("industry_group") == industry)
    tokens = job_skills(mine)
    counts = stage(skill_counts(tokens), "matrix-counts")
    named = stage(feature_names(counts), "matrix-names")
    listed = [r.feature for r in named.join(counts, ["industry_group", "skill"]).orderBy("first_job", "first_pos").select("feature").collect()]
    found = tokens.join(named, ["industry_group", "skill"]).groupBy("job_id").pivot("feature", listed).agg(F.lit(1))
    return mine.select("industry_group", "job_id").join(found, "job_id", "left").fillna(0, listed)


def industry_sizes(df: DataFrame, min_jobs: int = 1, max_jobs: int | None = None) -> DataFrame:
    """Jobs per industry within the bounds; staged, so Spark knows how small it is."""
    sizes = df.where("industry_group is not null").groupBy("industry_group").agg(F.count(F.lit(1)).alias("n_jobs"))
    sizes = sizes.where(F.col("n_jobs") >= min_jobs)
    if max_jobs is not None:
        sizes = sizes.where(F.col("n_jobs") <= max_jobs)
    return stage(sizes, "sizes")


def route_industries(sizes: DataFrame) -> DataFrame:
    """Which salary analysis an industry gets, by its size."""
    n = F.col("n_jobs")
    return sizes.withColumn(
        "route",
        F.when(n >= fv.REGRESSION_MIN_JOBS, "regression").when(n >= fv.ROBUST_MIN_JOBS, "robust").otherwise("none"),
    )


def skill_budgets(
    sizes: DataFrame, most: int = fv.SKILL_BUDGET_MAX, fewest: int = fv.SKILL_BUDGET_MIN
) -> DataFrame:
    """Skills allowed per regression industry: linear in the size rank, half-even."""
    eligible = sizes.where(F.col("n_jobs") >= fv.REGRESSION_MIN_JOBS)
    ranked = rank_rows(
        eligible.withColumns({"_all": F.lit(1), "_neg": -F.col("n_jobs")}), ["_all"], ["_neg", "industry_group"], "size_rank"
    )
    total = F.broadcast(eligible.agg(F.count(F.lit(1)).alias("_groups"), F.lit(1).alias("_all")))  # one row
    step = F.lit(float(fewest - most)) / (F.col("_groups") - 1)
    budget = F.when(F.col("_groups") == 1, float(most)).otherwise((F.col("size_rank") - 1) * step + float(most))
    clipped = F.greatest(F.lit(fewest), F.least(F.lit(most), F.rint(budget).cast("int")))
    return ranked.join(total, "_all").select("industry_group", "n_jobs", "size_rank", clipped.alias("skill_budget"))


def feature_names(counts: DataFrame) -> DataFrame:
    """Unique formula-safe names: in order of appearance, a taken name is its base with the first free of _1, _2, ...

    Skills of one base take rising places in "base, base_1, base_2, ...": the rank among them plus the places that
    are passed over. Only one other skill can want the name of a place, the first one whose own base reads like it
    (``x_1`` beside ``x``), and of the two the one that appears first has it. Who reaches a contested place depends
    on the contested places before it, so all are decided at once, by joins, and decided again until nothing changes.
    Ranks are taken over range partitions, so all skills of an industry may share one base.
    """
    order = F.struct("first_job", "first_pos", "skill")
    based = counts.select(KEY, "first_job", "first_pos", "skill", safe_base_name(F.col("skill")).alias("base"))
    ranked = rank_rows(based, [KEY, "base"], ["first_job", "first_pos", "skill"])
    items = stage(ranked.select(KEY, "skill", order.alias("order"), "base", (F.col("rank") - 1).alias("place")), "bases")
    first = items.where("place = 0").select(KEY, "base", "order")
    number = F.regexp_extract("base", r"_([1-9][0-9]*)$", 1)
    contested = (
        first.select(KEY, F.col("base").alias("rival"), F.col("order").alias("first"), number.alias("digits"))
        .withColumns({"place": F.col("digits").try_cast("long"), "base": F.expr("substring(rival, 1, length(rival) - length(digits) - 1)")})
        .where("place is not null").drop("digits").join(first.select(KEY, "base"), [KEY, "base"], "left_semi")
    )
    contested = stage(contested, "contested")
    passed = contested.select(KEY, "base", "place").limit(0)
    while True:
        before = _passed_before(contested, passed).withColumn("rank", F.col("place") - F.col("passed"))
        reached = before.join(items.select(KEY, "base", F.col("place").alias("rank"), "order"), [KEY, "base", "rank"])
        rival_first = F.col("first") < F.col("order")
        decided = reached.select(
            KEY, F.when(rival_first, F.col("base")).otherwise(F.col("rival")).alias("base"), F.when(rival_first, F.col("place")).otherwise(0).alias("place")
        )
        decided = stage(decided, "passed")
        keys = [KEY, "base", "place"]
        changed = decided.join(passed, keys, "left_anti").unionByName(passed.join(decided, keys, "left_anti"))
        passed = decided
        if changed.isEmpty():
            break
    if not passed.isEmpty():
        # the i-th passed place k moves all skills from rank k - i + 1 on
        moves = rank_rows(passed, [KEY, "base"], ["place"], "i").select(KEY, "base", (F.col("place") - F.col("i")).alias("place"), "i")
        items = _passed_before(items, moves).withColumn("place", F.col("place") + F.col("passed"))
    name = F.when(F.col("place") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("place").cast("string")))
    return items.select(KEY, "skill", name.alias("feature"))


def _passed_before(rows: DataFrame, passed: DataFrame) -> DataFrame:
    """Add ``passed``: how many of the ``passed`` places of the row's base lie before its ``place``."""
    touched = passed.select(KEY, "base").distinct()
    mine = rows.join(touched, [KEY, "base"], "left_semi").withColumns({"kind": F.lit(0), "i": F.lit(0).cast("long")})
    events = passed.withColumn("kind", F.lit(1))
    both = mine.unionByName(events, allowMissingColumns=True)
    both = both.withColumn("i", F.coalesce("i", F.lit(0).cast("long")))
    counted = running_total(both, [KEY, "base"], ["place", "kind", "i"], F.col("kind"), "passed").where("kind = 0").drop("kind", "i")
    return counted.unionByName(rows.join(touched, [KEY, "base"], "left_anti").withColumn("passed", F.lit(0).cast("long")))
