"""Salary regression of all large industries at once.

An industry is fitted alone, and its random-effect columns are also fixed
columns, so the mixed model's coefficients and skill standard errors equal
those of least squares (SURVEY 4.4). What least squares needs of the data is
the table of feature products, at most about 22 x 22 numbers per industry:
Spark sums it, and only that small table is solved in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.operators.mutual_info import mutual_information, select_skills
from jobweave.operators.ordering import top_rows
from jobweave.operators.skew import join_one
from jobweave.operators.skills import industry_sizes, job_skills, skill_budgets
from jobweave.session import stage

KEY = "industry_group"
JOB = [KEY, "job_id"]
FEATURES = "array<struct<f:string,v:double>>"
HELD_PRODUCTS = 4 << 20  # sums of products a task holds before it sends them


# --- leftover skills as context ---------------------------------------------------


def leftover_terms(tokens: DataFrame, selected: DataFrame) -> DataFrame:
    """Words of the skills that were not selected: (industry_group, job_id, term, tf)."""
    left = tokens.join(selected.select(KEY, "skill"), [KEY, "skill"], "left_anti")
    words = left.select(*JOB, "times", F.explode(F.split("skill", " +")).alias("term")).where("term <> ''")
    return words.groupBy(*JOB, "term").agg(F.sum("times").alias("tf"))


def term_weights(terms: DataFrame, sizes: DataFrame, max_terms: int = fv.TFIDF_MAX_TERMS) -> DataFrame:
    """The most frequent terms of each industry with their smoothed idf."""
    totals = terms.groupBy(KEY, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = top_rows(totals, [KEY], [F.desc("total"), F.asc("term")], max_terms)
    idf = F.log((1.0 + F.col("n_jobs")) / (1.0 + F.col("df"))) + 1.0
    return stage(kept.join(sizes, KEY).select(KEY, "term", idf.alias("idf"), F.col("df").alias("n_with_term")), "terms")


def tfidf_rows(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """One unit vector per job, sparse: (industry_group, job_id, vec: array of (f, v))."""
    weighted = join_one(terms, weights, [KEY, "term"], "n_with_term").select(
        *JOB, F.struct(F.col("term").alias("f"), (F.col("tf") * F.col("idf")).alias("v")).alias("x")
    )
    rows = weighted.groupBy(*JOB).agg(F.collect_list("x").alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e["v"] * e["v"]))
    scaled = F.transform(
        F.array(length),
        lambda n: F.transform("x", lambda e: F.struct(e["f"].alias("f"), (e["v"] / n).alias("v"))),
    )[0]
    return rows.select(*JOB, scaled.alias("vec"))


def gram(rows: DataFrame, column: str) -> DataFrame:
    """Sums of products of features over the jobs of an industry: (industry_group, f, g, s), f <= g.

    A task adds up the products of its rows as one small matrix per industry; only those are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Products] = {}
        for batch in batches:
            lists = batch.column(column)
            flat, industries = lists.flatten(), batch.column(KEY).dictionary_encode()
            coded, v = flat.field("f").dictionary_encode(), flat.field("v").to_numpy(zero_copy_only=False)
            names, features = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            owner = industries.indices.to_numpy()[row]
            order = np.argsort(owner, kind="stable")
            found, starts = np.unique(owner[order], return_index=True)
            for code, at in zip(found, np.split(order, starts[1:])):
                held.setdefault(industries.dictionary[int(code)].as_py(), Products()).add(row[at], features[at], v[at], names)
            if sum(len(p.at) ** 2 for p in held.values()) > HELD_PRODUCTS:
                yield from (p.batch(name) for name, p in held.items())
                held = {}
        yield from (p.batch(name) for name, p in held.items())

    partial = rows.select(KEY, column).mapInArrow(run, f"{KEY} string, f string, g string, s double")
    return partial.groupBy(KEY, "f", "g").agg(F.sum("s").alias("s"))


class Products:
    """Sums of products of an industry's features in one task, and how many rows have both."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.sums, self.times = np.zeros((0, 0)), np.zeros((0, 0))

    def add(self, row: np.ndarray, feature: np.ndarray, v: np.ndarray, names: list[str]) -> None:
        rows, r = np.unique(row, return_inverse=True)
        mine, f = np.unique(feature, return_inverse=True)
        x = np.bincount(r * len(mine) + f, v, len(rows) * len(mine)).reshape(len(rows), len(mine))
        has = (np.bincount(r * len(mine) + f, minlength=x.size) > 0).astype(float).reshape(x.shape)
        to = np.array([self.at.setdefault(names[i], len(self.at)) for i in mine])
        more = len(self.at) - len(self.sums)
        if more:
            self.sums, self.times = (np.pad(m, (0, more)) for m in (self.sums, self.times))
        self.sums[np.ix_(to, to)] += x.T @ x
        self.times[np.ix_(to, to)] += has.T @ has

    def batch(self, industry: str) -> pa.RecordBatch:
        names = sorted(self.at)
        place = np.array([self.at[name] for name in names])
        f, g = np.nonzero(np.triu(self.times[np.ix_(place, place)]))
        listed = pa.array(names, pa.string())
        return pa.RecordBatch.from_pydict(
            {KEY: pa.repeat(pa.scalar(industry, pa.string()), len(f)), "f": listed.take(pa.array(f)), "g": listed.take(pa.array(g)), "s": self.sums[place[f], place[g]]}
        )


def _square(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf["f"]) | set(pdf["g"]))
    at = {name: i for i, name in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    i, j = pdf["f"].map(at).to_numpy(), pdf["g"].map(at).to_numpy()
    out[i, j] = pdf["s"]
    out[j, i] = pdf["s"]
    return names, out


def residual_context(rows: DataFrame, parts: int = fv.SVD_COMPONENTS) -> DataFrame:
    """Coordinates of each job on the leading singular directions of its industry's terms.

    The directions come from the term products, at most 200 x 200 per industry.
    Signs are fixed by the largest entry, since they are otherwise arbitrary.
    """

    def directions(pdf: pd.DataFrame) -> pd.DataFrame:
        names, square = _square(pdf)
        _, vectors = np.linalg.eigh(square)
        lead = vectors[:, ::-1][:, :parts]
        lead = lead * np.where(lead[np.abs(lead).argmax(0), np.arange(lead.shape[1])] < 0, -1.0, 1.0)
        lead = np.hstack([lead, np.zeros((len(names), parts - lead.shape[1]))])
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "f": names, "d": list(lead)})

    rows = stage(rows, "tfidf")  # read for the directions and for the coordinates
    axes = gram(rows, "vec").groupBy(KEY).applyInPandas(directions, f"{KEY} string, f string, d array<double>")
    axes = stage(axes, "axes")
    sums = [F.sum(F.col("x.v") * F.col("d")[i]).alias(f"residual_context_{i + 1}") for i in range(parts)]
    exploded = rows.select(*JOB, F.explode("vec").alias("x"))
    return exploded.join(axes, (exploded[KEY] == axes[KEY]) & (F.col("x.f") == axes["f"])).groupBy(
        exploded[KEY], exploded["job_id"]
    ).agg(*sums)


# --- least squares ---------------------------------------------------------------


def design_rows(sample: DataFrame, tokens: DataFrame, selected: DataFrame, context: DataFrame | None) -> DataFrame:
    """(industry_group, job_id, y, feats): intercept, experience terms, skills, context; zeros left out."""
    skills = (
        tokens.join(selected.select(KEY, "skill"), [KEY, "skill"])
        .groupBy(*JOB)
        .agg(F.collect_list(F.struct(F.concat(F.lit("skill:"), F.col("skill")).alias("f"), F.lit(1.0).alias("v"))).alias("_skills"))
    )

    def part(name, value):
        return F.struct(F.lit(name).alias("f"), value.alias("v"))

    years = F.col("exp_years")
    always = [part("intercept", F.lit(1.0)), part("exp", years), part("exp_smooth", F.pow(years, fv.EXPERIENCE_POWER))]
    rows = sample.join(skills, JOB, "left")
    if context is not None:
        rows = rows.join(context, JOB, "left")
        always += [
            part(c, F.coalesce(F.col(c), F.lit(0.0))) for c in context.columns if c.startswith("residual_context_")
        ]
    feats = F.concat(F.array(*always), F.coalesce("_skills", F.array().cast(FEATURES)))
    return rows.select(*JOB, F.col("avg_salary").alias("y"), feats.alias("feats"))


def moments(rows: DataFrame) -> DataFrame:
    """Feature products with the salary as one more feature named ``y``."""
    with_y = F.concat("feats", F.array(F.struct(F.lit("y").alias("f"), F.col("y").alias("v"))))
    return gram(rows.select(KEY, with_y.alias("feats")), "feats")


def solve(products: DataFrame) -> DataFrame:
    """(industry_group, f, coef, spread, model_rank): least squares per industry from its products.

    A feature that never varies from zero gets coefficient 0 through the pseudo-inverse.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, square = _square(pdf)
        y = names.index("y")
        keep = [i for i in range(len(names)) if i != y]
        a, b = square[np.ix_(keep, keep)], square[keep, y]
        scale = np.sqrt(np.diag(a))
        scale[scale == 0] = 1.0
        values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
        good = values > values.max() * 1e-12
        inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T / np.outer(scale, scale)
        return pd.DataFrame(
            {
                KEY: pdf[KEY].iloc[0],
                "f": [names[i] for i in keep],
                "coef": inverse @ b,
                "spread": np.diag(inverse),
                "model_rank": int(good.sum()),
            }
        )

    schema = f"{KEY} string, f string, coef double, spread double, model_rank int"
    return stage(products.groupBy(KEY).applyInPandas(fit, schema), "coefficients")


def residual_variance(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """Jobs and residual variance per industry, from residuals of the rows themselves."""
    table = coefs.groupBy(KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("f", "coef"))).alias("_coef"), F.max("model_rank").alias("_rank")
    )
    fitted = F.aggregate("feats", F.lit(0.0), lambda s, x: s + x["v"] * F.coalesce(F.col("_coef")[x["f"]], F.lit(0.0)))
    return (
        rows.join(stage(table, "coefficient-maps"), KEY)
        .groupBy(KEY, "_rank")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.pow(F.col("y") - fitted, F.lit(2.0))).alias("_rss"))
        .select(KEY, "n_samples", (F.col("_rss") / F.nullif(F.col("n_samples") - F.col("_rank"), F.lit(0))).alias("variance"))
    )


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to about 13 digits: its power series below 2, its continued fraction above."""

    def of(v: Column) -> Column:
        scale = F.exp(-v * v) / F.sqrt(F.pi())
        start = F.struct(v.alias("term"), v.alias("total"))

        def add(s: Column, n: Column) -> Column:
            term = s["term"] * 2.0 * v * v / (2 * n + 1)
            return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add)["total"]
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, n: n / 2.0 / (v + t))
        return F.when(v < 2.0, 1.0 - 2.0 * scale * series).otherwise(scale / (v + fraction))

    return F.transform(F.array(x), of)[0]


def skill_impact(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """Coefficient, standard error, normal p-value and 95 % interval of every selected skill."""
    skills = coefs.where("f like 'skill:%'").join(residual_variance(rows, coefs), KEY)
    se = F.sqrt(F.col("variance") * F.col("spread"))
    return skills.select(
        KEY,
        F.substring("f", 7, 1 << 30).alias("skill"),
        F.lit(fv.SELECTION_METHOD).alias("selection_method"),
        F.col("coef").alias("coefficient"),
        se.alias("std_err"),
        erfc(F.abs(F.col("coef") / F.nullif(se, F.lit(0.0))) / F.sqrt(F.lit(2.0))).alias("p_value"),
        (F.col("coef") - 1.96 * se).alias("ci_lower"),
        (F.col("coef") + 1.96 * se).alias("ci_upper"),
        "n_samples",
    )


def exp_curve(coefs: DataFrame, last_year: int = fv.CURVE_YEARS) -> DataFrame:
    """Predicted salary at 0, 1, ... years with everything else at zero."""
    b = {name: F.max(F.when(F.col("f") == name, F.col("coef"))) for name in ("intercept", "exp", "exp_smooth")}
    base = coefs.groupBy(KEY).agg(*[v.alias(k) for k, v in b.items()])
    year = F.col("years_experience")
    years = F.sequence(F.lit(0), F.lit(last_year)).cast("array<double>")
    return base.withColumn("years_experience", F.explode(years)).select(
        KEY,
        "years_experience",
        (
            F.col("intercept")
            + F.coalesce("exp", F.lit(0.0)) * year
            + F.coalesce("exp_smooth", F.lit(0.0)) * F.pow(year, fv.EXPERIENCE_POWER)
        ).alias("predicted_salary"),
    )


def fit_industries(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(design rows, coefficients) of all industries large enough for regression."""
    sizes = industry_sizes(sample, fv.REGRESSION_MIN_JOBS)
    large = stage(sample.join(sizes.select(KEY), KEY, "left_semi"), "regression-sample")
    tokens = job_skills(large)
    selected = stage(select_skills(mutual_information(large, sizes), skill_budgets(sizes)), "selected")
    # an industry with no skill to select is not fitted
    large = large.join(selected.select(KEY).distinct(), KEY, "left_semi")
    terms = stage(leftover_terms(tokens, selected), "leftover")
    context = residual_context(tfidf_rows(terms, term_weights(terms, sizes)))
    rows = stage(design_rows(large, tokens, selected, context), "design")
    return rows, solve(moments(rows))
