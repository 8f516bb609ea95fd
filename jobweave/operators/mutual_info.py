"""Mutual information of a has-the-skill flag with salary, by nearest neighbours.

The estimator is the published one for a discrete and a continuous variable
(B. C. Ross, PLoS ONE 2014). For a row whose label occurs c times: k = min(3,
c - 1), d is the distance to the k-th nearest row with the same label, and m
counts the rows of the industry nearer than d, the row itself included. Then

    MI = psi(N) + mean psi(k) - mean psi(c) - mean psi(m), floored at 0.

Taken literally that is (rows x skills) work, nearly all of it for rows that
lack the skill. But such a row only feels a skill that occurs among its three
neighbours on either side; otherwise its m is the one it has with labels
ignored, computed once. So the work here is proportional to the tokens.

Rows are ranked by salary and cut into blocks of consecutive ranks, which also see ``REACH``
rows on either side. A task answers for all skills of its block and returns a sum per skill.
A row whose d reaches beyond what its block sees (rare skills) is answered by joins, with ranks
and counts from distributed running totals. Industries whose job ids repeat or are missing,
where joins count every copy, or whose ticks are too wide for a long, go that way whole.
No industry and no skill is ever gathered into one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions import fixed_values as fv
from jobweave.operators.ordering import own_block, rank_block, rank_rows, running_total, top_rows, with_blocks, with_neighbours
from jobweave.operators.skills import distinct_skills, job_skills, skill_counts
from jobweave.session import stage

KEY = "industry_group"
TIE_BITS = 20
REACH = 512  # rows beyond either end of a block that its task sees
MOST_SALARY = 4e10  # below it, ticks and their differences are longs
FAR = np.iinfo(np.int64).max


def digamma(n: Column) -> Column:
    """psi(n) for n >= 1: recurrence up by ten, then the asymptotic series."""
    n = n.cast("double")
    x = n + 10.0
    series = F.log(x) - 1.0 / (2.0 * x) - 1.0 / (12.0 * x**2) + 1.0 / (120.0 * x**4) - 1.0 / (252.0 * x**6)
    below = 1.0 / n
    for i in range(1, 10):
        below = below + 1.0 / (n + float(i))
    return series - below


def salary_ticks(salary: Column, job_id: Column) -> Column:
    """Salary in whole cents, with ties broken by a hash of the job below one cent; wide enough for any wrong salary."""
    tie = F.conv(F.substring(F.md5(job_id.cast("string")), 1, TIE_BITS // 4), 16, 10).cast("long")
    cents = F.round(salary * 100).cast("decimal(27,0)")
    return (cents * F.lit(1 << TIE_BITS).cast("decimal(7,0)") + tie).cast("decimal(38,0)")


def _with_gaps(ranked: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Add ``gaps``: sorted distances to the rows up to three ranks away, itself (0) first."""
    near = with_neighbours(ranked, keys, rank, "ticks", fv.NEIGHBOURS, "_near")
    return near.withColumn("gaps", F.array_sort(F.transform("_near", lambda t: F.abs(t - F.col("ticks"))))).drop("_near")


def ranked_salaries(sample: DataFrame) -> DataFrame:
    """(industry_group, job_id, ticks, at, base_m): rank in the industry and m with labels ignored."""
    rows = sample.select(KEY, "job_id", salary_ticks(F.col("avg_salary"), F.col("job_id")).alias("ticks"))
    near = _with_gaps(rank_rows(rows, [KEY], ["ticks", "job_id"], "at"), [KEY], "at")
    radius = F.col("gaps")[F.least(F.lit(fv.NEIGHBOURS), F.size("gaps") - 1)]
    base = F.greatest(F.lit(1), F.size(F.filter("gaps", lambda g: g < radius)))
    return stage(near.select(KEY, "job_id", "ticks", "at", base.alias("base_m")), "salaries")


def _rows_felt(ones: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that carry a skill (reach 0) and rows near one, with the rank distance to it.

    Rows up to three ranks away need their own m; rows up to six away can be
    among the same-label neighbours of those. A skill whose ``lacks`` is false gets its carriers only.
    """
    far = 2 * fv.NEIGHBOURS
    window = Window.partitionBy(KEY, "skill", "_block").orderBy("at")
    p, before, after = F.col("at"), F.col("_before"), F.col("_after")

    def reached(x, reach):
        return F.struct(x.alias("at"), reach.cast("long").alias("reach"))

    # each row is listed once: by the carrier before it if that is near, else by the one after it
    to_right = F.filter(F.sequence(p + 1, p + far), lambda x: after.isNull() | (x < after))
    to_left = F.filter(F.sequence(p - far, p - 1), lambda x: before.isNull() | (x > before + far))
    carrier = F.array(reached(p, F.lit(0)))
    listed = F.concat(
        carrier,
        F.transform(to_right, lambda x: reached(x, F.least(x - p, F.coalesce(after - x, x - p)))),
        F.transform(to_left, lambda x: reached(x, p - x)),
    )
    return (
        with_blocks(ones, "at", 2 * far)
        .withColumns({"_before": F.lag("at").over(window), "_after": F.lead("at").over(window)})
        .where(own_block("at"))
        .select(KEY, "skill", F.explode(F.when(F.col("lacks"), listed).otherwise(carrier)).alias("x"))
        .select(KEY, "skill", "x.at", "x.reach")
        .join(rows.drop("job_id"), [KEY, "at"])
        .withColumn("has_skill", F.col("reach") == 0)
    )


def _rows_within(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """m per query: rows of the industry with |ticks - t| < radius, as a difference of two running counts."""
    ids = [KEY, "skill", "at"]
    ends = queries.select(
        *ids,
        F.explode(
            F.array(
                F.struct((F.col("ticks") + F.col("radius") - 1).alias("tick"), F.lit(1).alias("sign")),
                F.struct((F.col("ticks") - F.col("radius")).alias("tick"), F.lit(-1).alias("sign")),
            )
        ).alias("e"),
    ).select(*ids, "e.tick", "e.sign")
    points = rows.select(KEY, F.lit("").alias("skill"), "at", F.col("ticks").alias("tick"), F.lit(0).alias("sign"))
    counted = running_total(
        points.withColumn("asks", F.lit(0)).unionByName(ends.withColumn("asks", F.lit(1))),
        [KEY],
        ["tick", "asks", "skill", "at", "sign"],
        1 - F.col("asks"),
        "below",
    )
    m = F.greatest(F.lit(1), F.sum(F.col("below") * F.col("sign")))
    return counted.where("asks = 1").groupBy(*ids).agg(m.alias("m"))


def _asked(felt: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows that need their own m, with ``radius``, the distance to the k-th nearest row of their label."""
    ranked = rank_rows(felt, [KEY, "skill", "has_skill"], ["at"], "nth", rank_block("at"))
    near = _with_gaps(ranked, [KEY, "skill", "has_skill"], "nth")
    near = near.where(F.col("reach") <= fv.NEIGHBOURS).join(counts.select(KEY, "skill", "n1", "n0"), [KEY, "skill"])
    c = F.when(F.col("has_skill"), F.col("n1")).otherwise(F.col("n0"))
    label_k = F.least(F.lit(fv.NEIGHBOURS), c - 1).cast("int")
    return near.withColumns({"radius": F.get("gaps", label_k), "label_rows": c}).drop("gaps")


def _own_psi(asked: DataFrame, rows: DataFrame) -> DataFrame:
    return _rows_within(asked.where("label_rows > 1"), rows).groupBy(KEY, "skill").agg(F.sum(digamma(F.col("m"))).alias("own_psi"))


def _sums_by_joins(sample: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(industry_group, skill, base_psi, own_psi) and (industry_group, all_psi): sums of psi(m) over rows that feel a skill, and over all."""
    rows = ranked_salaries(sample)
    ones = (
        distinct_skills(sample)
        .join(counts.select(KEY, "skill"), [KEY, "skill"], "left_semi")
        .join(rows.select(KEY, "job_id", "at"), [KEY, "job_id"])
    )
    near = stage(_asked(_rows_felt(ones.withColumn("lacks", F.lit(True)), rows), counts), "mi-near")
    replaced = near.groupBy(KEY, "skill").agg(F.sum(digamma(F.col("base_m"))).alias("base_psi"))
    total = rows.groupBy(KEY).agg(F.sum(digamma(F.col("base_m"))).alias("all_psi"))
    return replaced.join(_own_psi(near, rows), [KEY, "skill"], "left"), total


def _sums_by_blocks(sample: DataFrame, sizes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_sums_by_joins`` for industries whose job ids are unique, by blocks of ranks."""
    ticks = salary_ticks(F.col("avg_salary"), F.col("job_id")).cast("long").alias("ticks")
    listed = sample.select(KEY, "job_id", ticks, F.array_distinct("skills_list").alias("skills"))
    rows = rank_rows(listed, [KEY], ["ticks", "job_id"], "at").drop("job_id")
    blocks = with_blocks(rows.join(sizes.select(KEY, "n_jobs"), KEY), "at", REACH).withColumn("own", own_block("at"))
    found = blocks.groupBy(KEY, "_block").applyInArrow(
        _block_sums, f"{KEY} string, skill string, at long, has_skill boolean, base_psi double, own_psi double"
    )
    found = stage(found, "mi-blocks")
    total = found.where("skill is null").groupBy(KEY).agg(F.sum("base_psi").alias("all_psi"))
    sums = found.where("skill is not null and at is null").select(KEY, "skill", "base_psi", "own_psi")
    far = found.where("at is not null").select(KEY, "skill", "at", "has_skill")
    if not far.isEmpty():
        pairs = stage(far.groupBy(KEY, "skill").agg(F.max(~F.col("has_skill")).alias("lacks")), "mi-far")
        ones = rows.select(KEY, "at", F.explode("skills").alias("skill")).join(pairs, [KEY, "skill"])
        places = rows.join(pairs.select(KEY).distinct(), KEY, "left_semi").select(KEY, "at", "ticks")
        asked = stage(_asked(_rows_felt(ones, places), counts).join(far, [KEY, "skill", "at", "has_skill"], "left_semi"), "mi-near")
        own = _own_psi(asked, places).select(KEY, "skill", F.lit(0.0).alias("base_psi"), "own_psi")
        sums = sums.unionByName(own)
    return sums.groupBy(KEY, "skill").agg(F.sum("base_psi").alias("base_psi"), F.sum("own_psi").alias("own_psi")), total


def _psi(n: np.ndarray) -> np.ndarray:
    """``digamma`` of whole numbers from 1 on."""
    n = n.astype(float)
    x = n + 10.0
    series = np.log(x) - 1.0 / (2.0 * x) - 1.0 / (12.0 * x**2) + 1.0 / (120.0 * x**4) - 1.0 / (252.0 * x**6)
    return series - sum(1.0 / (n + i) for i in range(10))


def _nearest(gaps: np.ndarray, label_rows: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the k-th nearest row of the label (-1 if it has one row), and whether enough rows are seen to know it."""
    k = np.minimum(fv.NEIGHBOURS, label_rows - 1)
    radius = np.where(k > 0, np.sort(gaps, axis=1)[np.arange(len(gaps)), np.maximum(k - 1, 0)], -1)
    return radius, (k == fv.NEIGHBOURS) | whole


def _block_sums(table: pa.Table) -> pa.Table:
    """Sums of a block of ranks: one row without a skill for all its rows, one per skill, and the rows that need more than it sees (``at``)."""
    table = table.sort_by("at")
    at, ticks, own = (table[c].to_numpy() for c in ("at", "ticks", "own"))
    n, steps = len(at), [i for i in range(-fv.NEIGHBOURS, fv.NEIGHBOURS + 1) if i]
    first, last = at[0] == 1, at[-1] == table["n_jobs"][0].as_py()
    line = np.arange(n)

    def gap(to: np.ndarray, start: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.where(valid, np.abs(ticks[np.where(valid, to, 0)] - ticks[start]), FAR)

    # m with labels ignored
    gaps = np.stack([gap(line + i, line, (line + i >= 0) & (line + i < n)) for i in steps], axis=1)
    seen = (gaps < FAR).sum(1)
    radius = np.where(seen > 0, np.sort(gaps, axis=1)[line, np.clip(seen, 1, fv.NEIGHBOURS) - 1], 0)
    base = _psi(np.maximum(1, (gaps < radius[:, None]).sum(1) + (radius > 0)))

    # carriers by skill and place; ``start`` and ``held`` are a skill's first carrier and their number
    lists = table["skills"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    skill, place = codes[order].astype(np.int64), np.repeat(line, lists.value_lengths().fill_null(0).to_numpy())[order]
    held = np.bincount(skill, minlength=len(names))
    start = np.cumsum(held) - held
    nth = np.arange(len(skill)) - start[skill]
    keys, moved = skill * n + place, skill * (n + 1) + place - nth

    # rows with the skill: their neighbours are the carriers beside them
    mine = np.flatnonzero(own[place])
    to = [np.clip(mine + i, 0, max(len(skill) - 1, 0)) for i in steps]
    valid = [(nth[mine] + i >= 0) & (nth[mine] + i < held[skill[mine]]) for i in steps]
    with_gaps = [gap(place[j], place[mine], v) for j, v in zip(to, valid)]

    # rows without it, at most three ranks from a carrier: the r-th of them is r places and the carriers before it away
    around = [keys[(place + i >= 0) & (place + i < n)] + i for i in steps]
    near = np.unique(np.concatenate(around))
    near = near[own[near % n]]
    before = np.searchsorted(keys, near)
    lacks = before == len(keys)
    lacks[~lacks] = keys[before[~lacks]] != near[~lacks]
    near, before = near[lacks], before[lacks]
    s, x = near // n, near % n
    rank = x - (before - start[s])
    without_gaps = []
    for i in steps:
        place_of = rank + i + np.searchsorted(moved, s * (n + 1) + np.maximum(rank + i, 0), side="right") - start[s]
        without_gaps.append(gap(place_of, x, (rank + i >= 0) & (rank + i < n - held[s])))

    who, where = np.concatenate([skill[mine], s]), np.concatenate([place[mine], x])
    label_rows = np.concatenate([held[skill[mine]], n - held[s]])
    gaps = np.stack([np.concatenate(pair) for pair in zip(with_gaps, without_gaps)], axis=1)
    radius, known = _nearest(gaps, label_rows, first and last)
    t = ticks[where]
    reach = np.where(known, radius, 0)
    known &= (first | (t - reach >= ticks[0])) & (last | (t + reach <= ticks[-1]))
    m = np.maximum(1, np.searchsorted(ticks, t + reach, side="left") - np.searchsorted(ticks, t - reach, side="right"))
    own_psi = np.bincount(who, np.where(known & (radius >= 0), _psi(m), 0.0), len(names))
    base_psi = np.bincount(who, base[where], len(names))
    felt, open_rows = np.unique(who), np.flatnonzero(~known)
    size, more = len(felt), len(open_rows)
    listed = pa.array(np.concatenate([felt, who[open_rows]]), pa.int64())
    return pa.table(
        {
            KEY: pa.repeat(table[KEY][0], 1 + size + more).cast(pa.string()),
            "skill": pa.concat_arrays([pa.nulls(1, pa.string()), names.take(listed).cast(pa.string())]),
            "at": pa.concat_arrays([pa.nulls(1 + size, pa.int64()), pa.array(at[where[open_rows]], pa.int64())]),
            "has_skill": pa.concat_arrays([pa.nulls(1 + size, pa.bool_()), pa.array(open_rows < len(mine), pa.bool_())]),
            "base_psi": pa.concat_arrays([pa.array([base[own].sum()], pa.float64()), pa.array(base_psi[felt], pa.float64()), pa.nulls(more, pa.float64())]),
            "own_psi": pa.concat_arrays([pa.nulls(1, pa.float64()), pa.array(own_psi[felt], pa.float64()), pa.nulls(more, pa.float64())]),
        }
    )


def mutual_information(sample: DataFrame, sizes: DataFrame) -> DataFrame:
    """(industry_group, skill, first_job, first_pos, mi) for every valid skill.

    ``sample`` holds the jobs of the industries in ``sizes`` and no others; it
    is read several times, so it should be a stored table.
    """
    k = fv.NEIGHBOURS
    counts = skill_counts(job_skills(sample)).join(sizes, KEY).select(
        KEY, "skill", "first_job", "first_pos", F.col("job_cnt").alias("n1"), (F.col("n_jobs") - F.col("job_cnt")).alias("n0")
    )
    counts = stage(counts, "mi-counts")
    repeated = F.count(F.lit(1)) > F.count_distinct("job_id")
    odd = stage(sample.groupBy(KEY).agg((repeated | (F.max("avg_salary") >= MOST_SALARY)).alias("odd")).where("odd").select(KEY), "odd")
    if odd.isEmpty():
        sums, total = _sums_by_blocks(sample, sizes, counts)
    else:
        sums, total = _sums_by_blocks(sample.join(odd, KEY, "left_anti"), sizes, counts)
        other = _sums_by_joins(sample.join(odd, KEY, "left_semi"), counts.join(odd, KEY, "left_semi"))
        sums, total = sums.unionByName(other[0]), total.unionByName(other[1])

    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    use1, use0 = n1 > 1, n0 > 1
    n = F.when(use1, n1).otherwise(0.0) + F.when(use0, n0).otherwise(0.0)

    def both(value):
        return F.when(use1, n1 * value(n1)).otherwise(0.0) + F.when(use0, n0 * value(n0)).otherwise(0.0)

    sum_m = F.coalesce("own_psi", F.lit(0.0)) + F.when(use0, F.col("all_psi") - F.col("base_psi")).otherwise(0.0)
    mi = digamma(n) + (
        both(lambda x: digamma(F.least(F.lit(float(k)), x - 1))) - both(digamma) - sum_m
    ) / n
    return (
        counts.join(sums, [KEY, "skill"])
        .join(total, KEY)
        .select(KEY, "skill", "first_job", "first_pos", F.greatest(F.lit(0.0), F.round(mi, 10)).alias("mi"))
    )


def select_skills(scores: DataFrame, budgets: DataFrame) -> DataFrame:
    """Best-scored skills of each industry, as many as its budget allows; ties by first appearance."""
    order = [F.desc("mi"), F.asc("first_job"), F.asc("first_pos")]
    most = budgets.agg(F.max("skill_budget")).first()[0] or 0
    ranked = top_rows(scores.join(budgets.select(KEY, "skill_budget"), KEY), [KEY], order, most)
    return ranked.where(F.col("rank") <= F.col("skill_budget")).select(KEY, "skill", "mi", "rank")
