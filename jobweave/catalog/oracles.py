"""SQL that computes the same results as the registered queries, for checking."""

from __future__ import annotations

from jobweave.catalog.views import LATIN, POSTINGS_SQL
from jobweave.functions import fixed_values as fv
from jobweave.functions.text import WHITE
from jobweave.operators import prompts

ORACLES: dict[str, str] = {}

PREP = f"""WITH RECURSIVE {POSTINGS_SQL},
scored AS (
  SELECT *, trim(coalesce(experience_required, '')) AS t,
    (CASE trim(salary_unit) WHEN '万' THEN 10000e0 WHEN '千' THEN 1000e0 ELSE 1e0 END) AS uf,
    (CASE trim(salary_period) WHEN '年' THEN 1e0 / 12e0 WHEN '天' THEN 30e0 ELSE 1e0 END) AS pf
  FROM postings
),
prep AS (
  SELECT job_id, industry_group, job_title, job_skills, other_requirement, experience_required, education_required,
    CASE WHEN contains(t, '无需经验') THEN 0e0
      WHEN contains(t, '1年以内') OR contains(t, '1年内') THEN 0.05e0
      WHEN regexp_matches(t, '(\\d+)\\s*-\\s*(\\d+)\\s*年')
        THEN (CAST(regexp_extract(t, '(\\d+)\\s*-\\s*(\\d+)\\s*年', 1) AS DOUBLE)
            + CAST(regexp_extract(t, '(\\d+)\\s*-\\s*(\\d+)\\s*年', 2) AS DOUBLE)) / 20e0
      WHEN regexp_matches(t, '(\\d+)\\s*年\\s*及以上') THEN CAST(regexp_extract(t, '(\\d+)\\s*年\\s*及以上', 1) AS DOUBLE) / 10e0
      WHEN regexp_matches(t, '(\\d+)\\s*年\\s*以上') THEN (CAST(regexp_extract(t, '(\\d+)\\s*年\\s*以上', 1) AS DOUBLE) + 1) / 10e0
      WHEN regexp_matches(t, '(\\d+)\\s*年') THEN CAST(regexp_extract(t, '(\\d+)\\s*年', 1) AS DOUBLE) / 10e0
      ELSE 0e0 END AS exp_numeric,
    salary_min * uf * pf AS salary_min_norm,
    salary_max * uf * pf AS salary_max_norm,
    (salary_min * uf * pf + salary_max * uf * pf) / 2 AS avg_salary,
    [trim(x) FOR x IN regexp_split_to_array(coalesce(job_skills, ''), '[,;；]+') IF trim(x) <> ''] AS skills_list
  FROM scored
)"""

TOKENS = PREP + """,
tok AS (
  SELECT industry_group, job_id, unnest(skills_list) AS skill, generate_subscripts(skills_list, 1) AS pos
  FROM prep WHERE industry_group IS NOT NULL
),
cnt AS (
  SELECT industry_group, skill, count(*) AS token_cnt, count(DISTINCT job_id) AS job_cnt,
         min(job_id) AS first_job, arg_min(pos, (job_id, pos)) AS first_pos
  FROM tok GROUP BY ALL HAVING count(*) >= 2
),
js AS (SELECT DISTINCT industry_group, job_id, skill FROM tok SEMI JOIN cnt USING (industry_group, skill))"""

PAIRS = TOKENS + """,
sz AS (SELECT industry_group, count(*) AS n FROM prep WHERE industry_group IS NOT NULL GROUP BY 1),
vary AS (SELECT cnt.*, n FROM cnt JOIN sz USING (industry_group) WHERE job_cnt < n),
both_in AS (
  SELECT a.industry_group, a.skill AS skill_a, b.skill AS skill_b, count(*) AS n_both
  FROM js a JOIN js b ON a.industry_group = b.industry_group AND a.job_id = b.job_id AND a.skill < b.skill
  GROUP BY ALL
),
cor AS (
  SELECT p.industry_group, skill_a, skill_b, a.job_cnt AS n_a, b.job_cnt AS n_b, n_both,
    (a.n * 1e0 * n_both - a.job_cnt * 1e0 * b.job_cnt)
      / (sqrt(a.job_cnt * 1e0 * (a.n - a.job_cnt)) * sqrt(b.job_cnt * 1e0 * (b.n - b.job_cnt))) AS phi
  FROM both_in p
  JOIN vary a ON a.industry_group = p.industry_group AND a.skill = skill_a
  JOIN vary b ON b.industry_group = p.industry_group AND b.skill = skill_b
)"""

BUNDLES = PAIRS + """,
edge AS (
  SELECT industry_group, skill_a AS a, skill_b AS b FROM cor WHERE phi > 0.75
  UNION ALL SELECT industry_group, skill_b, skill_a FROM cor WHERE phi > 0.75
),
reach AS (
  SELECT industry_group, a, b FROM edge
  UNION
  SELECT r.industry_group, r.a, e.b FROM reach r JOIN edge e ON e.industry_group = r.industry_group AND e.a = r.b
),
comp AS (SELECT industry_group, a AS skill, least(a, min(b)) AS component FROM reach GROUP BY industry_group, a),
named AS (
  SELECT industry_group, component, arg_max(skill, (token_cnt, skill)) || '技能包' AS suggested_label,
         string_agg(skill, ';' ORDER BY first_job, first_pos) AS original_skills
  FROM comp JOIN cnt USING (industry_group, skill) GROUP BY ALL
)"""

SAMPLE = PREP + """,
sample AS (
  SELECT job_id, industry_group, avg_salary, exp_numeric * 10 AS exp_years, skills_list
  FROM prep WHERE industry_group IS NOT NULL AND avg_salary > 0
),
sz AS (SELECT industry_group, count(*) AS n_jobs FROM sample GROUP BY 1),
tok AS (SELECT industry_group, job_id, unnest(skills_list) AS skill, generate_subscripts(skills_list, 1) AS pos FROM sample),
cnt AS (
  SELECT industry_group, skill, count(*) AS token_cnt, count(DISTINCT job_id) AS job_cnt,
         min(job_id) AS first_job, arg_min(pos, (job_id, pos)) AS first_pos
  FROM tok GROUP BY ALL HAVING count(*) >= 2
)"""

FLAGGED = SAMPLE + """,
flagged AS (
  SELECT s.industry_group, k.skill, s.job_id, n_jobs, avg_salary,
         CASE WHEN exp_years < 4 THEN '<4' ELSE '>=4' END AS exp_bucket,
         list_contains(skills_list, k.skill) AS has_skill
  FROM sample s JOIN sz USING (industry_group) JOIN cnt k USING (industry_group)
  WHERE n_jobs BETWEEN 10 AND 69
),
whole AS (
  SELECT industry_group, skill, any_value(n_jobs) AS n_samples,
         count(*) FILTER (has_skill) AS n_with_skill, count(*) FILTER (NOT has_skill) AS n_without_skill,
         median(avg_salary) FILTER (has_skill) - median(avg_salary) FILTER (NOT has_skill) AS median_premium
  FROM flagged GROUP BY industry_group, skill
),
bucketed AS (
  SELECT industry_group, skill, exp_bucket, count(*) FILTER (has_skill) AS w,
         median(avg_salary) FILTER (has_skill) - median(avg_salary) FILTER (NOT has_skill) AS diff
  FROM flagged GROUP BY industry_group, skill, exp_bucket
)"""

ORACLES["experience_numeric"] = PREP + "SELECT job_id, experience_required, round(exp_numeric, 6) AS exp_numeric FROM prep"
ORACLES["salary_per_month"] = PREP + """
SELECT job_id, round(salary_min_norm, 4) AS salary_min_norm, round(salary_max_norm, 4) AS salary_max_norm,
       round(avg_salary, 4) AS avg_salary FROM prep"""
ORACLES["skill_token_list"] = PREP + """
SELECT job_id, array_to_string(skills_list, '|') AS skills, CAST(len(skills_list) AS INTEGER) AS n_tokens FROM prep"""
ORACLES["embedding_tag_list"] = f"""WITH {POSTINGS_SQL},
tagged AS (SELECT job_id, [x FOR x IN regexp_split_to_array(coalesce(job_skills, ''), '[,;；\\s]+') IF x <> ''] AS tags FROM postings)
SELECT job_id, array_to_string(tags, '|') AS tags, CAST(len(tags) AS INTEGER) AS n_tags FROM tagged"""
ORACLES["sentence_list"] = """
SELECT doc_id, CAST(CASE WHEN trim(text, chr(10) || chr(13) || chr(9) || ' ') <> '' THEN 1 ELSE 0 END AS INTEGER) AS n_sentences,
       trim(coalesce(text, ''), chr(10) || chr(13) || chr(9) || ' ') AS sentence FROM documents"""
ORACLES["salary_sample"] = SAMPLE + """
SELECT job_id, industry_group, round(avg_salary, 4) AS avg_salary, round(exp_years, 6) AS exp_years FROM sample"""
ORACLES["experience_buckets"] = PREP + """
SELECT CASE WHEN exp_numeric * 10 < 4 THEN '<4' ELSE '>=4' END AS exp_bucket, count(*) AS n_jobs FROM prep GROUP BY 1"""
ORACLES["skill_counts"] = TOKENS + "SELECT * FROM cnt"
ORACLES["job_skill_matrix"] = TOKENS + "SELECT industry_group, job_id, skill FROM js"
ORACLES["skill_matrix_wide"] = TOKENS + """
SELECT industry_group, job_id, CAST(bool_or(skill = 'ECONOMY') AS INTEGER) AS ECONOMY,
       CAST(bool_or(skill = 'MEDIUM') AS INTEGER) AS MEDIUM, CAST(bool_or(skill = 'SMALL') AS INTEGER) AS SMALL
FROM tok GROUP BY industry_group, job_id"""
ORACLES["feature_names"] = TOKENS + """,
base AS (
  SELECT *, trim(regexp_replace(skill, '[^0-9a-zA-Z]+', '_', 'g'), '_') AS bare FROM cnt
),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY industry_group, bare ORDER BY first_job, first_pos) AS nth FROM base
)
SELECT industry_group, skill, CASE WHEN bare = '' THEN 'skill_empty' ELSE 'skill_' || bare END
       || CASE WHEN nth > 1 THEN '_' || CAST(nth - 1 AS VARCHAR) ELSE '' END AS feature FROM nth"""
ORACLES["skill_correlations"] = PAIRS + """
SELECT industry_group, skill_a, skill_b, n_a, n_b, n_both, round(phi, 8) AS phi FROM cor WHERE phi > 0"""
ORACLES["skill_edges"] = PAIRS + """
SELECT industry_group, skill_a, skill_b, n_a, n_b, n_both, round(phi, 8) AS phi FROM cor WHERE phi > 0.75"""
ORACLES["skill_components"] = BUNDLES + "SELECT industry_group, skill, component FROM comp"
ORACLES["skill_merge_preview"] = BUNDLES + "SELECT industry_group, suggested_label, original_skills FROM named"
MERGED = BUNDLES + """,
relabelled AS (
  SELECT t.job_id, coalesce(n.suggested_label, t.skill) AS skill, min(t.pos) AS pos
  FROM (SELECT job_id, industry_group, unnest(skills_list) AS skill, generate_subscripts(skills_list, 1) AS pos FROM prep) t
  LEFT JOIN comp c ON c.industry_group = t.industry_group AND c.skill = t.skill
  LEFT JOIN named n ON n.industry_group = c.industry_group AND n.component = c.component
  GROUP BY ALL
),
joined AS (SELECT job_id, string_agg(skill, ',' ORDER BY pos) AS merged_job_skills FROM relabelled GROUP BY job_id),
merged AS (
  SELECT p.*, coalesce(merged_job_skills, '') AS merged_job_skills FROM prep p LEFT JOIN joined j ON j.job_id = p.job_id
)"""
ORACLES["merged_job_skills"] = MERGED + "SELECT job_id, industry_group, merged_job_skills FROM merged"
ORACLES["industry_routes"] = SAMPLE + """
SELECT industry_group, n_jobs, CASE WHEN n_jobs >= 70 THEN 'regression' WHEN n_jobs >= 10 THEN 'robust' ELSE 'none' END AS route FROM sz"""
ORACLES["skill_budgets"] = SAMPLE + """,
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_jobs DESC, industry_group) AS size_rank, count(*) OVER () AS groups FROM sz WHERE n_jobs >= 70
)
SELECT industry_group, n_jobs, size_rank,
       CAST(round_even(CASE WHEN groups = 1 THEN 16e0 ELSE 16e0 + (size_rank - 1) * (-11e0 / (groups - 1)) END, 0) AS INTEGER) AS skill_budget
FROM ranked"""
ORACLES["skill_presence_medians"] = FLAGGED + """
SELECT industry_group, skill, n_with_skill, n_without_skill, round(median_premium, 4) AS median_premium FROM whole"""
ORACLES["skill_bucket_medians"] = FLAGGED + """
SELECT industry_group, skill, exp_bucket, coalesce(w, 0) AS w, round(diff, 4) AS diff
FROM (SELECT industry_group, skill, unnest(['<4', '>=4']) AS exp_bucket FROM whole) LEFT JOIN bucketed USING (industry_group, skill, exp_bucket)"""
ORACLES["skill_value_robust"] = FLAGGED + """,
matched AS (
  SELECT industry_group, skill, sum(diff * w) / sum(w) AS coarse_match_premium, count(*) AS matched_bucket_count
  FROM bucketed WHERE diff IS NOT NULL GROUP BY industry_group, skill
),
kept AS (
  SELECT w.*, coarse_match_premium, coalesce(coarse_match_premium, median_premium) AS pure_skill_value,
         coalesce(matched_bucket_count, 0) AS matched_bucket_count, count(*) OVER (PARTITION BY w.industry_group) AS usable
  FROM whole w LEFT JOIN matched m ON m.industry_group = w.industry_group AND m.skill = w.skill
  WHERE n_with_skill >= 2 AND n_without_skill >= 2
    AND (coarse_match_premium IS NULL OR sign(coarse_match_premium) = sign(median_premium))
)
SELECT industry_group, skill, n_samples, n_with_skill, n_without_skill, round(median_premium, 4) AS median_premium,
       round(coarse_match_premium, 4) AS coarse_match_premium, round(pure_skill_value, 4) AS pure_skill_value,
       matched_bucket_count, 'median_plus_coarse_matching' AS method
FROM kept WHERE usable >= 3"""

# --- requirement text -----------------------------------------------------------

W = f"'{WHITE}'"
WB = f"'{WHITE}-–—·•【】[]'"


def _strip(x: str) -> str:
    return f"trim({x}, {W})"


def _clean(x: str) -> str:
    return _strip(f"ltrim(trim({x}, {WB}), '：:')")


def _after(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '(?s)\\A.*?(?:{pattern})(.*)\\z', {2 if '(' in pattern else 1}) END"


LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
IGNORE = "(?i)" + "|".join(LATIN.ignore)

TEXTS = f"""WITH norm AS (
  SELECT doc_id, lang, text AS raw, {_strip("replace(replace(coalesce(text, ''), chr(13), chr(10)), chr(12288), ' ')")} AS body FROM documents
)"""


def _cut(source: str, column: str) -> str:
    return f""",
broken AS (
  SELECT doc_id, regexp_replace(regexp_replace({column}, '([。；;])', '\\1' || chr(10), 'g'),
         '(^|[^0-9])([：:])', '\\1\\2' || chr(10), 'g') AS b FROM {source}
),
lines AS (
  SELECT doc_id, [{_clean("x")} FOR x IN regexp_split_to_array(b, '{LINE_BREAK}')
         IF {_clean("x")} <> '' AND NOT regexp_matches({_clean("x")}, '{LATIN.heading}')] AS ls FROM broken
),
parts AS (
  SELECT doc_id, flatten([[{_clean("y")} FOR y IN regexp_split_to_array(x, '[；;，,]+') IF {_clean("y")} <> ''] FOR x IN ls]) AS ps FROM lines
),
seg AS (SELECT doc_id, unnest(ps) AS segment, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos FROM parts),
labelled AS (
  SELECT *, CASE WHEN c = '' OR regexp_matches(c, '{IGNORE}') THEN 'ignore'
    WHEN regexp_matches(c, '{LATIN.education}') THEN 'other'
    WHEN regexp_matches(c, '{LATIN.age}') AND NOT regexp_matches(c, '{LATIN.age_blocked_by}') THEN 'other'
    WHEN regexp_matches(c, '{LATIN.experience}') THEN 'experience'
    WHEN regexp_matches(c, '{LATIN.skill}') THEN 'skill' ELSE 'other' END AS label
  FROM (SELECT *, {_clean("segment")} AS c FROM seg)
)"""


SECTION = rf""",
tailed AS (
  SELECT doc_id, body, coalesce({_after("body", LATIN.header)}, CASE WHEN regexp_matches(body, '(^|\n)\s*Re[:：]?')
    THEN regexp_extract(body, '(?s)\A(?:Re[:：]?|.*?\n\s*Re[:：]?)(.*)\z', 1) END) AS tail FROM norm
),
section AS (
  SELECT doc_id, CASE WHEN tail IS NULL THEN body WHEN regexp_matches(tail, '{LATIN.end}')
    THEN regexp_extract(tail, '(?s)\A(.*?){LATIN.end}', 1) ELSE tail END AS section FROM tailed
)"""

ORACLES["normalized_text"] = TEXTS + "SELECT doc_id, body AS text FROM norm"
ORACLES["one_line_text"] = f"""
SELECT doc_id, {_strip("replace(replace(coalesce(text, ''), chr(10), '；'), chr(13), '；')")} AS text FROM documents"""
ORACLES["requirement_section"] = TEXTS + SECTION + "SELECT doc_id, section FROM section"
ORACLES["cleaned_lines"] = TEXTS + _cut("norm", "body") + """
SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS pos, unnest(ls) AS line FROM lines"""
ORACLES["line_segments"] = TEXTS + _cut("norm", "body") + "SELECT doc_id, pos, segment FROM seg"
ORACLES["ignored_segments"] = TEXTS + _cut("norm", "body") + f"""
SELECT doc_id, pos, segment FROM seg WHERE regexp_matches(segment, '{IGNORE}')"""
ORACLES["classified_segments"] = TEXTS + _cut("norm", "body") + "SELECT doc_id, pos, label FROM labelled"
ORACLES["other_requirement"] = TEXTS + SECTION + _cut("section", _strip("section")) + """,
kept AS (SELECT doc_id, string_agg(segment, '；' ORDER BY pos) AS o FROM labelled WHERE label = 'other' GROUP BY doc_id)
SELECT n.doc_id, coalesce(o, '') AS other_requirement FROM norm n LEFT JOIN kept k ON k.doc_id = n.doc_id"""
ORACLES["frequent_phrases"] = TEXTS + f""",
pieces AS (SELECT lang, unnest(regexp_split_to_array(raw, '[；;。.!?,，、\n\r]')) AS x FROM norm),
counted AS (
  SELECT lang, {_strip("x")} AS phrase, count(*) AS n FROM pieces WHERE length({_strip("x")}) >= 10 GROUP BY 1, 2
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, phrase) AS INTEGER) AS rank FROM counted)
SELECT lang, phrase, n, rank FROM ranked WHERE rank <= 5"""

# --- cluster profiles -----------------------------------------------------------

CLUSTERED = PREP + """,
big AS (SELECT industry_group, count(*) AS n_jobs FROM prep WHERE industry_group IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
clu AS (
  SELECT p.*, CASE WHEN exp_numeric < 0.2 THEN 1 WHEN exp_numeric < 0.5 THEN 2 ELSE 3 END AS cluster
  FROM prep p SEMI JOIN big USING (industry_group)
),
clu_size AS (
  SELECT industry_group, cluster, count(*) AS job_count,
         round_even(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY industry_group), 2) AS cluster_percentage_in_industry
  FROM clu GROUP BY 1, 2
),
title_n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY industry_group, cluster ORDER BY n DESC, job_title) AS INTEGER) AS rank
  FROM (SELECT industry_group, cluster, job_title, count(*) AS n FROM clu WHERE job_title IS NOT NULL GROUP BY ALL)
),
skill_n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY industry_group, cluster ORDER BY n DESC, skill) AS INTEGER) AS rank
  FROM (SELECT industry_group, cluster, skill, count(*) AS n
        FROM (SELECT industry_group, cluster, unnest(skills_list) AS skill FROM clu) GROUP BY ALL)
),
exp_n AS (
  SELECT industry_group, cluster, arg_min(v, (-n, v)) AS experience_required
  FROM (SELECT industry_group, cluster, coalesce(experience_required, '未知') AS v, count(*) AS n FROM clu GROUP BY ALL) GROUP BY 1, 2
),
edu_n AS (
  SELECT industry_group, cluster, arg_min(v, (-n, v)) AS education_required
  FROM (SELECT industry_group, cluster, coalesce(education_required, '未知') AS v, count(*) AS n FROM clu GROUP BY ALL) GROUP BY 1, 2
),
pay AS (
  SELECT industry_group, cluster, round_even(avg(salary_min_norm), 2) AS salary_min_avg, round_even(avg(salary_max_norm), 2) AS salary_max_avg
  FROM clu GROUP BY 1, 2
),
phrase_n AS (
  SELECT *, row_number() OVER (PARTITION BY industry_group, cluster ORDER BY n DESC, phrase) AS rank
  FROM (SELECT industry_group, cluster, phrase, count(*) AS n
        FROM (SELECT industry_group, cluster, unnest(string_split(other_requirement, '；')) AS phrase FROM clu)
        WHERE length(phrase) >= 10 GROUP BY ALL)
),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY industry_group, cluster ORDER BY md5('42:' || CAST(job_id AS VARCHAR)), job_id) AS rank
  FROM clu WHERE other_requirement IS NOT NULL
),
titles AS (SELECT industry_group, cluster, string_agg(job_title, '; ' ORDER BY rank) AS top_titles, string_agg(job_title, ', ' ORDER BY rank) AS t2
           FROM title_n WHERE rank <= 5 GROUP BY 1, 2),
cores AS (SELECT industry_group, cluster, string_agg(skill, '; ' ORDER BY rank) AS core_skills, string_agg(skill, ', ' ORDER BY rank) AS s2
          FROM skill_n WHERE rank <= 10 GROUP BY 1, 2),
reqs AS (SELECT industry_group, cluster, string_agg(phrase, '；' ORDER BY rank) AS other_requirements FROM phrase_n WHERE rank <= 5 GROUP BY 1, 2),
prof AS (
  SELECT industry_group, cluster AS cluster_id, 'Cluster ' || cluster || ' (' || industry_group || ')' AS profile_name,
    'profile_name_prompt_' || translate(industry_group, '/ ', '__') || '_' || cluster || '.txt' AS profile_name_prompt_file,
    job_count, cluster_percentage_in_industry, coalesce(top_titles, '') AS top_titles, coalesce(core_skills, '') AS core_skills,
    experience_required AS experience, coalesce(other_requirements, '') AS other_requirements, education_required AS education,
    salary_min_avg, salary_max_avg, 'prompt_' || translate(industry_group, '/ ', '__') || '_' || cluster || '.txt' AS llm_prompt_file
  FROM clu_size LEFT JOIN titles USING (industry_group, cluster) LEFT JOIN cores USING (industry_group, cluster)
  LEFT JOIN exp_n USING (industry_group, cluster) LEFT JOIN edu_n USING (industry_group, cluster)
  LEFT JOIN pay USING (industry_group, cluster) LEFT JOIN reqs USING (industry_group, cluster)
)"""


def _sql_text(*lines: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in lines)


PROMPTS = CLUSTERED + f""",
texts AS (
  SELECT industry_group, cluster, string_agg(CAST(rank AS VARCHAR) || '. ' || {_strip("replace(replace(other_requirement, chr(10), '；'), chr(13), '；')")},
         chr(10) ORDER BY rank) AS t FROM drawn WHERE rank <= 30 GROUP BY 1, 2
),
ask AS (
  SELECT industry_group, cluster,
    {_sql_text(prompts.NAMING_HEAD, prompts.INDUSTRY_LABEL)} || industry_group || chr(10) || '{prompts.CLUSTER_LABEL}' || cluster || chr(10)
      || {_sql_text(*prompts.NAMING_BODY, prompts.TITLES_LABEL)} || coalesce(t2, '') || chr(10) || '{prompts.SKILLS_LABEL}' || coalesce(s2, '')
      || chr(10) || {_sql_text(*prompts.NAMING_TAIL)} AS naming_prompt,
    {_sql_text(prompts.REQUIREMENTS_HEAD, prompts.INDUSTRY_LABEL)} || industry_group || chr(10) || '{prompts.CLUSTER_LABEL}' || cluster || chr(10)
      || {_sql_text(*prompts.REQUIREMENTS_BODY)} || coalesce(chr(10) || t, '') || chr(10) || {_sql_text(prompts.REQUIREMENTS_TAIL)} AS requirements_prompt
  FROM clu_size LEFT JOIN titles USING (industry_group, cluster) LEFT JOIN cores USING (industry_group, cluster)
  LEFT JOIN texts USING (industry_group, cluster)
),
asked AS (
  SELECT *, sha256(naming_prompt || chr(10) || chr(10) || requirements_prompt) AS cache_key,
    {" || chr(10) || chr(10) || ".join(_sql_text(x) for x in prompts.COMBINED_HEAD)} || chr(10) || chr(10) || '{prompts.TASK_NAMING}' || chr(10) || chr(10)
      || naming_prompt || chr(10) || chr(10) || '{prompts.TASK_REQUIREMENTS}' || chr(10) || chr(10) || requirements_prompt AS combined_prompt
  FROM ask
),
answered AS (
  SELECT *, substr(cache_key, 1, 20) AS name, substr(cache_key, 1, 4) || '；' || substr(cache_key, 5, 4) AS items
  FROM asked WHERE cluster = 1 AND substr(cache_key, 64, 1) < 'c'
)"""

ORACLES["clusterable_industries"] = CLUSTERED + "SELECT * FROM big"
ORACLES["cluster_sizes"] = CLUSTERED + "SELECT * FROM clu_size"
ORACLES["top_titles"] = CLUSTERED + "SELECT industry_group, cluster, job_title, n, rank FROM title_n WHERE rank <= 5"
ORACLES["core_skills"] = CLUSTERED + "SELECT industry_group, cluster, skill, n, rank FROM skill_n WHERE rank <= 10"
ORACLES["most_common_labels"] = CLUSTERED + "SELECT * FROM exp_n JOIN edu_n USING (industry_group, cluster)"
ORACLES["salary_means"] = CLUSTERED + "SELECT * FROM pay"
ORACLES["sampled_texts"] = CLUSTERED + """
SELECT industry_group, cluster, job_id, other_requirement AS value FROM drawn WHERE rank <= 30"""
ORACLES["cluster_profiles"] = CLUSTERED + "SELECT * FROM prof"
ORACLES["cluster_prompts"] = PROMPTS + "SELECT * FROM asked"
ORACLES["cached_replies"] = PROMPTS + """
SELECT industry_group, cluster, cache_key, name AS profile_name, items AS other_requirements FROM answered"""
ORACLES["open_prompts"] = PROMPTS + "SELECT industry_group, cluster, cache_key FROM asked ANTI JOIN answered USING (cache_key)"
ORACLES["named_profiles"] = PROMPTS + """
SELECT p.industry_group, cluster_id, coalesce(a.name, p.profile_name) AS profile_name, coalesce(a.items, p.other_requirements) AS other_requirements
FROM prof p LEFT JOIN answered a ON a.industry_group = p.industry_group AND a.cluster = p.cluster_id"""

# --- warehouse tables -----------------------------------------------------------

WAREHOUSE = f"""WITH {POSTINGS_SQL},
jf AS (
  SELECT job_id, job_title, 'company ' || job_title AS company_name, salary_min, salary_max, education_required AS location,
    coalesce(nullif(trim(industry_group), ''), '未分类') AS industry,
    coalesce(array_to_string(string_split(nullif(trim(job_skills), ''), ','), '|'), '') AS skills_required,
    try_cast(regexp_extract(experience_required, '([0-9]+)', 1) AS INTEGER) AS experience_required, education_required
  FROM postings
)"""
ORACLES["job_feature_table"] = WAREHOUSE + "SELECT * REPLACE (round(salary_min, 4) AS salary_min, round(salary_max, 4) AS salary_max) FROM jf"
ORACLES["user_feature_table"] = """
SELECT c_custkey AS user_id, c_nationkey AS age, c_mktsegment AS education, c_name AS work_experience,
       c_mktsegment || '|' || c_name AS skills, c_mktsegment AS industry_preference, c_acctbal AS salary_expectation,
       CAST(c_nationkey AS VARCHAR) || '|' || CAST(c_custkey AS VARCHAR) AS location_preference FROM customer"""
ORACLES["interaction_table"] = """
SELECT event_id AS interaction_id, user_id, value AS job_id, event_type AS interaction_type, ts AS interaction_time, ts AS created_at FROM events"""
ORACLES["key_figures"] = WAREHOUSE + """,
top_of AS (
  SELECT (SELECT location FROM jf WHERE location IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, location LIMIT 1) AS loc,
         (SELECT industry FROM jf GROUP BY 1 ORDER BY count(*) DESC, industry LIMIT 1) AS ind
)
SELECT 'totalJobs' AS stat_key, 'Total Jobs' AS stat_name, 'job' AS metric_category, 'all' AS dimension,
       CAST((SELECT count(*) FROM jf) AS DOUBLE) AS metric_value, CAST(NULL AS VARCHAR) AS metric_text, 'job_feature_table' AS source_table
UNION ALL SELECT 'totalUsers', 'Total Users', 'user', 'all', (SELECT count(*) FROM customer), NULL, 'user_feature_table'
UNION ALL SELECT 'totalInteractions', 'Total Interactions', 'interaction', 'all', (SELECT count(*) FROM events), NULL, 'interaction_table'
UNION ALL SELECT 'avgSalaryMax', 'Average Max Salary', 'job', 'all', (SELECT round(avg(salary_max), 4) FROM jf), NULL, 'job_feature_table'
UNION ALL SELECT 'avgSalaryMin', 'Average Min Salary', 'job', 'all', (SELECT round(avg(salary_min), 4) FROM jf), NULL, 'job_feature_table'
UNION ALL SELECT 'topLocation', 'Top Job Location', 'job', 'location', NULL, loc, 'job_feature_table' FROM top_of
UNION ALL SELECT 'topIndustry', 'Top Job Industry', 'job', 'industry', NULL, ind, 'job_feature_table' FROM top_of
UNION ALL SELECT 'staticSourceRecords', 'Static Report Source Records', 'static', 'all', (SELECT count(*) FROM nation), NULL, 'report_static_source'"""

# --- vectors --------------------------------------------------------------------

FINGERPRINT = """
SELECT job_id, CAST(len(v) AS INTEGER) AS dims, round(sqrt(list_sum([x * x FOR x IN v])), 5) AS norm,
       round(list_sum([x * i FOR x, i IN v]), 5) AS weighted_sum FROM vectors"""
TAGGED = PREP + """,
tag AS (
  SELECT job_id, unnest([x FOR x IN regexp_split_to_array(coalesce(job_skills, ''), '[,;；\\s]+') IF x <> '']) AS tag FROM prep
),
lookup AS (SELECT 'Brand#' || vec_id AS tag, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
dims AS (SELECT job_id, dim, avg(v) AS v FROM tag JOIN lookup USING (tag) GROUP BY job_id, dim),
found AS (SELECT job_id, list(v ORDER BY dim) AS v FROM dims GROUP BY job_id),
skill_vec AS (SELECT p.job_id, exp_numeric, coalesce(f.v, [0e0 FOR x IN range(64)]) AS v FROM prep p LEFT JOIN found f ON f.job_id = p.job_id)"""
ORACLES["tag_vectors"] = TAGGED + ", vectors AS (SELECT job_id, v FROM skill_vec)" + FINGERPRINT
ORACLES["job_vectors"] = TAGGED + ", vectors AS (SELECT job_id, list_concat([exp_numeric], v, list_reverse(v)) AS v FROM skill_vec)" + FINGERPRINT



def _encoded(source: str, key: str, column: str, dims: int, name: str) -> str:
    """CTEs ending in ``name`` (key, v): unit vectors of md5-bucketed character trigrams; empty texts are left out."""
    return f""",
{name}_chars AS (SELECT {key}, {column} AS t, regexp_extract_all({column}, '(?s).') AS c FROM {source} WHERE {column} <> ''),
{name}_grams AS (
  SELECT {key}, unnest(CASE WHEN len(c) < 3 THEN [t] ELSE [c[i] || ' ' || c[i + 1] || ' ' || c[i + 2] FOR i IN range(1, len(c) - 1)] END) AS g
  FROM {name}_chars
),
{name}_buckets AS (
  SELECT {key}, CAST('0x' || substr(md5(g), 1, 6) AS INTEGER) % {dims} AS d, count(*) AS n FROM {name}_grams GROUP BY ALL
),
{name}_maps AS (SELECT {key}, map_from_entries(list((d, n))) AS m, sqrt(sum(n * n)) AS size FROM {name}_buckets GROUP BY ALL),
{name} AS (SELECT {key}, [coalesce(m[CAST(d AS INTEGER)], 0) / size FOR d IN range({dims})] AS v FROM {name}_maps)"""


ORACLES["document_vectors"] = f"WITH sentences AS (SELECT doc_id AS job_id, {_strip("coalesce(text, '')")} AS s FROM documents)" + _encoded(
    "sentences", "job_id", "s", 64, "coded"
) + ", vectors AS (SELECT s.job_id, coalesce(v, [0e0 FOR x IN range(64)]) AS v FROM sentences s LEFT JOIN coded c ON c.job_id = s.job_id)" + FINGERPRINT
ORACLES["tag_sentence_vectors"] = f"""WITH {POSTINGS_SQL},
sentences AS (
  SELECT job_id, array_to_string([x FOR x IN regexp_split_to_array(coalesce(job_skills, ''), '[,;；\\s]+') IF x <> ''], ' ') AS s FROM postings
)""" + _encoded("sentences", "job_id", "s", 64, "coded") + """,
vectors AS (SELECT s.job_id, coalesce(v, [0e0 FOR x IN range(64)]) AS v FROM sentences s LEFT JOIN coded c ON c.job_id = s.job_id)""" + FINGERPRINT


def _seed_rows() -> str:
    kinds = (("experience", fv.EXPERIENCE_SEEDS), ("skill", fv.SKILL_SEEDS), ("other", fv.OTHER_SEEDS))
    return ", ".join(f"('{kind}', '{phrase}')" for kind, phrases in kinds for phrase in phrases)


ORACLES["seeded_other_requirement"] = TEXTS + SECTION + _cut("section", _strip("section")).replace("ELSE 'other' END AS label", "END AS label") + f""",
open_segments AS (SELECT DISTINCT segment FROM labelled WHERE label IS NULL),
seeds(class, phrase) AS (VALUES {_seed_rows()})""" + _encoded("open_segments", "segment", "segment", 64, "coded") + _encoded(
    "(SELECT DISTINCT phrase FROM seeds)", "phrase", "phrase", 64, "seed"
) + """,
close AS (
  SELECT c.segment, class, round(max(list_dot_product(c.v, s.v)), 12) AS sim
  FROM coded c CROSS JOIN seed s JOIN seeds ON seeds.phrase = s.phrase GROUP BY ALL
),
sims AS (
  SELECT segment, max(sim) FILTER (class = 'experience') AS e, max(sim) FILTER (class = 'skill') AS s, max(sim) FILTER (class = 'other') AS o
  FROM close GROUP BY ALL
),
decided AS (
  SELECT segment, CASE WHEN e >= s AND e >= o AND e > 0.45 THEN 'experience' WHEN s >= o AND s > 0.45 THEN 'skill' WHEN o > 0.40 THEN 'other'
    WHEN s > e THEN 'skill' WHEN e > s THEN 'experience' ELSE 'other' END AS seed_label FROM sims
),
kept AS (
  SELECT doc_id, string_agg(l.segment, '；' ORDER BY pos) AS o FROM labelled l LEFT JOIN decided d ON d.segment = l.segment
  WHERE coalesce(label, seed_label) = 'other' GROUP BY doc_id
)
SELECT n.doc_id AS job_id, coalesce(o, '') AS other_requirement FROM norm n LEFT JOIN kept k ON k.doc_id = n.doc_id"""

VECS = """WITH vecs AS (SELECT vec_id AS job_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
ORACLES["unit_vectors"] = VECS + """,
lengths AS (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS n FROM vecs)
SELECT job_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(CASE WHEN n = 0 THEN unnest(v) ELSE unnest(v) / n END, 8) AS value FROM lengths"""
ORACLES["weighted_features"] = VECS + """,
cut AS (SELECT job_id, greatest(0e0, least(1e0, v[1])) AS e, v[2:32] AS s, v[33:64] AS o FROM vecs),
lengths AS (SELECT *, sqrt(list_sum([x * x FOR x IN s])) AS ns, sqrt(list_sum([x * x FOR x IN o])) AS no FROM cut),
flat AS (SELECT job_id, list_concat([x / ns FOR x IN s], [e * 8], [0.4e0 * x / no FOR x IN o]) AS f FROM lengths)
SELECT job_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS dim, round(unnest(f), 8) AS value FROM flat"""
ORACLES["seed_labels"] = VECS + """,
sims AS (
  SELECT a.job_id, max(list_cosine_similarity(a.v, b.v)) FILTER (b.job_id < 5) AS e,
         max(list_cosine_similarity(a.v, b.v)) FILTER (b.job_id BETWEEN 5 AND 9) AS s,
         max(list_cosine_similarity(a.v, b.v)) FILTER (b.job_id BETWEEN 10 AND 14) AS o
  FROM vecs a CROSS JOIN vecs b WHERE b.job_id < 15 GROUP BY a.job_id
)
SELECT job_id, round(e, 8) AS sim_experience, round(s, 8) AS sim_skill, round(o, 8) AS sim_other,
  CASE WHEN e >= s AND e >= o AND e > 0.45 THEN 'experience' WHEN s >= o AND s > 0.45 THEN 'skill' WHEN o > 0.40 THEN 'other'
       WHEN s > e THEN 'skill' WHEN e > s THEN 'experience' ELSE 'other' END AS label FROM sims"""

# --- clusters -------------------------------------------------------------------

SILHOUETTE = VECS + """,
pts AS (SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS industry_group, * FROM vecs),
d AS (
  SELECT a.industry_group, a.job_id, a.label AS own, b.label AS cluster, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
  FROM pts a JOIN pts b ON a.industry_group = b.industry_group GROUP BY ALL
),
ab AS (
  SELECT industry_group, job_id, own, max(CASE WHEN own = cluster AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN own <> cluster THEN total / n END) AS b FROM d GROUP BY ALL
),
sc AS (SELECT industry_group, job_id, own AS cluster, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS score FROM ab)"""
ORACLES["silhouette_rows"] = SILHOUETTE + "SELECT industry_group, job_id, cluster, round(score, 7) AS score FROM sc"
ORACLES["silhouette_scores"] = SILHOUETTE + "SELECT industry_group, round(avg(score), 7) AS silhouette FROM sc GROUP BY 1"
NEAREST = VECS + """,
parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vecs WHERE label IS NOT NULL),
means AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY label),
centers AS (SELECT c, row_number() OVER (ORDER BY label) - 1 AS i FROM means),
near AS (
  SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS industry_group, job_id, any_value(v) AS v,
         CAST(arg_min(i, (list_distance(v, c), i)) AS INTEGER) AS nearest, min(list_distance(v, c)) AS far
  FROM vecs CROSS JOIN centers GROUP BY 1, 2
)"""
ORACLES["nearest_centroids"] = NEAREST + "SELECT industry_group, job_id, nearest FROM near"
ORACLES["lloyd_round"] = NEAREST + """,
moved AS (
  SELECT industry_group, nearest AS cluster, d, avg(x) AS m
  FROM (SELECT industry_group, nearest, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM near) GROUP BY ALL
),
whole AS (SELECT industry_group, cluster, list(m ORDER BY d) AS v FROM moved GROUP BY ALL),
cost AS (SELECT industry_group, nearest AS cluster, sum(far * far) AS inertia FROM near GROUP BY ALL)
SELECT industry_group, cluster, CAST(len(v) AS INTEGER) AS dims, round(sqrt(list_sum([x * x FOR x IN v])), 5) AS norm,
       round(list_sum([x * i FOR x, i IN v]), 5) AS weighted_sum, round(inertia, 5) AS inertia
FROM whole JOIN cost USING (industry_group, cluster)"""

# --- salary analysis, large industries ------------------------------------------


def _psi(n: str) -> str:
    below = " + ".join(f"1e0 / (({n}) + {i})" for i in range(10))
    x = f"(({n}) + 10e0)"
    return f"(ln({x}) - 1e0 / (2 * {x}) - 1e0 / (12 * {x} ** 2) + 1e0 / (120 * {x} ** 4) - 1e0 / (252 * {x} ** 6) - ({below}))"


def _erfc(x: str) -> str:
    """Power series below 2, continued fraction above."""
    scale = f"(exp(-({x}) * ({x})) / sqrt(pi()))"
    fraction = "0e0"
    for n in range(60, 0, -1):
        fraction = f"({n / 2}e0 / ({x} + {fraction}))"
    series = "0e0"
    for n in range(60, 0, -1):
        series = f"(2e0 * {x} * {x} / {2 * n + 1} * (1e0 + {series}))"
    return f"CASE WHEN {x} < 2 THEN 1 - 2 * {scale} * {x} * (1 + {series}) ELSE {scale} / ({x} + {fraction}) END"


_NEAR = ", ".join(f"ticks - lag(ticks, {i}) OVER o, lead(ticks, {i}) OVER o - ticks" for i in (1, 2, 3))

MUTUAL = SAMPLE + f""",
large AS (SELECT s.*, n_jobs FROM sample s JOIN sz USING (industry_group) WHERE n_jobs >= 70),
ticked AS (
  SELECT *, CAST(round(avg_salary * 100) AS BIGINT) * 1048576
            + CAST('0x' || substr(md5(CAST(job_id AS VARCHAR)), 1, 5) AS BIGINT) AS ticks FROM large
),
ranked AS (SELECT industry_group, ticks, max(pl) AS pl FROM (
  SELECT industry_group, ticks, row_number() OVER (PARTITION BY industry_group ORDER BY ticks) AS pl FROM ticked) GROUP BY ALL),
flags AS (
  SELECT t.industry_group, k.skill, t.job_id, ticks, list_contains(skills_list, k.skill) AS has_skill
  FROM ticked t JOIN cnt k USING (industry_group)
),
near AS (
  SELECT *, count(*) OVER (PARTITION BY industry_group, skill, has_skill) AS c,
         list_sort([d FOR d IN [{_NEAR}] IF d IS NOT NULL]) AS gaps
  FROM flags WINDOW o AS (PARTITION BY industry_group, skill, has_skill ORDER BY ticks, job_id)
),
radii AS (SELECT *, least(3, c - 1) AS k, gaps[least(3, c - 1)] AS d FROM near WHERE c > 1),
his AS (SELECT r.*, coalesce(b.pl, 0) AS hi FROM radii r ASOF LEFT JOIN ranked b ON b.industry_group = r.industry_group AND b.ticks <= r.ticks + r.d - 1),
ms AS (
  SELECT h.*, greatest(1, hi - coalesce(b.pl, 0)) AS m
  FROM his h ASOF LEFT JOIN ranked b ON b.industry_group = h.industry_group AND b.ticks <= h.ticks - h.d
),
mi AS (
  SELECT industry_group, skill, greatest(0e0, round({_psi("count(*)")} + avg({_psi("k")}) - avg({_psi("c")}) - avg({_psi("m")}), 10)) AS mi
  FROM ms GROUP BY industry_group, skill
)"""

SELECTED = MUTUAL + """,
budget AS (
  SELECT *, CAST(round_even(CASE WHEN groups = 1 THEN 16e0 ELSE 16e0 + (size_rank - 1) * (-11e0 / (groups - 1)) END, 0) AS INTEGER) AS skill_budget
  FROM (SELECT *, row_number() OVER (ORDER BY n_jobs DESC, industry_group) AS size_rank, count(*) OVER () AS groups FROM sz WHERE n_jobs >= 70)
),
scored_skill AS (
  SELECT m.*, skill_budget,
    CAST(row_number() OVER (PARTITION BY m.industry_group ORDER BY mi DESC, first_job, first_pos) AS INTEGER) AS rank
  FROM mi m JOIN cnt c ON c.industry_group = m.industry_group AND c.skill = m.skill JOIN budget b ON b.industry_group = m.industry_group
),
chosen AS (SELECT industry_group, skill, rank FROM scored_skill WHERE rank <= skill_budget)"""

LEFTOVER = SELECTED + """,
terms AS (
  SELECT industry_group, job_id, term, count(*) AS tf
  FROM (SELECT t.industry_group, t.job_id, unnest(string_split(t.skill, ' ')) AS term
        FROM tok t JOIN sz ON sz.industry_group = t.industry_group AND n_jobs >= 70
        ANTI JOIN chosen c ON c.industry_group = t.industry_group AND c.skill = t.skill)
  WHERE term <> '' GROUP BY ALL
)"""

TFIDF = LEFTOVER + """,
idf AS (
  SELECT industry_group, term, ln((1e0 + n_jobs) / (1e0 + df)) + 1 AS idf
  FROM (SELECT *, row_number() OVER (PARTITION BY industry_group ORDER BY total DESC, term) AS rank
        FROM (SELECT industry_group, term, sum(tf) AS total, count(*) AS df FROM terms GROUP BY ALL)) JOIN sz USING (industry_group)
  WHERE rank <= 200
),
tfidf AS (
  SELECT industry_group, job_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY industry_group, job_id)) AS weight
  FROM terms JOIN idf USING (industry_group, term)
)"""

ORACLES["mutual_information"] = MUTUAL + "SELECT industry_group, skill, round(mi, 7) AS mi FROM mi"
ORACLES["selected_skills"] = SELECTED + "SELECT * FROM chosen"
ORACLES["leftover_terms"] = LEFTOVER + "SELECT * FROM terms"
ORACLES["leftover_tfidf"] = TFIDF + "SELECT industry_group, job_id, term, round(weight, 8) AS weight FROM tfidf"
ORACLES["leftover_gram"] = TFIDF + """
SELECT a.industry_group, a.term AS f, b.term AS g, round(sum(a.weight * b.weight), 6) AS s
FROM tfidf a JOIN tfidf b ON a.industry_group = b.industry_group AND a.job_id = b.job_id AND a.term <= b.term GROUP BY ALL"""


def _direction(k: int, squares: int = 4, rounds: int = 600) -> str:
    """CTE ``dir{k}`` (industry_group, v): the leading direction of ``mat{k}`` by power iteration on its 16th power; ``mat{k+1}`` lacks it."""
    out, at = "", f"mat{k}"
    for q in range(squares):
        out += f""",
sq{k}_{q} AS (
  SELECT industry_group, [[x / t FOR x IN r] FOR r IN mm] AS m
  FROM (SELECT industry_group, mm, list_sum([mm[i][i] FOR i IN range(1, len(mm) + 1)]) AS t
        FROM (SELECT industry_group, [[list_dot_product(r, s) FOR s IN m] FOR r IN m] AS mm FROM {at}))
)"""
        at = f"sq{k}_{q}"
    return out + f""",
it{k}(industry_group, v, k) AS (
  SELECT industry_group, [1e0 / sqrt(len(m)) + 1e-3 * j FOR j IN range(1, len(m) + 1)], 0 FROM {at}
  UNION ALL
  SELECT industry_group, [x / size FOR x IN w], k + 1
  FROM (SELECT *, sqrt(list_dot_product(w, w)) AS size
        FROM (SELECT i.industry_group, k, [list_dot_product(r, i.v) FOR r IN m] AS w FROM it{k} i JOIN {at} USING (industry_group) WHERE k < {rounds}))
),
dir{k} AS (
  SELECT industry_group, [x * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END FOR x IN v] AS v FROM it{k} WHERE k = {rounds}
),
mat{k + 1} AS (
  SELECT industry_group, [[x - size * v[i] * v[j] FOR x, j IN r] FOR r, i IN m] AS m
  FROM (SELECT industry_group, m, v, list_dot_product(v, [list_dot_product(r, v) FOR r IN m]) AS size FROM mat{k} JOIN dir{k} USING (industry_group))
)"""


CONTEXT = TFIDF + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY industry_group ORDER BY term) AS i FROM (SELECT DISTINCT industry_group, term FROM tfidf)
),
products AS (
  SELECT a.industry_group, m.i, n.i AS j, sum(a.weight * b.weight) AS s
  FROM tfidf a JOIN tfidf b ON a.industry_group = b.industry_group AND a.job_id = b.job_id
  JOIN numbered m ON m.industry_group = a.industry_group AND m.term = a.term
  JOIN numbered n ON n.industry_group = b.industry_group AND n.term = b.term GROUP BY ALL
),
grid AS (
  SELECT a.industry_group, a.i, list(coalesce(s, 0) ORDER BY b.i) AS r
  FROM numbered a JOIN numbered b ON b.industry_group = a.industry_group
  LEFT JOIN products p ON p.industry_group = a.industry_group AND p.i = a.i AND p.j = b.i GROUP BY ALL
),
mat1 AS (SELECT industry_group, list(r ORDER BY i) AS m FROM grid GROUP BY ALL)""" + "".join(_direction(k) for k in (1, 2, 3)) + """,
context AS (
  SELECT t.industry_group, t.job_id, sum(weight * d1.v[i]) AS c1, sum(weight * d2.v[i]) AS c2, sum(weight * d3.v[i]) AS c3
  FROM tfidf t JOIN numbered USING (industry_group, term)
  JOIN dir1 d1 USING (industry_group) JOIN dir2 d2 USING (industry_group) JOIN dir3 d3 USING (industry_group) GROUP BY ALL
)"""
ORACLES["residual_context"] = CONTEXT + """
SELECT industry_group, job_id, round(c1, 6) AS residual_context_1, round(c2, 6) AS residual_context_2, round(c3, 6) AS residual_context_3 FROM context"""
FIT = CONTEXT + """,
feats AS (
  SELECT l.industry_group, job_id, unnest(['0', '1', '2', '3', '4', '5', '~']) AS f,
         unnest([1e0, exp_years, exp_years ** 1.5e0, coalesce(c1, 0), coalesce(c2, 0), coalesce(c3, 0), avg_salary]) AS v
  FROM large l LEFT JOIN context c USING (industry_group, job_id) SEMI JOIN chosen s ON s.industry_group = l.industry_group
  UNION ALL
  SELECT DISTINCT t.industry_group, t.job_id, 's' || t.skill, 1e0
  FROM tok t JOIN chosen c ON c.industry_group = t.industry_group AND c.skill = t.skill
),
fnames AS (SELECT *, row_number() OVER (PARTITION BY industry_group ORDER BY f) AS i FROM (SELECT DISTINCT industry_group, f FROM feats)),
fprod AS (
  SELECT a.industry_group, a.f, b.f AS g, sum(a.v * b.v) AS s
  FROM feats a JOIN feats b ON a.industry_group = b.industry_group AND a.job_id = b.job_id GROUP BY ALL
),
flat AS (
  SELECT a.industry_group, list(coalesce(s, 0) ORDER BY a.i, b.i) AS a, max(a.i) AS n
  FROM fnames a JOIN fnames b ON b.industry_group = a.industry_group
  LEFT JOIN fprod p ON p.industry_group = a.industry_group AND p.f = a.f AND p.g = b.f GROUP BY ALL
),
scaled AS (
  SELECT industry_group, n, sc, [a[x] / sc[(x - 1) // n + 1] / sc[(x - 1) % n + 1] FOR x IN range(1, n * n + 1)] AS s
  FROM (SELECT *, [CASE WHEN a[(i - 1) * n + i] = 0 THEN 1e0 ELSE sqrt(a[(i - 1) * n + i]) END FOR i IN range(1, n + 1)] AS sc FROM flat)
),
-- one generalised inverse by sweeping, dependent features left out ...
swept(industry_group, a, n, p, done) AS (
  SELECT industry_group, s, n, 1, CAST([] AS BOOLEAN[]) FROM scaled
  UNION ALL
  SELECT industry_group,
    CASE WHEN d < 1e-9 THEN a ELSE
    [CASE WHEN (x - 1) // n + 1 = p AND (x - 1) % n + 1 = p THEN -1e0 / d
          WHEN (x - 1) // n + 1 = p OR (x - 1) % n + 1 = p THEN a[x] / d
          ELSE a[x] - a[(x - 1) // n * n + p] * a[(p - 1) * n + (x - 1) % n + 1] / d END FOR x IN range(1, n * n + 1)] END,
    n, p + 1, list_append(done, d >= 1e-9)
  FROM (SELECT *, a[(p - 1) * n + p] AS d FROM swept WHERE p < n)
),
-- ... and the projector on the null space, by squaring and two steps of purification, make it the pseudo-inverse
nullspace(industry_group, q, k) AS (
  SELECT industry_group, [[CASE WHEN i = j THEN 1e0 ELSE 0e0 END - s[(i - 1) * n + j] / n FOR j IN range(1, n)] FOR i IN range(1, n)], 0 FROM scaled
  UNION ALL
  SELECT industry_group, CASE WHEN k < 28 THEN qq ELSE [[3 * x - 2 * list_dot_product(r, q[j]) FOR x, j IN r] FOR r IN qq] END, k + 1
  FROM (SELECT *, [[list_dot_product(r, c) FOR c IN q] FOR r IN q] AS qq FROM nullspace WHERE k < 31)
),
inverse AS (
  SELECT industry_group, n, sc, s, rss, rank, pr, [[list_dot_product(r, c) FOR c IN pr] FOR r IN [[list_dot_product(r, c) FOR c IN g] FOR r IN pr]] AS inv
  FROM (
    SELECT industry_group, w.n, sc, s, w.a[w.n * w.n] AS rss, len([x FOR x IN done IF x]) AS rank,
      [[CASE WHEN done[i] AND done[j] THEN -w.a[(i - 1) * w.n + j] ELSE 0e0 END FOR j IN range(1, w.n)] FOR i IN range(1, w.n)] AS g,
      [[CASE WHEN i = j THEN 1e0 ELSE 0e0 END - x FOR x, j IN r] FOR r, i IN q] AS pr
    FROM swept w JOIN scaled USING (industry_group) JOIN nullspace USING (industry_group) WHERE p = w.n AND k = 31
  )
),
coefs AS (
  SELECT industry_group, f, rank, rss * sc[n] * sc[n] AS rss, inv[i][i] / sc[i] / sc[i] AS spread,
         list_dot_product(inv[i], [s[(j - 1) * n + n] FOR j IN range(1, n)]) * sc[n] / sc[i] AS coef
  FROM inverse JOIN fnames USING (industry_group) WHERE f <> '~'
)"""
ORACLES["exp_curve"] = FIT + """,
base AS (
  SELECT industry_group, max(coef) FILTER (f = '0') AS b0, max(coef) FILTER (f = '1') AS b1, max(coef) FILTER (f = '2') AS b2 FROM coefs GROUP BY 1
)
SELECT industry_group, CAST(e AS DOUBLE) AS years_experience, round(b0 + b1 * e + b2 * e ** 1.5e0, 2) AS predicted_salary FROM base, range(11) t(e)"""
ORACLES["skill_impact"] = FIT + f""",
found AS (
  SELECT *, abs(coef / se) / sqrt(2e0) AS z
  FROM (SELECT industry_group, substr(f, 2) AS skill, coef, sqrt(rss / (n_jobs - rank) * spread) AS se, n_jobs
        FROM coefs JOIN sz USING (industry_group) WHERE f LIKE 's%')
)
SELECT industry_group, skill, '{fv.SELECTION_METHOD}' AS selection_method, round(coef, 2) AS coefficient, round(se, 2) AS std_err,
       round({_erfc("z")}, 6) AS p_value, round(coef - 1.96e0 * se, 2) AS ci_lower, round(coef + 1.96e0 * se, 2) AS ci_upper,
       n_jobs AS n_samples FROM found"""
ORACLES["regression_moments"] = SELECTED + """,
feats AS (
  SELECT industry_group, job_id, unnest(['intercept', 'exp', 'exp_smooth', 'y']) AS f,
         unnest([1e0, exp_years, exp_years ** 1.5e0, avg_salary]) AS v FROM large
  UNION ALL
  SELECT DISTINCT t.industry_group, t.job_id, 'skill:' || t.skill, 1e0
  FROM tok t JOIN chosen c ON c.industry_group = t.industry_group AND c.skill = t.skill
)
SELECT a.industry_group, a.f, b.f AS g, round(sum(a.v * b.v) / 1e6, 4) AS s
FROM feats a JOIN feats b ON a.industry_group = b.industry_group AND a.job_id = b.job_id AND a.f <= b.f GROUP BY ALL"""
ORACLES["experience_slopes"] = SAMPLE + """
SELECT industry_group, round(regr_intercept(avg_salary, exp_years), 4) AS intercept, round(regr_slope(avg_salary, exp_years), 4) AS slope
FROM sample JOIN sz USING (industry_group) WHERE n_jobs >= 70 GROUP BY industry_group"""

# --- files ----------------------------------------------------------------------

ORACLES["csv_text_round_trip"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents"
ORACLES["csv_typed_round_trip"] = f"""WITH {POSTINGS_SQL}
SELECT job_id, industry_group, job_skills, experience_required, round(salary_min, 4) AS salary_min, round(salary_max, 4) AS salary_max FROM postings"""
ORACLES["saved_table_round_trip"] = ORACLES["interaction_table"]
ORACLES["warehouse_flow"] = ORACLES["key_figures"]
ORACLES["clustered_files"] = CLUSTERED + """
SELECT translate(industry_group, '/ ', '__') AS industry_key, cluster, job_count AS n_jobs FROM clu_size"""
ORACLES["prompt_files"] = PROMPTS + "SELECT industry_group, cluster, naming_prompt, requirements_prompt, cache_key FROM asked"
ORACLES["reply_cache_round_trip"] = PROMPTS + "SELECT cache_key, name AS profile_name, items AS other_requirements FROM answered"
ORACLES["experience_from_wide_vectors"] = VECS + "SELECT job_id, label, round(v[1], 8) AS exp_numeric FROM vecs"
FEATURED = MERGED + """,
tag AS (SELECT job_id, unnest([x FOR x IN regexp_split_to_array(merged_job_skills, '[,;；\\s]+') IF x <> '']) AS tag FROM merged),
lookup AS (SELECT 'Brand#' || vec_id AS tag, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
dims AS (SELECT job_id, dim, avg(v) AS v FROM tag JOIN lookup USING (tag) GROUP BY job_id, dim),
found AS (SELECT job_id, list(v ORDER BY dim) AS v FROM dims GROUP BY job_id),
coded AS (SELECT m.*, coalesce(f.v, [0e0 FOR x IN range(64)]) AS v FROM merged m LEFT JOIN found f ON f.job_id = m.job_id)"""
SHOWN = """
SELECT job_id, round(exp_numeric, 6) AS exp_numeric, round(avg_salary, 4) AS avg_salary, merged_job_skills,
       CAST(len(v) AS INTEGER) AS dims, round(sqrt(list_sum([x * x FOR x IN v])), 5) AS norm,
       round(list_sum([x * i FOR x, i IN v]), 5) AS weighted_sum"""
ORACLES["posting_features"] = FEATURED + SHOWN + " FROM coded"
ORACLES["job_vector_table"] = FEATURED + f""",
sentences AS (SELECT job_id, {_strip("coalesce(other_requirement, '')")} AS s FROM merged)""" + _encoded("sentences", "job_id", "s", 32, "text_coded") + """,
whole AS (
  SELECT c.* EXCLUDE (v), list_concat([exp_numeric], c.v, coalesce(t.v, [0e0 FOR x IN range(32)])) AS v
  FROM coded c LEFT JOIN text_coded t ON t.job_id = c.job_id
)""" + SHOWN + " FROM whole"

ORACLES["plain_exp_curve"] = SAMPLE + """,
x AS (SELECT industry_group, avg_salary AS y, exp_years AS a, exp_years ** 1.5e0 AS b FROM sample JOIN sz USING (industry_group) WHERE n_jobs >= 70),
m AS (
  SELECT industry_group, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
         covar_pop(a, y) AS ya, covar_pop(b, y) AS yb FROM x GROUP BY industry_group
),
c AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT industry_group, CAST(e AS DOUBLE) AS years_experience, round(my - ca * ma - cb * mb + ca * e + cb * e ** 1.5e0, 2) AS predicted_salary
FROM c CROSS JOIN range(11) t(e)"""

ORACLES["chosen_k"] = VECS + """,
pts AS (SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS industry_group, job_id, v, k, label % k AS own FROM vecs, range(2, 6) t(k)),
d AS (
  SELECT a.industry_group, a.k, a.job_id, a.own, b.own AS cluster, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
  FROM pts a JOIN pts b ON a.industry_group = b.industry_group AND a.k = b.k GROUP BY ALL
),
ab AS (
  SELECT industry_group, k, job_id, max(CASE WHEN own = cluster AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN own <> cluster THEN total / n END) AS b FROM d GROUP BY ALL
),
sc AS (SELECT industry_group, k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab GROUP BY ALL)
SELECT industry_group, CAST(arg_min(k, (-s, k)) AS INTEGER) AS k, round(max(s), 7) AS silhouette FROM sc GROUP BY 1"""
ORACLES["numbered_clusters"] = VECS + """,
pts AS (SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS industry_group, label, job_id FROM vecs),
nums AS (
  SELECT industry_group, label, CAST(row_number() OVER (PARTITION BY industry_group ORDER BY count(*) DESC, min(job_id)) AS INTEGER) AS cluster
  FROM pts GROUP BY 1, 2
)
SELECT industry_group, job_id, cluster FROM pts JOIN nums USING (industry_group, label)"""
