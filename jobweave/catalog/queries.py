"""Registered queries: each takes (spark, sf_dir) and runs over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.catalog.views import LATIN, postings, table
from jobweave.functions import fixed_values as fv
from jobweave.functions import scalars, text, vectors
from jobweave.operators import (
    bundles,
    embedding,
    kmeans,
    mutual_info,
    profiles,
    prompts,
    regression,
    robust,
    silhouette,
    skills,
    warehouse,
)
from jobweave.plans import flows
from jobweave.schemas import POSTING
from jobweave.session import spread, stage, staging_path
from jobweave.sources import files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = "industry_group"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def money(value: str | Column, digits: int = 4) -> Column:
    """Rounded so that two engines summing in different orders agree."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).transform(scalars.prepare_postings)


def staged_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The salary sample over a written job table, as the analyses read it several times.

    Writing first also keeps the sample's filter from being pushed through the
    expressions that compute its columns.
    """
    jobs = prepared(spark, sf_dir).select("job_id", KEY, "job_skills", "avg_salary", "exp_numeric")
    return stage(jobs, "jobs").transform(scalars.salary_sample)


# --- scalar columns -------------------------------------------------------------


@query
def experience_numeric(spark, sf_dir):
    return postings(spark, sf_dir).transform(scalars.add_experience).select(
        "job_id", "experience_required", money("exp_numeric", 6).alias("exp_numeric")
    )


@query
def salary_per_month(spark, sf_dir):
    return postings(spark, sf_dir).transform(scalars.add_salary).select(
        "job_id",
        money("salary_min_norm").alias("salary_min_norm"),
        money("salary_max_norm").alias("salary_max_norm"),
        money("avg_salary").alias("avg_salary"),
    )


@query
def skill_token_list(spark, sf_dir):
    return postings(spark, sf_dir).transform(scalars.add_skills).select(
        "job_id", F.array_join("skills_list", "|").alias("skills"), F.size("skills_list").alias("n_tokens")
    )


@query
def embedding_tag_list(spark, sf_dir):
    tags = text.tag_list(F.col("job_skills"))
    return postings(spark, sf_dir).select("job_id", F.array_join(tags, "|").alias("tags"), F.size(tags).alias("n_tags"))


@query
def sentence_list(spark, sf_dir):
    sentences = text.sentence_list(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(sentences).alias("n_sentences"), F.array_join(sentences, "").alias("sentence")
    )


@query
def salary_sample(spark, sf_dir):
    return staged_sample(spark, sf_dir).select(
        "job_id", KEY, money("avg_salary").alias("avg_salary"), money("exp_years", 6).alias("exp_years")
    )


@query
def experience_buckets(spark, sf_dir):
    years = scalars.experience_score(F.col("experience_required")) * 10.0
    return (
        postings(spark, sf_dir)
        .groupBy(scalars.experience_bucket(years).alias("exp_bucket"))
        .agg(F.count(F.lit(1)).alias("n_jobs"))
    )


# --- skill statistics and bundles -----------------------------------------------


@query
def skill_counts(spark, sf_dir):
    counts = skills.skill_counts(skills.job_skills(prepared(spark, sf_dir)))
    return counts.select(
        KEY, "skill", "token_cnt", "job_cnt", "first_job", "first_pos"
    )


@query
def job_skill_matrix(spark, sf_dir):
    tokens = skills.job_skills(prepared(spark, sf_dir))
    valid = skills.skill_counts(tokens)
    return tokens.join(valid.select(KEY, "skill"), [KEY, "skill"], "left_semi").select(KEY, "job_id", "skill")


@query
def skill_matrix_wide(spark, sf_dir):
    tokens = skills.job_skills(prepared(spark, sf_dir))
    return skills.wide_matrix(tokens, ["ECONOMY", "MEDIUM", "SMALL"])


@query
def feature_names(spark, sf_dir):
    counts = skills.skill_counts(skills.job_skills(prepared(spark, sf_dir)))
    return skills.feature_names(stage(counts, "counts"))


def _pairs(spark, sf_dir, threshold):
    jobs = stage(prepared(spark, sf_dir).select("job_id", KEY, "skills_list"), "jobs")
    valid = stage(bundles.varying_skills(skills.plain_counts(jobs), skills.industry_sizes(jobs)), "skills")
    return bundles.skill_correlations(jobs, valid, threshold).select(
        KEY, "skill_a", "skill_b", "n_a", "n_b", "n_both", F.round("phi", 8).alias("phi")
    )


@query
def skill_correlations(spark, sf_dir):
    return _pairs(spark, sf_dir, 0.0)


@query
def skill_edges(spark, sf_dir):
    return _pairs(spark, sf_dir, fv.MERGE_MIN_CORRELATION)


@query
def skill_components(spark, sf_dir):
    jobs = stage(prepared(spark, sf_dir).select("job_id", KEY, "skills_list"), "jobs")
    return bundles.bundle_members(jobs).select(KEY, "skill", F.col("bundle").alias("component"))


@query
def skill_merge_preview(spark, sf_dir):
    jobs = stage(prepared(spark, sf_dir).select("job_id", KEY, "skills_list"), "jobs")
    return bundles.merge_preview(bundles.bundle_members(jobs))


@query
def merged_job_skills(spark, sf_dir):
    jobs = stage(prepared(spark, sf_dir).select("job_id", KEY, "skills_list"), "jobs")
    return bundles.apply_merges(jobs, bundles.bundle_members(jobs)).select("job_id", KEY, "merged_job_skills")


# --- salary analysis, medium industries -----------------------------------------


@query
def industry_routes(spark, sf_dir):
    return skills.route_industries(skills.industry_sizes(staged_sample(spark, sf_dir)))


@query
def skill_budgets(spark, sf_dir):
    return skills.skill_budgets(skills.industry_sizes(staged_sample(spark, sf_dir)))


@query
def skill_presence_medians(spark, sf_dir):
    return robust.skill_contrasts(staged_sample(spark, sf_dir)).select(
        KEY, "skill", "n_with_skill", "n_without_skill", money("median_premium").alias("median_premium")
    )


@query
def skill_bucket_medians(spark, sf_dir):
    return robust.skill_contrasts(staged_sample(spark, sf_dir)).select(KEY, "skill", F.explode("buckets").alias("b")).select(
        KEY, "skill", F.col("b.bucket").alias("exp_bucket"), F.col("b.w").alias("w"), money("b.diff").alias("diff")
    )


@query
def skill_value_robust(spark, sf_dir):
    rows = robust.robust_skill_values(staged_sample(spark, sf_dir))
    return rows.withColumns({c: money(c) for c in ("median_premium", "coarse_match_premium", "pure_skill_value")})


# --- requirement text -----------------------------------------------------------


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def spread_documents(spark, sf_dir):
    return spread(documents(spark, sf_dir).select("doc_id", "text"))


@query
def normalized_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query
def one_line_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.one_line(F.col("text")).alias("text"))


@query
def requirement_section(spark, sf_dir):
    return spread_documents(spark, sf_dir).select("doc_id", text.requirement_section(F.col("text"), LATIN).alias("section"))


@query
def cleaned_lines(spark, sf_dir):
    lines = F.posexplode(text.split_lines(F.col("text"), LATIN)).alias("pos", "line")
    return spread_documents(spark, sf_dir).select("doc_id", lines)


def _segments(spark, sf_dir):
    parts = F.posexplode(text.line_segments(text.split_lines(F.col("text"), LATIN))).alias("pos", "segment")
    return spread_documents(spark, sf_dir).select("doc_id", parts)


@query
def line_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query
def ignored_segments(spark, sf_dir):
    return _segments(spark, sf_dir).where(text.is_ignored(F.col("segment"), LATIN))


@query
def classified_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("doc_id", "pos", text.classify_line(F.col("segment"), LATIN).alias("label"))


@query
def other_requirement(spark, sf_dir):
    return spread_documents(spark, sf_dir).select(
        "doc_id", text.other_requirement(F.col("text"), LATIN).alias("other_requirement")
    )


@query
def frequent_phrases(spark, sf_dir):
    return profiles.frequent_phrases(spread(documents(spark, sf_dir).select("lang", "text")), ["lang"], "text").withColumnRenamed("value", "phrase")


# --- cluster profiles -----------------------------------------------------------


def clustered_postings(spark, sf_dir):
    """Postings of industries with enough jobs, clustered by required experience."""
    jobs = prepared(spark, sf_dir)
    sizes = skills.industry_sizes(jobs, fv.CLUSTER_MIN_JOBS)
    cluster = F.when(F.col("exp_numeric") < 0.2, 1).when(F.col("exp_numeric") < 0.5, 2).otherwise(3)
    return profiles.staged_clusters(jobs.join(sizes.select(KEY), KEY, "left_semi").withColumn("cluster", cluster))


@query
def clusterable_industries(spark, sf_dir):
    return skills.industry_sizes(prepared(spark, sf_dir), fv.CLUSTER_MIN_JOBS)


@query
def cluster_sizes(spark, sf_dir):
    return profiles.cluster_sizes(clustered_postings(spark, sf_dir))


@query
def top_titles(spark, sf_dir):
    return profiles.top_titles(clustered_postings(spark, sf_dir)).withColumnRenamed("value", "job_title")


@query
def core_skills(spark, sf_dir):
    return profiles.core_skills(clustered_postings(spark, sf_dir)).withColumnRenamed("value", "skill")


@query
def most_common_labels(spark, sf_dir):
    jobs = clustered_postings(spark, sf_dir)
    return profiles.most_common(jobs, "experience_required").join(
        profiles.most_common(jobs, "education_required"), profiles.KEYS
    )


@query
def salary_means(spark, sf_dir):
    return profiles.salary_means(clustered_postings(spark, sf_dir))


@query
def sampled_texts(spark, sf_dir):
    sampled = profiles.sample_texts(clustered_postings(spark, sf_dir), profiles.KEYS, "other_requirement")
    return sampled.select(*profiles.KEYS, "job_id", "value")


@query
def cluster_profiles(spark, sf_dir):
    return profiles.cluster_profiles(clustered_postings(spark, sf_dir))


@query
def cluster_prompts(spark, sf_dir):
    return prompts.cluster_prompts(clustered_postings(spark, sf_dir))


def _answered(spark, sf_dir):
    """Profiles, prompts and a cache that holds replies for the first cluster of each industry.

    Replies are derived from the prompts: fenced, bare, chatty or broken JSON by cluster and size.
    """
    jobs = clustered_postings(spark, sf_dir)
    asked = stage(prompts.cluster_prompts(jobs), "prompts")
    body = F.concat(F.lit('{"profile_name": " '), F.substring("cache_key", 1, 30), F.lit('", "other_requirements": ["'),
                    F.substring("cache_key", 1, 4), F.lit('", " ", "'), F.substring("cache_key", 5, 4), F.lit('"]}'))
    kind = F.substring("cache_key", 64, 1)
    reply = (
        F.when(kind < "4", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind < "8", F.concat(F.lit("Here it is: "), body, F.lit(" Regards")))
        .when(kind < "c", body)
        .otherwise("no answer {")
    )
    cache = prompts.read_replies(asked.where("cluster = 1").select("cache_key", reply.alias("reply")))
    return jobs, asked, cache


@query
def cached_replies(spark, sf_dir):
    _, asked, cache = _answered(spark, sf_dir)
    return prompts.cached_replies(asked, cache).select(
        *profiles.KEYS, "cache_key", "profile_name", F.array_join("other_requirements", "；").alias("other_requirements")
    )


@query
def open_prompts(spark, sf_dir):
    _, asked, cache = _answered(spark, sf_dir)
    return prompts.open_prompts(asked, cache).select(*profiles.KEYS, "cache_key")


@query
def named_profiles(spark, sf_dir):
    jobs, asked, cache = _answered(spark, sf_dir)
    return prompts.apply_replies(profiles.cluster_profiles(jobs), asked, cache).select(
        KEY, "cluster_id", "profile_name", "other_requirements"
    )


# --- warehouse tables -----------------------------------------------------------


def _warehouse_jobs(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "job_id",
        "job_title",
        F.concat(F.lit("company "), F.col("job_title")).alias("company_name"),
        F.col("salary_min").cast("string").alias("min_salary"),
        F.col("salary_max").cast("string").alias("max_salary"),
        F.col("education_required").alias("city"),
        F.col(KEY).alias("industry"),
        F.col("job_skills").alias("required_skills"),
        F.col("experience_required").alias("experience_requirement"),
        F.col("education_required").alias("education_requirement"),
        F.col("other_requirement").alias("job_description"),
    )


def _warehouse_users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").alias("age"),
        F.col("c_mktsegment").alias("education"),
        F.col("c_name").alias("work_experience"),
        F.concat_ws(",", "c_mktsegment", "c_name").alias("skills"),
        F.col("c_mktsegment").alias("industry_preference"),
        F.col("c_acctbal").alias("salary_expectation"),
        F.concat_ws(",", "c_nationkey", "c_custkey").alias("location_preference"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def _warehouse_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("value").alias("job_id"),
        F.col("event_type").alias("interaction_type"), F.col("ts").alias("interaction_time"), F.col("ts").alias("created_at"),
    )


@query
def job_feature_table(spark, sf_dir):
    return warehouse.job_features(_warehouse_jobs(spark, sf_dir)).drop("created_at", "updated_at", "job_description").withColumns(
        {
            "skills_required": F.array_join("skills_required", "|"),
            "salary_min": money("salary_min"),
            "salary_max": money("salary_max"),
        }
    )


@query
def user_feature_table(spark, sf_dir):
    lists = ("skills", "industry_preference", "location_preference")
    return warehouse.user_features(_warehouse_users(spark, sf_dir)).drop("created_at", "updated_at").withColumns(
        {c: F.array_join(c, "|") for c in lists}
    )


@query
def interaction_table(spark, sf_dir):
    return warehouse.interactions(_warehouse_events(spark, sf_dir))


@query
def key_figures(spark, sf_dir):
    figures = warehouse.key_figures(
        stage(warehouse.job_features(_warehouse_jobs(spark, sf_dir)).select("location", "industry", "salary_min", "salary_max"), "jobs"),
        _warehouse_users(spark, sf_dir),
        _warehouse_events(spark, sf_dir),
        table(spark, sf_dir, "nation"),
    )
    return figures.drop("metric_time", "created_at", "updated_at").withColumn("metric_value", money("metric_value"))


# --- vectors --------------------------------------------------------------------


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("job_id"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def _fingerprint(vector: Column) -> list[Column]:
    """Size, length and a position-weighted sum: every dimension and its place count."""
    weighted = F.transform(vector, lambda x, i: x * (i + 1))
    return [
        F.size(vector).alias("dims"),
        F.round(vectors.norm(vector), 5).alias("norm"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 5).alias("weighted_sum"),
    ]


def _tagged(spark, sf_dir):
    """Postings with a vector per known brand: vector n belongs to the tag Brand#n."""
    lookup = embeddings(spark, sf_dir).select(F.concat(F.lit("Brand#"), F.col("job_id")).alias("tag"), "vec")
    jobs = stage(prepared(spark, sf_dir).select("job_id", "exp_numeric", "job_skills"), "prepared")
    return embedding.tag_vectors(jobs, text.tag_list(F.col("job_skills")), lookup, 64)


@query
def tag_vectors(spark, sf_dir):
    return _tagged(spark, sf_dir).select("job_id", *_fingerprint(F.col("skill_vec")))


@query
def job_vectors(spark, sf_dir):
    vector = vectors.job_vector(F.col("exp_numeric"), F.col("skill_vec"), F.reverse("skill_vec"))
    return _tagged(spark, sf_dir).select("job_id", *_fingerprint(vector))


@query
def unit_vectors(spark, sf_dir):
    unit = F.posexplode(vectors.l2_normalize(F.col("vec"))).alias("dim", "value")
    return embeddings(spark, sf_dir).select("job_id", unit).withColumn("value", F.round("value", 8))


@query
def weighted_features(spark, sf_dir):
    exp, skill, other = vectors.half_split(F.col("vec"))
    values = F.posexplode(vectors.weighted_features(exp, skill, other)).alias("dim", "value")
    return embeddings(spark, sf_dir).select("job_id", values).withColumn("value", F.round("value", 8))


def _seeds(spark, sf_dir):
    kind = F.when(F.col("job_id") < 5, "experience").when(F.col("job_id") < 10, "skill").otherwise("other")
    return embeddings(spark, sf_dir).where("job_id < 15").select(kind.alias("class"), "vec")


@query
def seed_labels(spark, sf_dir):
    near = embedding.seed_similarity(embeddings(spark, sf_dir), "vec", _seeds(spark, sf_dir))
    return near.select(
        "job_id", embedding.seed_label().alias("label"), *[F.round(f"sim_{c}", 8).alias(f"sim_{c}") for c in ("experience", "skill", "other")]
    )


@query
def document_vectors(spark, sf_dir):
    docs = spread_documents(spark, sf_dir).withColumnRenamed("doc_id", "job_id")
    coded = embedding.text_vectors(docs, "text", embedding.hashed_ngrams(64), 64)
    return coded.select("job_id", *_fingerprint(F.col("other_vec")))


@query
def tag_sentence_vectors(spark, sf_dir):
    jobs = postings(spark, sf_dir)
    coded = embedding.tag_sentence_vectors(jobs, text.tag_list(F.col("job_skills")), embedding.hashed_ngrams(64), 64)
    return coded.select("job_id", *_fingerprint(F.col("skill_vec")))


@query
def seeded_other_requirement(spark, sf_dir):
    """Documents classified by rules, then by nearest seed phrase for what no rule decides."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("job_id"), "text")
    encode = embedding.hashed_ngrams(64)
    return embedding.add_other_requirement(docs, "text", encode, embedding.default_seeds(spark, encode), LATIN).select(
        "job_id", "other_requirement"
    )


# --- clusters -------------------------------------------------------------------


def _labelled_points(spark, sf_dir):
    """Embeddings in two industries, with their given label as the only model."""
    industry = F.when(F.col("label") < 5, "low").otherwise("high")
    return embeddings(spark, sf_dir).select(
        industry.alias(KEY), "job_id", F.col("vec").alias("features"), F.array("label").alias("labels")
    )


@query
def silhouette_rows(spark, sf_dir):
    return silhouette.row_scores(stage(_labelled_points(spark, sf_dir), "points")).select(
        KEY, "job_id", "cluster", F.round("score", 7).alias("score")
    )


@query
def silhouette_scores(spark, sf_dir):
    return silhouette.silhouette_scores(stage(_labelled_points(spark, sf_dir), "points")).select(
        KEY, F.round("silhouette", 7).alias("silhouette")
    )


@query
def chosen_k(spark, sf_dir):
    """k by silhouette among four given groupings of the labels, two to five clusters."""
    settings = kmeans.Settings(max_k=5)
    models = F.array(*[F.col("labels")[0] % k for k in settings.counts])
    points = stage(_labelled_points(spark, sf_dir).withColumn("labels", models), "points")
    return silhouette.choose_k(points, settings).select(KEY, "k", F.round("silhouette", 7).alias("silhouette"))


@query
def numbered_clusters(spark, sf_dir):
    points = stage(_labelled_points(spark, sf_dir).select(KEY, "job_id", F.col("labels")[0].alias("label")), "labelled")
    return silhouette.number_clusters(points)


@query
def nearest_centroids(spark, sf_dir):
    """One assignment step to given centroids, the mean vector of every label, in two industries."""
    points, centroids = _labelled_points(spark, sf_dir), _label_means(spark, sf_dir)
    shared = spark.sparkContext.broadcast({name: {len(centroids): centroids} for name in ("low", "high")})
    return kmeans.assign(points.drop("labels"), shared, [len(centroids)]).select(KEY, "job_id", F.col("labels")[0].alias("nearest"))


def _label_means(spark, sf_dir):
    """Mean vectors of the labels in their order: as many rows as there are labels."""
    mean = kmeans.vector_to_array(kmeans.Summarizer.mean(kmeans.array_to_vector(F.col("vec")))).alias("mean")
    rows = embeddings(spark, sf_dir).where("label is not null").groupBy("label").agg(mean).orderBy("label").collect()
    return kmeans.np.array([r["mean"] for r in rows])


@query
def lloyd_round(spark, sf_dir):
    """One round of k-means from the label means: the new centroids and the inertia before the move."""
    centroids = _label_means(spark, sf_dir)
    shared = spark.sparkContext.broadcast({"low": [(0, centroids)], "high": [(1, centroids)]})
    moved = kmeans.assigned_means(_labelled_points(spark, sf_dir), shared)
    return moved.select(
        F.when(F.col("model") == 0, "low").otherwise("high").alias(KEY), "cluster", *_fingerprint(F.col("mean")), F.round("inertia", 5).alias("inertia")
    )


@query
def clustered_embeddings(spark, sf_dir):
    points = stage(_labelled_points(spark, sf_dir), "points")
    return silhouette.cluster_industries(points).withColumn("silhouette", F.round("silhouette", 6))


# --- salary analysis, large industries ------------------------------------------


def _large(spark, sf_dir):
    sample = staged_sample(spark, sf_dir)
    sizes = skills.industry_sizes(sample, fv.REGRESSION_MIN_JOBS)
    return stage(sample.join(sizes.select(KEY), KEY, "left_semi"), "large"), sizes


def _selected(sample, sizes):
    return stage(mutual_info.select_skills(mutual_info.mutual_information(sample, sizes), skills.skill_budgets(sizes)), "selected")


@query
def mutual_information(spark, sf_dir):
    sample, sizes = _large(spark, sf_dir)
    return mutual_info.mutual_information(sample, sizes).select(KEY, "skill", F.round("mi", 7).alias("mi"))


@query
def selected_skills(spark, sf_dir):
    return _selected(*_large(spark, sf_dir)).select(KEY, "skill", "rank")


def _terms(spark, sf_dir):
    sample, sizes = _large(spark, sf_dir)
    tokens = skills.job_skills(sample)
    terms = stage(regression.leftover_terms(tokens, _selected(sample, sizes)), "leftover")
    return terms, sizes


@query
def leftover_terms(spark, sf_dir):
    return _terms(spark, sf_dir)[0]


@query
def leftover_tfidf(spark, sf_dir):
    terms, sizes = _terms(spark, sf_dir)
    rows = regression.tfidf_rows(terms, regression.term_weights(terms, sizes))
    return rows.select(KEY, "job_id", F.explode("vec").alias("x")).select(
        KEY, "job_id", F.col("x.f").alias("term"), F.round("x.v", 8).alias("weight")
    )


@query
def leftover_gram(spark, sf_dir):
    terms, sizes = _terms(spark, sf_dir)
    rows = regression.tfidf_rows(terms, regression.term_weights(terms, sizes))
    return regression.gram(rows, "vec").withColumn("s", F.round("s", 6))


@query
def residual_context(spark, sf_dir):
    terms, sizes = _terms(spark, sf_dir)
    rows = regression.tfidf_rows(terms, regression.term_weights(terms, sizes))
    return regression.residual_context(rows).select(
        KEY, "job_id", *[F.round(f"residual_context_{i}", 6).alias(f"residual_context_{i}") for i in (1, 2, 3)]
    )


@query
def regression_moments(spark, sf_dir):
    """Feature products of the regression without the context columns, whose signs are free."""
    sample, sizes = _large(spark, sf_dir)
    rows = regression.design_rows(sample, skills.job_skills(sample), _selected(sample, sizes), None)
    return regression.moments(rows).withColumn("s", F.round(F.col("s") / 1e6, 4))


@query
def experience_slopes(spark, sf_dir):
    """The solver on intercept and experience alone, where SQL has the same fit built in."""
    sample, sizes = _large(spark, sf_dir)
    rows = regression.design_rows(sample, skills.job_skills(sample), _selected(sample, sizes), None)
    plain = rows.withColumn("feats", F.filter("feats", lambda x: x["f"].isin("intercept", "exp")))
    coefs = regression.solve(regression.moments(plain))
    return coefs.groupBy(KEY).agg(
        F.round(F.max(F.when(F.col("f") == "intercept", F.col("coef"))), 4).alias("intercept"),
        F.round(F.max(F.when(F.col("f") == "exp", F.col("coef"))), 4).alias("slope"),
    )


@query
def plain_exp_curve(spark, sf_dir):
    """The experience curve of the two experience terms alone, which SQL can solve in closed form."""
    sample, sizes = _large(spark, sf_dir)
    none = _selected(sample, sizes).where("rank < 1")
    rows = regression.design_rows(sample, skills.job_skills(sample), none, None)
    curve = regression.exp_curve(regression.solve(regression.moments(rows)))
    return curve.withColumn("predicted_salary", F.round("predicted_salary", 2))


@query
def skill_impact(spark, sf_dir):
    impact = regression.skill_impact(*regression.fit_industries(staged_sample(spark, sf_dir)))
    rounded = {c: F.round(c, 2) for c in ("coefficient", "std_err", "ci_lower", "ci_upper")}
    return impact.withColumns({**rounded, "p_value": F.round("p_value", 6)})


@query
def exp_curve(spark, sf_dir):
    curve = regression.exp_curve(regression.fit_industries(staged_sample(spark, sf_dir))[1])
    return curve.withColumn("predicted_salary", F.round("predicted_salary", 2))


# --- files ----------------------------------------------------------------------


@query
def csv_text_round_trip(spark, sf_dir):
    """All documents out to CSV (quotes, line breaks, byte order mark) and back as strings."""
    path = staging_path(spark, "csv")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, files.T.StructType.fromDDL("doc_id string, lang string, text string"))


@query
def csv_typed_round_trip(spark, sf_dir):
    path = staging_path(spark, "csv")
    files.write_csv(postings(spark, sf_dir).select(*POSTING.fieldNames()), path)
    return files.read_postings(spark, path).select(
        "job_id", KEY, "job_skills", "experience_required", *[money(c).alias(c) for c in ("salary_min", "salary_max")]
    )


@query
def saved_table_round_trip(spark, sf_dir):
    """The interaction table saved in the catalog and read by name."""
    rows = warehouse.interactions(_warehouse_events(spark, sf_dir))
    tables.save_table(rows, "interaction_round_trip", path=staging_path(spark, "interaction-table"))
    return _forget(spark, "interaction_round_trip")


def _forget(spark, name):
    """A saved external table whose name is given up; its files stay."""
    rows = spark.read.schema(tables.load_table(spark, name).schema).parquet(tables.table_path(spark, name))
    spark.sql(f"DROP TABLE {name}")
    return rows


@query
def warehouse_flow(spark, sf_dir):
    """Source tables to saved feature tables to key figures, as one flow."""
    built = flows.build_warehouse(
        _warehouse_jobs(spark, sf_dir), _warehouse_users(spark, sf_dir), _warehouse_events(spark, sf_dir), table(spark, sf_dir, "nation")
    )
    root = staging_path(spark, "warehouse")
    flows.save_warehouse(built, prefix="flow_", root=root)
    saved = {name: _forget(spark, f"flow_{name}") for name in built}
    figures = warehouse.key_figures(
        saved["job_feature_table"], saved["user_feature_table"], saved["interaction_table"], saved["report_static_source"]
    )
    return figures.drop("metric_time", "created_at", "updated_at").withColumn("metric_value", money("metric_value"))


@query
def clustered_files(spark, sf_dir):
    """Clustered postings written one folder per industry, counted from the folders."""
    path = staging_path(spark, "by-industry")
    files.write_clustered(clustered_postings(spark, sf_dir), path)
    return files.read_clustered(spark, path).groupBy("industry_key", "cluster").agg(F.count(F.lit(1)).alias("n_jobs"))


@query
def prompt_files(spark, sf_dir):
    path = staging_path(spark, "prompts")
    files.write_prompts(prompts.cluster_prompts(clustered_postings(spark, sf_dir)), path)
    written = "industry_group string, cluster int, naming_prompt string, requirements_prompt string, cache_key string"
    return spark.read.schema(written).json(path)


@query
def reply_cache_round_trip(spark, sf_dir):
    _, _, cache = _answered(spark, sf_dir)
    path = staging_path(spark, "replies")
    files.write_reply_cache(cache, path)
    return files.read_reply_cache(spark, path).withColumn("other_requirements", F.array_join("other_requirements", "；"))


@query
def experience_from_wide_vectors(spark, sf_dir):
    """Vectors out to flat columns and Parquet; then only the first dimension is read."""
    path = staging_path(spark, "wide")
    files.scatter_vector(embeddings(spark, sf_dir).withColumnRenamed("vec", "job_vec"), 64).write.parquet(path)
    return files.drop_vectors(spark.read.parquet(path)).withColumn("exp_numeric", F.round("exp_numeric", 8))


# --- whole flows ----------------------------------------------------------------


def _job_vectors(spark, sf_dir):
    lookup = embeddings(spark, sf_dir).select(F.concat(F.lit("Brand#"), F.col("job_id")).alias("tag"), "vec")
    return flows.build_job_vectors(postings(spark, sf_dir), embedding.hashed_ngrams(32), 32, lookup, 64).jobs


@query
def posting_features(spark, sf_dir):
    """Experience, salary, merged skills and the mean vector of the merged skills of every posting."""
    lookup = embeddings(spark, sf_dir).select(F.concat(F.lit("Brand#"), F.col("job_id")).alias("tag"), "vec")
    jobs = stage(prepared(spark, sf_dir).select("job_id", KEY, "exp_numeric", "avg_salary", "skills_list"), "prepared")
    merged = stage(bundles.apply_merges(jobs, bundles.bundle_members(jobs)), "merged")
    coded = embedding.tag_vectors(merged, text.tag_list(F.col("merged_job_skills")), lookup, 64)
    return coded.select(
        "job_id", money("exp_numeric", 6).alias("exp_numeric"), money("avg_salary").alias("avg_salary"),
        "merged_job_skills", *_fingerprint(F.col("skill_vec")),
    )


@query
def job_vector_table(spark, sf_dir):
    """Experience, salary, merged skills and vectors of every posting."""
    return _job_vectors(spark, sf_dir).select(
        "job_id", money("exp_numeric", 6).alias("exp_numeric"), money("avg_salary").alias("avg_salary"),
        "merged_job_skills", *_fingerprint(F.col("job_vec")),
    )


@query
def clustered_jobs(spark, sf_dir):
    """Postings to clusters of every industry with enough jobs, with the profile of each."""
    jobs = stage(_job_vectors(spark, sf_dir), "job-vectors")
    return flows.cluster_jobs(jobs).profiles
