import corpus_pipeline
from tests.llm import brute


def test_every_stage_keeps_odd_rows_and_columns(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    text = docs.where("doc_id = 2").first().text
    spark.createDataFrame([(1, " ".join(text.split()[:12]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, no_docs):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, given, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.count() <= given.count()
            if given is no_docs:
                assert out.count() == 0


def test_run_takes_effect(spark, tmp_path):
    words = [f"w{k}" for k in range(400)]
    clean = [" ".join(words[(7 * i + 3 * k) % 400] for k in range(60)) for i in range(40)]
    leak = " ".join(f"secret{k}" for k in range(15))
    insult = "you are an idiot and a moron you scum you pathetic worthless loser idiot"
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100, clean[0]), (101, clean[1].replace("w", "w", 1) + " tail"), (102, clean[2] + " " + leak), (103, clean[3][:150] + " " + insult)]
    docs += [(104, " ".join(reversed(clean[5].split())) + " mail me a.b@example.com or 10.2.3.4")]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {i for (i, c, _) in brute.near_classes([d for d in docs if d[0] != 103]) if i == c}
    assert set(got) == kept and 103 not in got and 100 not in got
    assert all("secret" not in r.text for r in got.values())
    assert got[104].text.endswith("mail me [EMAIL] or [IP]") and got[104].n_chars == len(got[104].text)
    assert got[7].text == clean[7] and got[7].n_tokens > 60
