import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import language, quality

from . import brute


def test_stages_on_their_own_input(spark, data, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, data)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = out.select(*docs.columns).cache()
        if name == "quality rules":
            cleaned = now.withColumn("text", quality.cleaned_text(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
            assert kept.exceptAll(cleaned.select(*docs.columns)).isEmpty()
            lines = kept.select(F.explode(F.split("text", "\n")).alias("line")).where("line RLIKE '[^ ]'")
            assert lines.where(quality.line_fails(F.col("line"))).isEmpty()
        else:
            assert kept.exceptAll(now).isEmpty()
        if name == "MinHash near-dedup":
            want = brute.components([(r.doc_id, r.text) for r in now.collect()], 80)
            assert {r.doc_id for r in kept.collect()} == {i for i, (_, root) in want.items() if i == root}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            gone = {r.doc_id for r in now.collect()} - {r.doc_id for r in kept.collect()}
            some = [(r.doc_id, r.text) for r in now.collect() if r.doc_id in gone or r.doc_id % 10 == 0]
            assert set(brute.leaks(some, items)) == gone
        now = kept
    assert 0 < now.count() < docs.count()


def test_run_packs_what_is_kept(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty() and out.count() > 0


def test_odd_rows_by_stage(spark, data, odd_docs, no_docs):
    """Which of the odd rows each stage keeps, null ids and repeated rows included."""
    ids = lambda stage, docs: sorted((-1 if r.doc_id is None else r.doc_id for r in stage(spark, docs, data).collect()))
    every = sorted(-1 if r.doc_id is None else r.doc_id for r in odd_docs.collect())
    stages = {name: f for name, f in corpus_pipeline.STAGES}
    assert ids(stages["language ID"], odd_docs) == [-1, 4, 5, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert ids(stages["quality rules"], odd_docs) == [-1, 4, 5, 5, 6, 7, 11, 12]
    assert ids(stages["MinHash near-dedup"], odd_docs) == [-1, -1, 1, 2, 3, 4, 8, 10, 11, 13, 14, 15, 16]
    assert ids(stages["benchmark decontamination"], odd_docs) == every
    pieces = stages["best-fit packing"](spark, odd_docs, data).where("piece = 0")
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in pieces.collect()) == every
    assert all(f(spark, no_docs, data).collect() == [] for f in stages.values())


def test_near_dedup_beyond_a_full_filter(spark, data, docs, monkeypatch):
    """Rows that the filter takes for gone by mistake are told by the join."""
    want = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect())
    full = spark.range(1 << 18).selectExpr("id AS cell", "-1L AS bits")
    monkeypatch.setattr(corpus_pipeline, "bitmap", lambda keys, h: full)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()) == want


def test_clashing_columns_stay(spark, data, docs):
    """Columns that have the names of what the operators make keep their values."""
    names = ("kept", "n_words", "contaminated", "item_ids", "lang_pred", "score", "__text", "a.b", "component_id")
    more = docs.where("doc_id < 40").select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, data)
        assert out.columns == more.columns, name
        rows = out.select("doc_id", *(f"`{n}`" for n in names)).collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name


def test_rejects_what_has_no_letters(spark, data, odd_docs):
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, odd_docs, data).collect()}
    assert not got & {1, 2, 3, 16} and language.learn(odd_docs)["langs"] == ["en"]
