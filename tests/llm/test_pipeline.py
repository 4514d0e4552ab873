import shutil

import pytest
from test_near_duplicates import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "decontaminate", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + f"/stage{k}"
        shutil.rmtree(folder, ignore_errors=True)
        stage(spark, docs, SF).write.parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns[: len(columns)] == columns and 0 < docs.count() <= kept
        kept = docs.count()
    assert docs.columns == [*columns, "n_tokens", "ids", "decoded"]
    assert docs.filter("decoded <> text").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_against_brute_force(spark):
    """Stage by stage: models by their own queries' functions, the rest by all pairs, dynamic search and the library."""
    import sentencepiece
    from pyspark.sql import functions as F

    from granary.llm import decontaminate, language_id, quality
    from granary.llm.sentencepiece_bpe import model_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.train(language_id.training_rows(docs))
    limits = language_id.calibrate(language_id.training_rows(docs), models)
    found = language_id.identify(docs, models, limits).filter("not rejected").select("doc_id")
    docs = docs.join(found, "doc_id", "left_semi")
    trees = quality.train_on_fold(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [(i, t) for i, t in docs.select("doc_id", "text").collect() if trees.score(quality.np.array([quality.statistics(t)]))[0] >= quality.THRESHOLD]
    ids = {i for i, _, _, stays in brute(kept) if stays}
    items = [(i, decontaminate.normalised(t)) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher([x for x in items if x[1]])
    kept = [(i, t) for i, t in kept if i in ids and not matcher.matches(t)]
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    expected = sorted((i, t, len(library.encode(t)), ",".join(map(str, library.encode(t))), library.decode(library.encode(t))) for i, t in kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "text", "n_tokens", "ids", "decoded").collect())) == expected
    assert docs.filter(F.col("doc_id").isNull()).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"the{k} and{k} of{k}" for k in range(40))
    odd = [(10_001, long), (10_001, long), (10_001, None), (None, long), (None, ""), (10_000, long + " more"), (10_002, "the and of that it"), (10_002, "all other words are here now")]
    names = ["found", "_found", "row", "coded", "ids", "n_tokens", "decoded", "first", "component_id", "id"]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    for name in names:
        rows = rows.withColumn(name, rows["lang"])
    one = corpus_pipeline.keep_one_of_duplicates(spark, rows, SF)
    assert one.columns == rows.columns
    # of the long ones the smallest id stays; other texts that share an id stay each; null and empty texts are no one's copies
    assert sorted(map(repr, ((r.doc_id, (r.text or "")[-12:]) for r in one.collect()))) == sorted(map(repr, [(10_000, (long + " more")[-12:]), (10_001, ""), (None, ""), (10_002, "d of that it"), (10_002, "are here now")]))
    more = docs.unionByName(rows.select(docs.columns))
    for name in names:
        more = more.withColumn(name, more["lang"])
    known = corpus_pipeline.keep_known_languages(spark, more, SF)
    assert known.columns == more.columns and known.filter("text is null or text = ''").count() == 0
    for stage in (corpus_pipeline.keep_good_quality, corpus_pipeline.drop_benchmark_leaks):
        assert stage(spark, rows, SF).columns == rows.columns
    last = corpus_pipeline.encode(spark, rows, SF)
    assert last.columns == [c for c in rows.columns if c not in ("ids", "n_tokens", "decoded")] + ["n_tokens", "ids", "decoded"]
    assert {r.n_tokens for r in last.filter("text is null or text = ''").collect()} == {0}
