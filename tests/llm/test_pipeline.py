import pyarrow as pa

import corpus_pipeline
from siftprint.llm import langid, neardup, packing, quality, shared

from .test_linededup import brute as brute_lines
from .test_neardup import brute as brute_near
from .test_quality_langid import counts
from .test_tokens_packing import check_packing
from siftprint.llm import tokens


def documents(spark, rows):
    return spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages_and_whole(spark, tmp_path, awkward_rows, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows += [(d + 10_000, *more) for d, *more in {r[0]: r for r in awkward_rows}.values()]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/sf/documents.parquet")
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages.write.parquet(f"{tmp_path}/sf/pages.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()

    # by brute force; the language model's verdict is its own, and tested there
    lang = {r.doc_id: r.kept for r in langid.identify(documents(spark, rows), pages=pages).collect()}
    rows = [r for r in rows if lang[r[0]]]
    verdict = {r.doc_id: r.kept for r in quality.apply_rules(documents(spark, rows)).collect()}
    for d, t, *_ in rows:
        n, *_, repeats = counts(t)
        assert verdict[d] == (n >= 50 and 100 * repeats <= 50 * n)  # no host is rejected here
    rows = [r for r in rows if verdict[r[0]]]
    texts = {d: t for d, (t, _) in brute_lines([r[:2] for r in rows], 50).items()}
    kept = [d for d, (_, _, keep) in brute_near(list(texts.items())).items() if keep]
    n, total = check_packing(got, [(d, texts[d]) for d in kept], 2048, tokens.word_tokenizer_path())
    assert n <= total / 2048 * 1.05 + 2


def test_language_id_takes_effect(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").where("n_chars > 400").select("doc_id", "text", "lang", "source").limit(60).collect()]
    wrong = [(10_000 + d, t, None if d % 2 else "fr" if x != "fr" else "de-AT", s) for d, t, x, s in rows]
    tagged = [(20_000 + d, t, x.upper() + "-XX", s) for d, t, x, s in rows]
    noise = [(30_000, "x" * 5000, "en", None), (None, None, "en", None)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, documents(spark, rows + wrong + tagged + noise), small).collect()}
    want = {d: x for d, _, x, _ in rows}
    assert got == want | {10_000 + d: x for d, x in want.items()} | {20_000 + d: x for d, x in want.items()}


def test_stages_keep_columns(spark, awkward_rows):
    docs = documents(spark, list({r[0]: r for r in awkward_rows}.values()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert stage(spark, docs.where("false"), "").count() == 0, name
        assert out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), "").columns == [x.split()[0] for x in packing.SCHEMA.split(", ")]


def test_rows_without_ids(spark):
    docs = documents(spark, [(None, "w " * 60 + str(i), "en", None) for i in range(3)])
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 3
    assert neardup.near_duplicates(docs).where("component_id IS NULL").count() == 3


def test_batches_bounded_by_bytes(spark):
    own = spark.newSession()  # as a caller's: without session()'s bound of rows
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = own.range(6000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 400) AS text", "'en' AS lang", "'h' AS source", "0L AS n_chars")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    for _, stage in corpus_pipeline.STAGES:
        own.conf.unset(key)
        stage(own, docs.where("doc_id < 3"), "")
        got = [r.n for r in docs.select("doc_id", "text").mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 10_000_000 and max(got) < 1.5 * shared.BATCH_BYTES
    own.conf.set(key, "12345")
    corpus_pipeline.line_dedup(own, docs.where("doc_id < 3"), "")
    assert own.conf.get(key) == "12345"  # a bound of the caller's stays


def test_sample_needs_no_workers_of_its_own(spark, monkeypatch):
    docs = documents(spark, [(i, "the cat sat on the mat and slept", "en", None) for i in range(5)] + [(9, "le chat dort sur le tapis gris", "fr", None)]).cache()
    assert docs.count() == 6

    def parallelize(*_, **__):
        raise AssertionError("rows pickled to an RDD are read by further Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    langs, _, _ = langid.fit(langid._rows(docs, "doc_id", "text", docs["lang"], None, False))
    assert langs == ["en", "fr"]
