from __future__ import annotations

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

import brute
from shelfmark.llm import poisson_mix, queries, rff_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it has written."""
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["quality classifier"]
    scores = rff_quality.quality(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    good = {r.doc_id for r in scores.where("predicted = 1").collect()}
    assert {r.doc_id for r in after} == good and len(good) > len(before) / 2
    before, after = kept["line dedup"]
    wanted = brute.without_frequent_lines([(r.doc_id, r.text) for r in before], queries.MIN_DOCS)
    assert {r.doc_id: r.text or "" for r in after} == {d: t for d, _, _, t in wanted}
    before, after = kept["SimHash near-dedup"]
    rows = sorted((r.doc_id, r.text) for r in before)
    roots = brute.linked([brute.simhash(t) for _, t in rows])
    assert sorted(r.doc_id for r in after) == sorted({rows[i][0] for i in roots})
    before, after = kept["mixing sources to target weights"]
    ids = {r.doc_id for r in before}
    assert {r.doc_id for r in after} <= ids
    before, after = kept["SentencePiece encoding and decoding"]
    lib = sentencepiece.SentencePieceProcessor(model_proto=queries.tokenizer_model())
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for row in after[:50]:
        assert row.ids == lib.encode(texts[row.doc_id] or "", add_bos=True, add_eos=True)
        assert row.text == lib.decode(row.ids)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in after)


def test_stages_on_no_rows_and_on_odd_rows(spark, tmp_path):
    rows = brute.odd_rows() + [(0, None, None, None, None), (None, "no id", None, None, 5)]
    docs = spark.createDataFrame(rows, brute.DOC).withColumn("copy", F.lit(1)).withColumn("fp", F.lit("x"))
    docs = docs.drop("copy")
    labels = spark.createDataFrame([(r[0], int(i % 4 > 0), 0) for i, r in enumerate(rows)], "doc_id bigint, quality int, toxic int")
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    for start in (docs.limit(0), docs):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{folder}/{start is docs}-{i}"
            stage(spark, now, folder).write.parquet(path)
            now = spark.read.parquet(path)
        assert (now.count() > 0) == (start is docs)


def test_mixing_is_a_choice_of_the_rows(spark):
    docs = queries.table(spark, SF, "documents")
    mixed = poisson_mix.mix(docs, queries.MIX_WEIGHTS, seed=queries.MIX_SEED)
    assert mixed.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("NOT (text <=> t)").count() == 0
