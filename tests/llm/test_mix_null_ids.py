from __future__ import annotations

from shelfmark.llm import poisson_mix


def test_rows_without_doc_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text {i:04}", "a") for i in range(2000)] + [(None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = poisson_mix.mix(df, {}, seed=17).collect()
    assert 1800 < len(mixed) < 2200
    assert len({r.n_copies for r in mixed}) > 2
    assert len({r.mix_key for r in mixed}) == len(mixed)
    again = poisson_mix.mix(df.repartition(3), {}, seed=17).collect()
    assert sorted(r.mix_key for r in again) == sorted(r.mix_key for r in mixed)
