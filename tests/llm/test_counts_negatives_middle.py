"""Operators 11 to 13 against the library, all pairs, and slow versions."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

import brute
from shelfmark.llm import fill_middle, hard_negatives, queries, token_counts

SF = "/root/testdata/sf0.001"
CLASHING = ("n_bytes", "n_tokens", "draw_key", "form", "output", "restored", "n", "draw_key_")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*brute.odd_rows(), (None, "no id", "en", "src0", 5), (None, "no id", "en", "src0", 5)]
    return spark.createDataFrame(rows, brute.DOC).select("*", *[F.lit(-1).alias(c) for c in CLASHING]).repartition(5).cache()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 11: token counts


def library(model: bytes = b""):
    return sentencepiece.SentencePieceProcessor(model_proto=model or queries.tokenizer_model())


def test_counts_equal_the_library(spark, odd):
    lib = library()
    documents = queries.table(spark, SF, "documents")
    for df in (odd, documents):
        got = token_counts.count_tokens(df, queries.tokenizer_model(), limit=100)
        wanted = [(d, len((t or "").encode()), len(lib.encode(t or ""))) for d, t in pairs(df)]
        assert tuples(got) == sorted([(*w, w[2] > 100) for w in wanted], key=repr)
    whole = queries.op11_token_counts(spark, SF)
    assert {r.doc_id: r.n_tokens for r in whole.collect()} == {d: len(lib.encode(t or "")) for d, t in pairs(documents)}


@pytest.mark.parametrize("part", [5, 262_144])
def test_counts_of_random_texts(monkeypatch, part):
    """Spaces in runs, marks, loners, special strings, parts and generations of a few strings."""
    monkeypatch.setattr(token_counts, "PART_CHARS", part)
    monkeypatch.setattr(token_counts, "REMEMBERED", 9)
    model, lib, rng = queries.tokenizer_model(), library(), random.Random(part)
    counter = token_counts.Counter(model, token_counts.prove(model))
    letters = [*"aebtzxyth  \n\n\t\r\x0b\x0c▁é漢字😀 \x00<>s/.,", "<s>", "</s>", "<unk>", "<0x0A>", "the", "    ", "ing", " of"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 16)))
        assert counter.tokens(text) == len(lib.encode(text)), repr(text)


def test_the_proof_covers_most_of_the_vocabulary():
    model = queries.tokenizer_model()
    proof, lib = token_counts.prove(model), library()
    assert proof.cuts and "\n" in proof.loners and len(proof.whole) > 30_000
    for piece in random.Random(1).sample(sorted(p for p in proof.whole if p.startswith(" ")), 2000):
        assert len(lib.encode(piece[1:])) == 1


@pytest.mark.parametrize("change", ["trim", "map", "user", "inner"])
def test_models_without_proof_are_merged_whole(spark, change):
    proto = model_pb2.ModelProto.FromString(queries.tokenizer_model())
    if change == "trim":
        proto.normalizer_spec.remove_extra_whitespaces = True
    elif change == "map":
        rule = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
        given = model_pb2.ModelProto.FromString(rule.serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = given.normalizer_spec.precompiled_charsmap
    elif change == "user":
        proto.pieces[500].type = 4
    else:
        proto.pieces[500].piece = "of▁the"
    model = proto.SerializeToString()
    assert not token_counts.prove(model).cuts
    texts = ["  ﬁne  ½ text ", "one of the  ", None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, model).collect()}
    assert got == {i: len(library(model).encode(t or "")) for i, t in enumerate(texts)}


def test_counts_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(none, queries.tokenizer_model()).count() == 0


# 12: hard negatives

VECTORS = "vec_id bigint, vector array<float>, label int"


def mined_slowly(rows, is_anchor, positives=5, negatives=10):
    kept = {}
    for vec, vector, label in rows:
        if None in (vec, label) or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * np.float32(x).item()) for x in vector])
        kept[vec] = min(kept.get(vec, row), row)
    result = []
    for anchor, (label, vector) in kept.items():
        if not is_anchor(anchor):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, v, strict=False)), i, lab) for i, (lab, v) in kept.items() if i != anchor
        )
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            result += [(anchor, positive, r, i, -score, -s) for r, (s, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(result, key=repr)


def mined(spark, rows, every=10):
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit(0)).withColumn("v", F.lit("x"))
    return hard_negatives.mine(df, F.col("vec_id") % every == 0, 5, 10, 30, 90)


def odd_vectors(seed: int = 3):
    """Few values, so scores are often equal; one label holds half of the rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(260):
        label = 0 if i % 2 else int(rng.integers(0, 5))
        rows.append((i, [float(x) for x in rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5], 6)], label))
    rows += rows[:20]  # repeated
    rows += [(i, [0.5] * 6, 3) for i in range(30, 40)]  # other vectors and labels of known ids
    rows += [(1000, [0.0] * 6, 1), (1010, [0.25], 2), (1020, [], 0), (1030, [0.5, -0.5] * 5, 0)]
    rows += [(None, [0.5] * 6, 1), (2000, None, 1), (2010, [0.5] * 6, None), (2020, [0.5, None], 1)]
    rows += [(2030, [float("nan")] * 6, 1), (2040, [float("inf"), 0.0], 1), (2050, [float("-inf")], 2)]
    return rows


@pytest.mark.parametrize("cells", [(4096, 2048), (16, 4)])
def test_negatives_equal_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", cells[0])
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cells[1])
    rows = odd_vectors()
    assert tuples(mined(spark, rows)) == mined_slowly(rows, lambda i: i % 10 == 0)


def test_negatives_of_few_rows(spark):
    few = [(0, [0.5, 0.1], 1), (1, [0.4, 0.2], 1), (2, [0.3, 0.0], 2), (10, [0.2, 0.2], 2), (20, [0.1, 0.1], 3)]
    assert tuples(mined(spark, few)) == mined_slowly(few, lambda i: i % 10 == 0)
    assert mined(spark, few[1:3]).count() == 0  # no anchor
    assert mined(spark, []).count() == 0
    assert mined(spark, [(0, None, 1), (10, [1.0], None)]).count() == 0
    same = [(i, [0.5, 0.5], i % 2) for i in range(60)]
    assert tuples(mined(spark, same)) == mined_slowly(same, lambda i: i % 10 == 0)


def test_large_numbers_stay_exact_or_are_refused(spark):
    big = [(i, [float(2**20 + i), float(2**21 - 3 * i)], i % 2) for i in range(25)]
    assert tuples(mined(spark, big)) == mined_slowly(big, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64-bit"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1)]).collect()


def test_the_search_stops_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-128, 128, (4000, 2)).astype(float)
    lists = hard_negatives.Lists(vectors, np.arange(4000))
    anchor = np.array([100.0, -7.0])
    [(best, scores)] = lists.search(anchor, np.ones(4000, bool), [(-np.inf, np.inf)], 5)
    wanted = np.lexsort((np.arange(4000), -(vectors @ anchor)))[:5]
    assert best.tolist() == wanted.tolist() and scores.tolist() == (vectors @ anchor)[wanted].tolist()
    assert lists.scored < 2000


# 13: fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def moved_slowly(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    key = hashlib.sha256(text.encode()).hexdigest() if doc is None else doc
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, len(units), "plain", None, None, text, text)
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    output = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc, len(units), form, len(p), len(m), output, text)


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_middles_equal_the_slow_version(spark, odd, monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK_BYTES", block)
    rng = random.Random(block)
    letters = [*"ab é漢 \n\t😀<>PSM", "word ", "<P", "S>", "<"]
    extra = [(5000 + i, "".join(rng.choices(letters, k=rng.randint(0, 40)))) for i in range(300)]
    extra += [(7000 + i, f"has {m} inside") for i in range(20) for m in ("<P>", "<S>", "<M>")]
    more = spark.createDataFrame(extra, "doc_id bigint, text string")
    keep = odd if block > 3 else odd.where(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    df = keep.unionByName(more, allowMissingColumns=True)
    got = fill_middle.restored(fill_middle.fill_middle(df))
    wanted = sorted((moved_slowly(d, t) for d, t in pairs(df)), key=repr)
    assert tuples(got) == wanted
    assert {w[2] for w in wanted} == {"plain", "spm", "psm"}


def test_cuts_fall_on_units(monkeypatch):
    rng = random.Random(9)
    for block in (1, 2, 7, 4096):
        monkeypatch.setattr(fill_middle, "BLOCK_BYTES", block)
        for _ in range(150):
            text = "".join(rng.choices([*"ab é漢 \n\x0b😀", "word "], k=rng.randint(0, 25)))
            units, blocked = UNIT.findall(text), fill_middle.BlockedText(text.encode())
            assert (blocked.n_units, blocked.n_chars) == (len(units), len(text))
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert blocked.cut(k) == (len(before.encode()), len(before))


def test_middles_of_no_rows_and_other_shares(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fill_middle.restored(fill_middle.fill_middle(none)).count() == 0
    df = spark.createDataFrame([(i, f"a b c {i}") for i in range(50)], "doc_id int, text string")
    forms = {r.form for r in fill_middle.fill_middle(df, fill_middle.Rule(7, 100, 0)).collect()}
    assert forms == {"psm"}
