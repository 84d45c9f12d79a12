from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

import brute
from shelfmark.llm import (
    bloom_cascade,
    doubling,
    isolation_rules,
    kd_shards,
    line_runs,
    minhash,
    neighbours,
    pieces,
    poisson_mix,
    queries,
    rff_quality,
    simhash_ring,
)

SF = "/root/testdata/sf0.001"
CLASHING = ("ids", "n_lines", "shard", "slot", "copy", "fp", "score", "host", "kept", "line_drop", "cdf", "ring_id", "id", "rate")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with other columns named like those that operators use or add."""
    return spark.createDataFrame(brute.odd_rows(), brute.DOC).select(
        "*", *[F.lit(-1).alias(c) for c in CLASHING]
    ).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.DOC)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1: pieces


def encoded_as_library(df, proto, texts):
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
    encoded = pieces.encode(df, proto, decoded=True).withColumn("again", F.col("ids"))
    got = pieces.decode(encoded, proto, ids="again").collect()
    assert len(got) == len(texts) and all(r.text == r.decoded for r in got)
    for row in got:
        text = texts[row.doc_id] or ""
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert row.ids == ids
        assert row.ids_packed == np.array(ids, "<u4").tobytes()
        assert row.text == lib.decode(ids)
        raw = text.encode()
        spans = list(zip(row.begins, row.ends, strict=True))
        assert all(0 <= a <= b <= len(raw) for a, b in spans)
        for a, b in spans:
            raw[a:b].decode()  # on borders of characters
    return got


def test_pieces_equal_the_library(odd):
    model = queries.tokenizer_model()
    got = encoded_as_library(odd, model, dict(pairs(odd)))
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = {r.doc_id: r for r in got}[10 * 3]
    text = dict(pairs(odd))[10 * 3]
    for i, a, b in zip(plain.ids[1:-1], plain.begins[1:-1], plain.ends[1:-1], strict=True):
        assert text[a:b].replace(" ", "▁") in lib.id_to_piece(i)
    assert plain.ends[-1] == len(text.encode())


def test_spans_equal_the_librarys_offsets(spark):
    """The library tells begin and end of each piece in code points of the source text."""
    model = queries.tokenizer_model()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    loaded = pieces.Model(model)
    for text in ["Hello  world, this is it.", "É ÀÇ é naïve  ▁ ▁▁ x", "漢字 and 😀 😀emoji", "tab\tand\nlines \n", " a", "a "]:
        proto = lib.encode(text, return_type="proto")
        ids = np.array([p.id for p in proto.pieces], np.int64)
        begins, ends = loaded.spans(text.encode(), ids)
        raw = text.encode()
        for piece, begin, end in zip(proto.pieces, begins.tolist(), ends.tolist(), strict=True):
            own = raw[begin:end].decode()
            if piece.piece.startswith("<0x"):  # each byte of a character spans the character here
                assert piece.surface in ("", own)
            elif piece.begin < piece.end:
                assert own == piece.surface, (text, piece)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_pieces_through_a_compiled_map(spark, rule):
    """The library's own maps, put into the given model: longest prefixes, trimmed white space."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = model_pb2.ModelProto.FromString(queries.tokenizer_model())
    given = model_pb2.ModelProto.FromString(normalizer.serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = given.normalizer_spec.precompiled_charsmap
    texts = [
        "  ＡＢＣ　ﬁne  ½ text ", "ｶﾞｷﾞ Å Å ①", "e\u0301 é", "", "   ", None, "İstanbul Straße", "a\u200bb\tc\r\nd",
    ]
    for trim in (True, False):
        proto.normalizer_spec.remove_extra_whitespaces = trim
        blob = proto.SerializeToString()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        encoded_as_library(df, blob, dict(enumerate(texts)))
        loaded, lib = pieces.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
        for text in texts:
            raw = (text or "").encode()
            joined = "".join(lib.encode(text or "", out_type=str))
            new, begins, ends = loaded.normalized(raw)
            assert len(new) == len(begins) == len(ends)
            if "<0x" not in joined:
                assert new.decode() == joined
            assert not len(begins) or (np.diff(begins) >= 0).all()
    wide = pieces.Model(blob)
    new, begins, ends = wide.normalized("xﬁ".encode())
    assert new.endswith(b"fi") and begins[-2:].tolist() == [1, 1] and ends[-2:].tolist() == [4, 4]


# 2: shards


def test_shards_are_even_and_gapless(spark, odd):
    dims = {"length": F.coalesce(F.length("text"), F.lit(0)), "lang": F.crc32("lang")}
    rows = kd_shards.kd_shards(odd, dims, shards=3).collect()
    texts = dict(pairs(odd))
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items()
    }
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    documents = queries.table(spark, SF, "documents")
    sizes = [r.b for r in queries.op2_kd_shards(spark, SF).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    largest = documents.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(sizes) == queries.SHARDS and max(sizes) - min(sizes) <= 2 * largest


def test_shards_follow_the_weighted_medians(spark):
    """The first cut is on the widest dimension, where half of the bytes lie below."""
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(0, 50)), float(rng.integers(0, 40)), float(rng.integers(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, wide double, flat double")
    got = {r.doc_id: r for r in kd_shards.kd_shards(df, {"w": F.col("wide"), "f": F.col("flat") * 0}, shards=2).collect()}
    left = [rows[d] for d, r in got.items() if r.shard == 0]
    right = [rows[d] for d, r in got.items() if r.shard == 1]
    assert max(r[2] for r in left) <= min(r[2] for r in right)
    assert abs(sum(len(r[1]) + 1 for r in left) - sum(len(r[1]) + 1 for r in right)) <= 102


def test_shards_of_equal_rows_and_none(spark, none):
    same = spark.createDataFrame([(i, "same") for i in range(64)], "doc_id bigint, text string")
    counts = kd_shards.kd_shards(same, {"n": F.length("text")}, shards=8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [8] * 8
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    assert kd_shards.kd_shards(twice, {"n": F.length("text")}, shards=2).count() == 3
    assert kd_shards.kd_shards(none, {"n": F.length("text")}, target_bytes=10).count() == 0


# 3: quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_rff_quality(spark, sf).cache()
    known = got.join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert got.count() == queries.table(spark, sf, "documents").count()
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    good, bad = known[known.quality == 1].score.to_numpy(), known[known.quality == 0].score.to_numpy()
    area = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert area > 0.97
    assert (known.predicted == known.quality).mean() > 0.95
    assert known[known.quality == 1].predicted.mean() > 0.98


def test_quality_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, _) in enumerate(pairs(odd))], "doc_id bigint, quality int, toxic int")
    got = rff_quality.quality(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _ in pairs(odd)}
    assert {r.doc_id: r.held_out for r in got.collect()} == held
    unlabelled = rff_quality.quality(odd, labels.limit(0))
    assert {r.score for r in unlabelled.collect()} == {0.5}
    assert rff_quality.quality(none, labels).count() == 0
    kept = rff_quality.keep_good(odd, labels, least=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_isotonic_pools():
    x, y = rff_quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and 0.5 in y


# 4: lines


@pytest.mark.parametrize("batches", [1, 7])
def test_frequent_lines(odd, batches):
    got = line_runs.drop_frequent_lines(odd, 10, batches=batches)
    assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    mine = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect())
    assert mine == sorted(brute.without_frequent_lines(pairs(odd), 10))


def test_lines_of_odd_tables(spark, none):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a"), (2, None), (2, "c\na")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_runs.drop_frequent_lines(df, 4)
    assert tuples(got.select("doc_id", "text", "n_dropped")) == sorted(
        [(1, "b", 1), (1, "b", 1), (None, "", 1), (2, None, 0), (2, "c", 1)], key=repr
    )
    assert line_runs.drop_frequent_lines(none, 2).count() == 0


def test_runs_are_compacted(spark):
    runs = line_runs.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(6):
        rows = [(1, 1, 1), (2, batch, 1), (3, batch // 3, 1)]
        runs.add(spark.createDataFrame(rows, "k1 bigint, k2 bigint, n bigint"))
    keys, n = runs.frequent()
    assert sorted(map(tuple, keys.collect())) == [(1, 1), (3, 0), (3, 1)] and n == 3
    assert len(runs.levels) > 2 and runs.settled
    runs.close()


# 5: SimHash


def test_simhash_groups(spark, odd):
    rng = np.random.default_rng(5)
    base = rng.choice([f"word{i}" for i in range(5000)], 300).tolist()
    near = [(5000 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(0, 300, 6)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id bigint, text string"))
    rows = sorted(pairs(df))
    prints = [brute.simhash(t) for _, t in rows]
    roots = brute.linked(prints)
    wanted = {d: (f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, roots, strict=True)}
    got = simhash_ring.near_groups(df).withColumn("hex", simhash_ring.hexadecimal(F.col("fp")))
    assert {r.doc_id: (r.hex, r.component_id) for r in got.collect()} == wanted
    kept = simhash_ring.keep_one(df.withColumn("ring_id", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in wanted.values()})


@pytest.mark.parametrize("hot", [512, 8])
def test_simhash_links_equal_all_pairs(spark, monkeypatch, hot):
    """Random fingerprints with neighbours of up to four bits, also where keys are hot."""
    monkeypatch.setattr(simhash_ring, "HOT_MEMBERS", hot)
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**64, 40, dtype=np.uint64).tolist()
    for value in prints[:20] + [prints[0]] * 60:
        bits = rng.choice(64, int(rng.integers(1, 5)), replace=False)
        prints.append(int(value) ^ sum(1 << int(b) for b in bits))
    prints = sorted(set(prints), key=lambda p: p - 2**64 if p >> 63 else p)
    roots = brute.linked(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    edges = simhash_ring.fingerprint_links(nodes)
    got = {r.node: r.root for r in simhash_ring.components(edges).collect()}
    assert {p: got.get(p, p) for p in signed} == {p: signed[r] for p, r in zip(signed, roots, strict=True)}
    if hot == 512:
        links = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
        assert {tuple(r) for r in edges.collect()} == links


def test_blocks_of_hot_keys_are_bounded_by_near_members_too(spark, monkeypatch):
    """Nine rows have the key, thousands lie near it; every row with the key meets all others."""
    monkeypatch.setattr(simhash_ring, "HOT_MEMBERS", 8)
    rows = [(1, i, False) for i in range(9)] + [(1, 100 + i, True) for i in range(5000)]
    dealt = simhash_ring._dealt(spark.createDataFrame(rows, "key bigint, fp bigint, near boolean")).cache()
    groups = dealt.groupBy("one", "two").agg(F.collect_set("fp").alias("fps")).collect()
    assert max(len(g.fps) for g in groups) <= 4 * 8
    met = {(a, b) for g in groups for a in g.fps if a < 9 for b in g.fps if a != b}
    assert met == {(a, b) for a in range(9) for _, b, _ in rows if a != b}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash_ring.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90}


def test_simhash_without_rows_or_ids(spark, none):
    assert simhash_ring.near_groups(none).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b"), (None, "c d e f")], "doc_id bigint, text string")
    assert sorted(r.component_id or -1 for r in simhash_ring.near_groups(df).collect()) == [-1, 4, 4, 4, 4]
    assert tuples(simhash_ring.keep_one(df)) == [(4, "a b"), (None, "c d e f")]


# 6: mixing


def test_mixing_repeats_to_the_weights(spark, none):
    rows = [(i, "x" * (i % 50), "big" if i % 10 else "small") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = poisson_mix.mix(df, {"big": 1.0, "small": 1.0}).cache()
    size = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.length("text") + 1).alias("n")).collect()}
    assert abs(size["small"] / size["big"] - 1) < 0.06
    assert tuples(mixed.select("doc_id", "copy", "mix_key")) == tuples(poisson_mix.mix(df.repartition(3), {}).select("doc_id", "copy", "mix_key"))
    counts = mixed.where("copy = 1 AND source = 'small'").groupBy("n_copies").count().collect()
    drawn = {r.n_copies: r["count"] for r in counts}
    mean = sum(k * n for k, n in drawn.items()) / 2000
    spread = sum(k * k * n for k, n in drawn.items()) / 2000 - mean**2
    assert abs(spread / mean - 1) < 0.15
    assert poisson_mix.mix(none, {}).count() == 0


def test_mixing_odd_rows(spark, odd):
    mixed = poisson_mix.mix(odd, {"src0": 2.0, "src1": 0.0}, epochs=40.0)
    rows = mixed.collect()
    assert {"src0", "src2", None} == {r.source for r in rows}
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    assert all(sorted(x.copy for x in found) == list(range(1, found[0].n_copies + 1)) for found in per.values())
    assert mixed.columns == [c for c in odd.columns if c != "copy"] + ["copy", "n_copies", "mix_key"]


# 7: repeats


def test_repeats(spark, odd, none):
    more = spark.createDataFrame([(7000, brute.LONG[:400] + " gap " + brute.LONG[300:900]), (7001, brute.PASSAGE)], "doc_id bigint, text string")
    df = odd.select("doc_id", "text", "id").unionByName(more.withColumn("id", F.lit(0)))
    for parts in (1, 6):
        got = tuples(doubling.drop_repeats(df.repartition(parts)))
        assert got == sorted(brute.without_repeats(pairs(df)), key=repr)
    assert doubling.drop_repeats(none).count() == 0


def test_repeats_of_shared_and_missing_ids(spark):
    rows = [(1, brute.PASSAGE), (1, brute.PASSAGE), (1, f"x {brute.PASSAGE}"), (None, brute.PASSAGE), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = tuples(doubling.drop_repeats(df).select("doc_id", "n_words", "n_removed"))
    assert got == sorted([(1, 30, 0), (1, 30, 0), (1, 31, 0), (None, 30, 30), (None, 1, 0)], key=repr)


@pytest.mark.parametrize("window", [1, 5, 13, 40, 100])
def test_repeats_level_by_level(spark, window):
    """Passages of 6 to 150 words that a few texts share, whole or cut, among words of their own."""
    rng = np.random.default_rng(window)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    passages = [rng.choice(vocabulary, n).tolist() for n in (6, 14, 30, 45, 80, 101, 150)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(int(rng.integers(0, 4))):
            text += rng.choice(vocabulary, int(rng.integers(0, 40))).tolist()
            passage = passages[int(rng.integers(0, len(passages)))]
            start = int(rng.integers(0, 3))
            text += passage[start : len(passage) - int(rng.integers(0, 3))]
        rows.append((int(rng.integers(0, 10**6)) * 100 + i, " ".join(text)))
    lengths = doubling.levels(window)
    assert lengths[-1] == window and all(a <= b <= 2 * a for a, b in zip(lengths, lengths[1:], strict=False))
    got = tuples(doubling.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), window))
    assert got == sorted(brute.without_repeats(rows, window), key=repr)
    alone = [(i, " ".join(rng.permutation(vocabulary))) for i in range(3)]
    got = tuples(doubling.drop_repeats(spark.createDataFrame(alone, "doc_id bigint, text string"), max(window, 30)))
    assert [r[2] for r in got] == [0, 0, 0]


def test_repeats_where_a_third_has_no_id(spark):
    """Rows without doc_id lose what any other row has, and take nothing from each other; each text is a group
    of its own."""
    rng = np.random.default_rng(4)
    own = [" ".join(rng.choice([f"q{i}" for i in range(2000)], 20)) for _ in range(120)]
    rows = [(i if i % 3 else None, f"{text} {brute.PASSAGE if i % 2 else ''}") for i, text in enumerate(own)]
    rows += [(None, own[1]), (None, own[0]), (None, own[0]), (5000, own[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    slow = brute.without_repeats([(10**6 if d is None else d, t) for d, t in rows])
    wanted = sorted(((None if d == 10**6 else d, *rest) for d, *rest in slow), key=repr)
    assert tuples(doubling.drop_repeats(df)) == wanted


# 8: rules


def test_rule_counts(odd):
    got = {r.doc_id: tuple(r)[1:] for r in isolation_rules.rule_counts(odd).collect()}
    assert got == {d: brute.rule_counts(t) for d, t in pairs(odd)}


def test_rules_find_labelled_junk(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_isolation_rules(spark, sf).cache()
    known = got.join(queries.table(spark, sf, "labels"), "doc_id").where("NOT base_failed").toPandas()
    assert known[known.quality == 1].kept.mean() > 0.99
    assert known[known.quality == 0].kept.mean() < 0.05
    assert got.where("base_failed AND kept").count() == 0


def test_rules_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(51, 1, 0), (54, 0, 0), (63, 0, 0), (63, None, 0)], "doc_id bigint, quality int, toxic int")
    assert isolation_rules.quality_rules(odd, labels).count() == odd.count()
    bare = isolation_rules.quality_rules(odd, labels.limit(0))
    assert all(r.kept != r.base_failed for r in bare.collect())
    assert isolation_rules.quality_rules(none, labels).count() == 0


# 9: URLs

URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.Example.com/en/x?q#f", "http://www.example.com/en/",
    "http://x.www.example.com/en/1", "http://badexample.com/en/", "ftp://net/es/", "http://b.net/fr/z", "http://b.net/fr",
    "http://net?x/es/", "http://net#/es/", "x://y://net/es/", "http://a..com/", "http://É.com/é",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(brute.LOWER)
    fits = [
        (len(h + p), v == "allow", h + p, v)
        for v, rules in (("allow", queries.ALLOW_RULES), ("block", queries.BLOCK_RULES))
        for h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = bloom_cascade.filter_urls(df, queries.ALLOW_RULES, queries.BLOCK_RULES)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: judged(u) for i, u in enumerate(URLS)}
    assert bloom_cascade.filter_urls(df.limit(0), queries.ALLOW_RULES, queries.BLOCK_RULES).count() == 0
    assert {r.verdict for r in bloom_cascade.filter_urls(df, [], [], default="block").collect()} == {"block"}


@pytest.mark.parametrize("n_listed", [0, 1, 300, 9000])
def test_cascade_is_exact(spark, n_listed):
    universe = spark.range(9000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where(F.pmod(F.crc32("key"), F.lit(9000)) < n_listed)
    cascade = bloom_cascade.build_cascade(listed, universe)
    found = universe.where(cascade.contains(F.col("key")))
    assert tuples(found) == tuples(listed)
    assert n_listed not in (300,) or len(cascade.levels) > 1


# 10: fingerprints


def test_edited_fingerprints(spark, odd, none):
    rows = sorted(((d, t or "") for d, t in pairs(odd)), reverse=True)
    sign = {t: minhash.signature(t.encode()) for _, t in rows}
    wanted = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        other = minhash.signature(edited.encode())
        wanted[doc] = (
            len(text), sha(edited), sign[text].tobytes().hex(), other.tobytes().hex(),
            float((sign[text] == other).mean()), float((sign[text] == sign[after]).mean()),
        )
    for parts in (1, 7):
        got = neighbours.edited_fingerprints(odd.repartition(parts))
        assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == wanted
    assert neighbours.edited_fingerprints(none).count() == 0
    one = neighbours.edited_fingerprints(spark.createDataFrame([(None, "abc")], "doc_id bigint, text string")).first()
    assert (one.doc_id, one.edited_sha256, one.near_next) == (None, sha("aba"), 1.0)


@pytest.mark.parametrize("hot", [None, 7])
def test_neighbours_where_one_id_holds_many_rows(spark, hot):
    """Half of the rows have no doc_id, or one: they are cut into blocks by their texts' hashes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "bc", "def", "ghij"], int(rng.integers(0, 12)))) for _ in range(240)]
    rows = [(i if i % 2 else hot, t if i % 9 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    keyed = df.select(F.coalesce("doc_id", F.lit(neighbours.NO_ID)).alias("key"), F.xxhash64("text").alias("sub"), "doc_id", "text")
    order = sorted(((r.key, r.sub, r.text or "", r.doc_id) for r in keyed.collect()), key=lambda r: r[:3], reverse=True)
    wanted = []
    for i, (_, _, text, doc) in enumerate(order):
        after, cut = order[(i + 1) % len(order)][2], len(text) // 3
        wanted.append((doc, sha(text[: len(text) - cut] + after[:cut])))
    got = neighbours.edited_fingerprints(df).select("doc_id", "edited_sha256")
    assert tuples(got) == sorted(wanted, key=repr)
    block_of = neighbours._blocks(keyed, 16)
    sizes = np.bincount(block_of(np.array([r[0] for r in order]), np.array([r[1] for r in order])))
    assert sizes.max() < 60


def test_signatures_equal_a_slow_minhash(spark):
    """Python integers, shingle by shingle and place by place; the share of equal places tells the similarity."""
    a, b = [int(x) for x in minhash._A], [int(x) for x in minhash._B]
    mask, step, mix = 2**64 - 1, int(minhash._STEP), int(minhash._MIX)

    def slow(text):
        found = [xxhash.xxh64_intdigest(w) for w in text.lower().encode().split()]
        shingles = set()
        for i in range(max(len(found) - 4, 1) if found else 0):
            total = 0
            for h in found[i : i + 5]:
                total = (total * step + h) & mask
            shingles.add((total ^ (total >> 32)) * mix & mask)
        return [min(((s * x + y) & mask for s in shingles), default=mask) >> 24 & 0xFFFF for x, y in zip(a, b, strict=True)]

    base = [f"w{i}" for i in range(300)]
    edited = base[:40] + ["new"] + base[40:200] + base[230:]
    texts = ["", "one", "Five words are one SHINGLE", " ".join(base), " ".join(edited), brute.PASSAGE]
    for text in texts:
        assert minhash.signature(text.encode()).tolist() == slow(text)
    one, other = (minhash.signature(" ".join(x).encode()) for x in (base, edited))
    sets = [set(minhash.shingle_hashes(" ".join(x).encode()).tolist()) for x in (base, edited)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(minhash.likeness(one, other) - exact) < 0.12


def test_minhash_links(spark, odd):
    rng = np.random.default_rng(2)
    base = rng.choice([f"w{i}" for i in range(900)], 400).tolist()
    near = [(9000 + k, " ".join(base[: 400 - 15 * k] + [f"n{k}{j}" for j in range(15 * k)])) for k in range(5)]
    df = spark.createDataFrame(near + [(9100, near[0][1]), (1, near[0][1]), (None, near[0][1]), (2, None)], "doc_id bigint, text string")
    members, links = minhash.links(df)
    assert {r.doc_id: r.class_id for r in members.collect()}[9100] == 1
    sets = {d: set(minhash.shingle_hashes(t.encode()).tolist()) for d, t in [(1, near[0][1]), *near[1:]]}
    exact = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b
    }
    assert {(r.left_id, r.right_id): r.jaccard for r in links.collect()} == {k: v for k, v in exact.items() if v >= 0.8}


# all


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    wanted = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(df.columns)
    assert tuples(df.select(*columns)) == sorted(wanted.fetchall(), key=repr)
