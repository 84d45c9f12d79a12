"""Operators 2, 3 and 8 as a whole against plain versions that see all rows at once."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import isolation_rules, kd_shards, queries, rff_quality

SF = "/root/testdata/sf0.001"


# 2: shards


def tree(rows, leaves):
    """Shard of each row: cut the widest dimension where the first half of the leaves has its share of bytes."""
    spans = [max(r["dims"][i] for r in rows) - min(r["dims"][i] for r in rows) for i in range(len(rows[0]["dims"]))]
    result = {}

    def cut(part, first, n):
        if n == 1:
            result.update((r["doc_id"], first) for r in part)
            return
        width = [max(r["dims"][i] for r in part) - min(r["dims"][i] for r in part) for i in range(len(spans))]
        shares = [w / s if s else 0.0 for w, s in zip(width, spans, strict=True)]
        dim = shares.index(max(shares))
        part = sorted(part, key=lambda r: (r["dims"][dim], r["k1"], r["doc_id"]))
        mark, upto, end = sum(r["size"] for r in part) * (n // 2) / n, 0, 0
        while upto < mark:
            upto += part[end]["size"]
            end += 1
        cut(part[:end], first, n // 2)
        cut(part[end:], first + n // 2, n - n // 2)

    cut(rows, 0, leaves)
    return result


@pytest.mark.parametrize("leaves", [8, 5])
def test_shards_equal_a_tree_in_python(spark, monkeypatch, leaves):
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0.0)
    rng = np.random.default_rng(leaves)
    words = ["short", "muchlongerword", "ünï", "x"]
    data = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))), str(rng.choice(["en", "de", "fr"]))) for i in range(300)]
    data += [(300 + i, "one text of many copies", "en") for i in range(100)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    dims = {"length": F.length("text"), "lang": F.crc32("lang"), "ratio": F.octet_length("text") / (F.length("text") + 1)}
    facts = df.select("doc_id", (F.octet_length("text") + 1).alias("size"), F.shiftright(F.xxhash64("text"), 1).alias("k1"),
                      F.array(*[d.cast("double") for d in dims.values()]).alias("dims")).collect()
    wanted = tree([r.asDict() for r in facts], leaves)
    got = {r.doc_id: r.shard for r in kd_shards.kd_shards(df, dims, shards=leaves).collect()}
    assert got == wanted and len(set(got.values())) == leaves


# 3: quality


def rising(x, y, w):
    """The isotonic fit by its max-min formula, as corners of its pools."""
    order = np.argsort(x)
    x, y, w = x[order], y[order], w[order]
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    n = len(x)
    fit = np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
    pools = np.split(np.arange(n), np.flatnonzero(np.diff(fit) > 1e-12) + 1)
    return [(x[p] * w[p]).sum() / w[p].sum() for p in pools], [fit[p[0]] for p in pools]


def ridge(z, y):
    """Least squares with the penalty as further rows."""
    scale = np.full(z.shape[1], np.sqrt(rff_quality.RIDGE * len(z) / z.shape[1]))
    scale[-1] = np.sqrt(1e-9)
    wide = np.vstack([z, np.diag(scale)])
    return np.linalg.lstsq(wide, np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]


def test_scores_equal_a_direct_fit(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect() if r.quality is not None}
    stats = np.array([rff_quality.statistics((t or "").encode()) for _, t in docs])
    kernel = rff_quality.Kernel(stats.mean(axis=0), stats.std(axis=0))
    fold = np.array([zlib.crc32(str(d).encode()) % 3 for d, _ in docs])
    y = np.array([labels.get(d, np.nan) for d, _ in docs])
    z, used = kernel(stats), ~np.isnan(y) & (fold != 1)
    low, high, cells = rff_quality.LOWEST, rff_quality.HIGHEST, rff_quality.CELLS
    raw = np.zeros(len(docs))
    for f in (0, 2):
        raw[used & (fold == f)] = z[used & (fold == f)] @ ridge(z[used & (fold == 2 - f)], y[used & (fold == 2 - f)])
    cell = np.minimum((np.clip(raw[used], low, high) - low) / (high - low) * cells, cells - 1).astype(int)
    places = np.unique(cell)
    heights = np.array([y[used][cell == c].mean() for c in places])
    weights = np.array([(cell == c).sum() for c in places], float)
    corners = rising(low + (places + 0.5) * (high - low) / cells, heights, weights)
    final = np.clip(z @ ridge(z[used], y[used]), low, high)
    wanted = 0.998 * np.interp(final, *corners) + 0.002 * (final - low) / (high - low)
    got = {r.doc_id: r.score for r in queries.op3_rff_quality(spark, SF).collect()}
    differ = np.array([abs(got[d] - w) for (d, _), w in zip(docs, wanted, strict=True)])
    assert differ.max() < 1e-4


# 8: rules


def test_odd_rows_equal_a_walk_down_each_tree(spark):
    documents, labels = (queries.table(spark, SF, t) for t in ("documents", "labels"))
    stats = isolation_rules.rule_counts(documents).cache()
    forest, threshold = isolation_rules.fit(stats, labels)
    judged = isolation_rules.judge(stats, forest, threshold).collect()

    def path(tree, row, node=0):
        cut = forest.cut[tree, node]
        if not np.isfinite(cut):
            return forest.path[tree, node]
        return path(tree, row, 2 * node + 1 + (row[forest.dim[tree, node]] >= cut))

    odd = {}
    for r in judged:
        row = isolation_rules.ratios(np.array([[r[c] for c in isolation_rules.COUNTS]]))[0]
        total = sum(path(t, row) for t in range(len(forest.dim)))
        odd[r.doc_id] = 2.0 ** (-total / len(forest.dim) / forest.scale)
        assert abs(r.odd - odd[r.doc_id]) < 1e-9
        assert r.kept == (not r.base_failed and r.odd < threshold)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(odd[r.doc_id], known[r.doc_id]) for r in judged if not r.base_failed and known.get(r.doc_id) is not None]
    good, bad = ([o for o, q in rows if q == k] for k in (1, 0))

    def gain(cut):
        lost = sum(int(o * isolation_rules.CELLS) >= cut for o in good) / max(len(good), 1)
        caught = sum(int(o * isolation_rules.CELLS) >= cut for o in bad) / max(len(bad), 1)
        return caught - lost if lost <= 1 - isolation_rules.KEEP_GOOD else -1.0

    best = max(gain(c) for c in range(isolation_rules.CELLS + 2))
    assert gain(round(threshold * isolation_rules.CELLS)) == pytest.approx(best)
