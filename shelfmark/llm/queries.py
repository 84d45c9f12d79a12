"""The operators of this package over the given tables, with the SQL they must agree with."""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bloom_cascade,
    doubling,
    fill_middle,
    hard_negatives,
    isolation_rules,
    kd_shards,
    line_runs,
    neighbours,
    pieces,
    poisson_mix,
    rff_quality,
    simhash_ring,
    token_counts,
)
from shelfmark.llm.common import UPPER, table

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

SHARDS = 8
MIN_DOCS = 10
SHINGLE_WORDS = 3
DISTANCE = 3
MIX_SEED = 17
# Parts of the mixture: this source gets three, every other one.
MIX_WEIGHTS = {"src0": 3.0}
TOKEN_LIMIT = 4096
# Positives of an anchor, negatives of a positive, and the negatives' scores in percent of the positive's.
POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
FIM_SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
ALLOW_RULES = [("com", "/"), ("www.example.com", "/en/")]
BLOCK_RULES = [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]


@functools.cache
def tokenizer_model(path: str = f"{TOKENIZER_DIR}/piece_bpe_32k.model") -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _code(column: str) -> Column:
    """A place in [0, 1) for a name."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 20)) / F.lit(float(1 << 20))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_bytes: where the span of the last piece ends, which is the length of the text."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_model(), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("ids_packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).alias("source_bytes"),
    )


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions are facts that equal texts share, so that copies part only at a cut."""
    docs = table(spark, sf_dir, "documents")
    chars = F.coalesce(F.char_length("text"), F.lit(0))
    dims = {
        "length": F.log(chars + 1),
        "lang": _code("lang"),
        "bytes_per_char": F.coalesce(F.octet_length("text"), F.lit(0)) / (chars + 1),
    }
    return kd_shards.kd_shards(docs, dims, shards=SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_DOCS)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op5_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_ring.near_groups(table(spark, sf_dir, "documents"), SHINGLE_WORDS, DISTANCE)
    return groups.select("doc_id", simhash_ring.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = poisson_mix.mix(docs, MIX_WEIGHTS, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "copy", "n_copies", "mix_key", F.md5("text").alias("text_md5"))


def op7_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = doubling.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = bloom_cascade.filter_urls(pages, ALLOW_RULES, BLOCK_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_model(), limit=TOKEN_LIMIT)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    relabelled = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(
        vectors.withColumn("label", relabelled), anchors=F.pmod("vec_id", F.lit(100)) == 0,
        positives=POSITIVES, negatives=NEGATIVES, least_percent=LEAST_PERCENT, most_percent=MOST_PERCENT,
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = fill_middle.Rule(FIM_SEED, FIM_PERCENT, SPM_PERCENT)
    moved = fill_middle.restored(fill_middle.fill_middle(table(spark, sf_dir, "documents"), rule))
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_kd_shards, op3_rff_quality, op4_line_runs, op5_simhash_ring,
        op6_poisson_mix, op7_doubling, op8_isolation_rules, op9_bloom_cascade, op10_minhash,
        op11_token_counts, op12_hard_negatives, op13_fill_middle,
    )
}

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RULES = ", ".join(
    f"('{host}', '{path}', '{verdict}')"
    for verdict, rules in (("allow", ALLOW_RULES), ("block", BLOCK_RULES))
    for host, path in rules
)
_WEIGHT = "CASE " + " ".join(f"WHEN source = '{s}' THEN {w}" for s, w in MIX_WEIGHTS.items()) + " ELSE 1.0 END"

ORACLE = {
    "op4_line_runs": f"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), keyed AS (
            SELECT doc_id, lines, [translate(trim(l, {_STRIP}), '{UPPER}', '{UPPER.lower()}') FOR l IN lines] AS keys
            FROM split
        ), frequent AS (
            SELECT key FROM (SELECT unnest(list_distinct(keys)) AS key FROM keyed)
            WHERE key <> '' GROUP BY key HAVING count(*) >= {MIN_DOCS}
        ), flat AS (
            SELECT doc_id, unnest(lines) AS line, unnest(keys) AS key, unnest(range(len(lines))) AS pos FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(frequent.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (frequent.key IS NULL), '')) AS kept_sha256
        FROM flat LEFT JOIN frequent USING (key) GROUP BY doc_id
    """,
    "op6_poisson_mix": f"""
        WITH sizes AS (
            SELECT source, sum(coalesce(strlen(text), 0) + 1) AS bytes, {_WEIGHT}::DOUBLE AS weight
            FROM documents GROUP BY source
        ), rates AS (
            SELECT source, weight * (SELECT sum(bytes) FROM sizes)::DOUBLE
                / ((SELECT sum(weight) FROM sizes) * bytes::DOUBLE) AS rate
            FROM sizes
        ), parts AS (
            SELECT source, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean
            FROM rates
        ), chances AS (
            SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
            FROM parts, (SELECT unnest(range(65)) AS k)
        ), cdf AS (
            SELECT source, list(upto ORDER BY k) AS steps FROM chances GROUP BY source
        ), draws AS (
            SELECT doc_id, d.source, text, steps, ('0x' || substr(md5(concat_ws(':', '{MIX_SEED}', 'draw', doc_id, part)), 1, 13))::BIGINT
                / 4503599627370496.0 AS u
            FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
            JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source, unnest(range(parts)) AS t(part)
        ), counted AS (
            SELECT doc_id, source, any_value(text) AS text, sum(len(list_filter(steps, lambda c: c <= u)))::INT AS n_copies
            FROM draws GROUP BY doc_id, source
        ), copies AS (
            SELECT doc_id, source, text, unnest(range(1, n_copies + 1))::INT AS copy, n_copies FROM counted WHERE n_copies > 0
        )
        SELECT doc_id, source, copy, n_copies, md5(concat_ws(':', '{MIX_SEED}', 'copy', doc_id, copy)) AS mix_key,
            md5(text) AS text_md5
        FROM copies
    """,
    "op7_doubling": rf"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, start, array_to_string(words[start:start + {doubling.WINDOW_WORDS - 1}], ' ') AS phrase
            FROM split, unnest(range(1, len(words) - {doubling.WINDOW_WORDS - 2})) AS t(start)
        ), later AS (
            SELECT doc_id, start FROM (SELECT *, min(doc_id) OVER (PARTITION BY phrase) AS first FROM windows)
            WHERE doc_id > first
        ), gone AS (
            SELECT DISTINCT doc_id, start + step AS pos FROM later, unnest(range({doubling.WINDOW_WORDS})) AS t(step)
        ), flat AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split
        ), kept AS (
            SELECT doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL) AS text
            FROM flat LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op9_bloom_cascade": rf"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
        fits AS (
            SELECT page_id, rule_host || rule_path AS rule, rule_verdict FROM parts JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule_verdict) = 1
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
    """,
    "op12_hard_negatives": f"""
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score
            FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
        ), negatives AS (
            SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
            FROM positives JOIN scored USING (anchor_id) WHERE NOT alike
                AND 100 * score BETWEEN {LEAST_PERCENT} * positive_score AND {MOST_PERCENT} * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives
        WHERE rank <= {NEGATIVES}
    """,
    "op13_fill_middle": rf"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('{FIM_SEED}:' || doc_id) AS hash,
                regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
            FROM documents
        ), drawn AS (
            SELECT *, len(units)::BIGINT AS n, ('0x' || substr(hash, 1, 8))::BIGINT % (n + 1) AS one,
                ('0x' || substr(hash, 9, 8))::BIGINT % (n + 1) AS other,
                CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(hash, 17, 8))::BIGINT % 100 >= {FIM_PERCENT}
                    THEN 'plain' WHEN ('0x' || substr(hash, 25, 8))::BIGINT % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
            FROM split
        ), cut AS (
            SELECT *, array_to_string(units[1:least(one, other)], '') AS p, array_to_string(units[greatest(one, other) + 1:], '') AS s,
                array_to_string(units[least(one, other) + 1:greatest(one, other)], '') AS m
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM cut
    """,
}
