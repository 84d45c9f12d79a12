"""Mix sources to target weights by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution whose mean is the repetition
rate that brings its source to the target share. The draw inverts the distribution at a uniform
number hashed from seed and doc_id, or text where there is no doc_id, so it is the same in every
run and on every retry.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import free_name
from shelfmark.operators.joins import lookup_join
from shelfmark.session import staged

# A mean above this is drawn as a sum of equal independent parts.
PART_MEAN = 16.0
# Steps of the inverted distribution; beyond them lies less than 1e-17 at the mean above.
STEPS = 64
# Upper size of one row of rates: its key, the steps and a few numbers.
RATE_ROW_BYTES = 8 * (STEPS + 1) + 512
UNIFORM_DIGITS = 13


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float],
    default_weight: float = 1.0,
    epochs: float = 1.0,
) -> tuple[DataFrame, int]:
    """One row per source: (source_key, rate, parts, cdf), and the number of sources.

    A document weighs its UTF-8 bytes plus 1. rate = epochs * target share / present share, so
    expected bytes over all sources are epochs times those of the input, whatever the weights.
    A null source is a source of its own (weight: the default).
    """
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source_key") == f"s{name}", F.lit(float(value))).otherwise(weight)
    sizes = staged(
        docs.select(
            _source_key().alias("source_key"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        )
        .groupBy("source_key")
        .agg(F.sum("size").alias("bytes"))
        .withColumn("weight", weight),
        "mix-sizes",
    )
    total, weight_sum, n_sources = sizes.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.sum("weight"), F.count(F.lit(1))
    ).first()
    if n_sources and not weight_sum > 0:
        raise ValueError("the weights of the sources present must have a positive sum")
    rate = F.col("weight") * float(total * epochs) / (F.lit(float(weight_sum or 1)) * F.col("bytes"))
    rates = (
        sizes.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
        .withColumn("mean", F.col("rate") / F.col("parts"))
        .select("source_key", "rate", "parts", _cdf(F.col("mean")).alias("cdf"))
    )
    return rates, n_sources


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """The documents, each as often as drawn, in a global random order.

    Adds copy (1 to n_copies), n_copies and mix_key; columns of these names are replaced. Rows go
    to partitions by the hash of mix_key and are sorted by it inside each, so partitions read one
    after the other are one shuffled sequence. Rows that repeat a doc_id share its draw;
    rows without a doc_id are drawn by their text. A null text weighs 1 byte. No rows in, no rows out.
    """
    rates, n_sources = source_rates(docs, weights, default_weight, epochs)
    kept = docs.drop("copy", "n_copies", "mix_key")
    names = {n: free_name(kept, n) for n in ("source_key", "rate", "parts", "cdf")}
    for old, new in names.items():
        rates = rates.withColumnRenamed(old, new)
    parts, cdf = F.col(names["parts"]), F.col(names["cdf"])
    draws = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda part: _draw(_uniform(seed, part), cdf)
    )
    n_copies = F.aggregate(draws, F.lit(0), lambda total, k: total + k)
    keyed = kept.withColumn(names["source_key"], _source_key())
    counted = lookup_join(
        keyed, rates, [names["source_key"]], "inner", right_bytes=n_sources * RATE_ROW_BYTES
    ).withColumn("n_copies", n_copies)
    return (
        counted.where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("mix_key", F.md5(_seeded(seed, "copy", F.col("copy"))))
        .select(*kept.columns, "copy", "n_copies", "mix_key")
        .repartition(F.col("mix_key"))
        .sortWithinPartitions("mix_key")
    )


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def _seeded(seed: int, use: str, number: Column) -> Column:
    text = F.concat(F.lit("null:"), F.coalesce(F.md5("text"), F.lit("null")))
    doc = F.coalesce(F.col("doc_id").cast("string"), text)
    return F.concat_ws(":", F.lit(str(seed)), F.lit(use), doc, number.cast("string"))


def _uniform(seed: int, part: Column) -> Column:
    """A number in [0, 1) of 52 bits."""
    digits = F.substring(F.md5(_seeded(seed, "draw", part)), 1, UNIFORM_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**UNIFORM_DIGITS))


def _cdf(mean: Column) -> Column:
    """Chances of at most 0, 1, ... STEPS events."""
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("steps")
    )

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        total = state["total"] + p
        return F.struct(
            p.alias("p"), total.alias("total"), F.array_append(state["steps"], total).alias("steps")
        )

    ks = F.array(*[F.lit(float(k)) for k in range(1, STEPS + 1)])
    return F.aggregate(ks, start, step, lambda state: state["steps"])


def _draw(uniform: Column, cdf: Column) -> Column:
    """The smallest k with a chance of at most k events above the uniform number."""
    return F.aggregate(cdf, F.struct(uniform.alias("u"), F.lit(0).alias("k")), lambda s, c: F.struct(
        s["u"].alias("u"), (s["k"] + F.when(c <= s["u"], 1).otherwise(0)).alias("k")
    ), lambda s: s["k"])
