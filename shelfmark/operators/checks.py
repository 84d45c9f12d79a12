"""Key, null and reference rules of the tables, as queries for the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import joins

# Size of one id row and its overhead.
ID_ROW_BYTES = 16


def breaks_null_rule(schema: T.StructType, given: Sequence[str]) -> Column:
    """Whether a row has a null in a NOT NULL column, among the columns the caller gives."""
    required = [F.col(f.name).isNull() for f in schema.fields if not f.nullable and f.name in given]
    return reduce(lambda a, b: a | b, required, F.lit(False))


def null_count(schema: T.StructType, given: Sequence[str]) -> Column:
    return F.count_if(breaks_null_rule(schema, given))


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Image ids used by ``children`` that ``parents`` lacks, with their number of rows.

    Children are counted per id before the shuffle. Few parents are broadcast. Among many, a small
    set of children looks up its own ids, which costs one scan of the parents' ids.
    """
    used = children.groupBy("image_id").agg(F.count(F.lit(1)).alias("children"))
    ids = parents.select("image_id")
    if ids.count() * ID_ROW_BYTES <= joins.MAX_BROADCAST_BYTES:
        return used.join(F.broadcast(ids), "image_id", "left_anti")
    size = used.count() * ID_ROW_BYTES
    found = joins.lookup_join(
        ids, used.select("image_id"), ["image_id"], "left_semi", size
    )
    return joins.lookup_join(used, found, ["image_id"], "left_anti", size)


def in_use(ids: DataFrame, *children: DataFrame) -> DataFrame:
    """Child rows that refer to one of the (distinct) ids, as ids."""
    used = reduce(DataFrame.unionByName, [c.select("image_id") for c in children])
    return joins.lookup_join(used, ids, ["image_id"], "left_semi")
