"""What several operators need: columns with defined values for nulls, free column names, ASCII case."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else unchanged. Pure ASCII takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts of a batch as UTF-8; null counts as empty."""
    values = batch.column(column)
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes or elements of a column, or of one row."""
    values = batch.column(column)
    count = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    start, total = 0, 0
    for i, size in enumerate(pc.fill_null(count(values), 0).to_pylist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows:
        yield batch.slice(start)


def arrow_map(
    df: DataFrame, columns: Sequence[str], schema: str, rows: Callable[[pa.RecordBatch], dict]
) -> DataFrame:
    """Apply a function from a batch to a dict of columns; the dict's order is the schema's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(rows(batch))

    return df.select(*columns).mapInArrow(run, schema)
