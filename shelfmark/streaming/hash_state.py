"""The registry's hashes as the state of a stream, so that a micro-batch of a large registry reads its own rows
only.

What commits have added or removed since the last question, and the hashes that are asked for, are fed to a
stateful query, which keeps one mark for each registered hash in Spark's state store and answers which of the
asked ones have none. The first question feeds the whole registry, later ones only what is new in it; after a
compaction, which reads the whole table anyway, a new state is begun. Marks come from commits alone, so a file
that was asked for and then failed is asked for again.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import storage
from shelfmark.operators.joins import lookup_join
from shelfmark.registry import BASE, CHANGE, CHANGE_FIELDS, DELETE, INSERT, Part, Registry, State
from shelfmark.schema import TABLES

# A row tells that a hash is registered or not from some part on, or asks for it under a number and a token.
FEED = "hash string, at bigint, known boolean, token string"
# Parts of one batch, at most, as a power of two.
_PARTS = 20


def judged(fed: DataFrame) -> DataFrame:
    """For each hash the last of what is told of it and the last question that asks for it. Aggregates of Spark's
    own: rows of a hash are combined per task, and its row in the state is as small as one of the feed."""
    asks = F.col("token").isNotNull()
    return fed.groupBy("hash").agg(
        F.max(F.when(~asks, F.struct("at", "known"))).alias("last"),
        F.max(F.when(asks, F.struct("at", "token"))).alias("asked"),
    )


def _place(part: Part) -> int:
    """Order of a part among all: its batch, then its number in it."""
    batch, number, _ = part.path.rsplit("batch=", 1)[1].split("-")
    return (int(batch) << _PARTS) + int(number)


class HashState:
    """Answers for one registry; what it keeps lies below ``folder``. One question at a time."""

    def __init__(self, registry: Registry, folder: str):
        self._registry, self._spark, self._folder = registry, registry.spark, folder

    def unknown(self, rows: DataFrame, state: State) -> DataFrame:
        """Rows whose hash is not registered in this state of the registry. Copies all stay."""
        bases = [_place(p) for p in state.parts if p.table == "images" and p.kind == BASE]
        name = f"seen-{state.since}-{max(bases, default=0)}"
        for old in storage.names(self._spark, self._folder) or []:
            if old != name:
                storage.delete(self._spark, os.path.join(self._folder, old))
        root = os.path.join(self._folder, name)
        self._feed_commits(root, state)
        token, number = uuid.uuid4().hex, self._next_question(root)
        asked = rows.where("hash IS NOT NULL").select("hash").distinct()
        self._feed(root, asked.withColumns({"token": F.lit(token), "at": F.lit(number).cast("bigint")}))
        self._answer(root, token)
        answers = os.path.join(root, "answers", f"token={token}")
        if not storage.exists(self._spark, answers):
            return rows.limit(0)
        return lookup_join(rows, self._spark.read.schema("hash string").parquet(answers), ["hash"], "left_semi")

    def _next_question(self, root: str) -> int:
        folder = os.path.join(root, "questions")
        before = [int(n) for n in storage.names(self._spark, folder) or []]
        number = max(before, default=-1) + 1
        storage.create(self._spark, os.path.join(folder, str(number)), "")
        for old in before:
            storage.delete(self._spark, os.path.join(folder, str(old)))
        return number

    def _feed(self, root: str, rows: DataFrame) -> None:
        rest = {"at": "bigint", "known": "boolean", "token": "string"}
        given = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in rest.items() if c not in rows.columns})
        given.select("hash", *rest).write.mode("append").parquet(os.path.join(root, "feed"))

    def _feed_commits(self, root: str, state: State) -> None:
        """Hashes of the parts that came after those fed before. Feeding a part twice does no harm."""
        marks = os.path.join(root, "fed")
        fed = max((int(n) for n in storage.names(self._spark, marks) or []), default=-1)
        if fed >= state.batch_id:
            return
        registry, layout = self._registry, TABLES["images"]
        if fed < 0:
            everything = registry.read("images", state).select("hash")
            self._feed(root, _told(everything, (state.batch_id << _PARTS) + (1 << _PARTS) - 1, True))
        else:
            new = [p for p in state.parts if p.table == "images" and p.rows and _place(p) >> _PARTS > fed]
            for part in new:
                if part.kind == INSERT:
                    self._feed(root, _told(registry._scan([part.path], layout.schema), _place(part), True))
                elif part.kind == CHANGE:
                    changed = registry._scan([part.path], T.StructType([*layout.schema.fields, *CHANGE_FIELDS]))
                    self._feed(root, _told(changed.where(F.col("_op") == DELETE), _place(part), False))
        storage.create(self._spark, os.path.join(marks, str(state.batch_id)), "")

    def _answer(self, root: str, token: str) -> None:
        answers = os.path.join(root, "answers")

        lone = (F.col("asked.token") == token) & ~F.coalesce("last.known", F.lit(False))

        def keep(batch: DataFrame, number: int) -> None:
            answer = batch.where(lone).select("hash", F.col("asked.token").alias("token"))
            answer.write.mode("append").partitionBy("token").parquet(answers)

        fed = self._spark.readStream.schema(FEED).option("cleanSource", "delete").parquet(os.path.join(root, "feed"))
        state = judged(fed).writeStream.outputMode("update").foreachBatch(keep)
        writer = state.option("checkpointLocation", os.path.join(root, "state"))
        writer.trigger(availableNow=True).start().awaitTermination()


def _told(rows: DataFrame, at: int, known: bool) -> DataFrame:
    return rows.select("hash", F.lit(at).cast("bigint").alias("at"), F.lit(known).alias("known"))
