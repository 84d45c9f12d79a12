from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest
from builders import IMAGE_COLUMNS, image_row, rows
from pyspark.sql import functions as F

from shelfmark import storage
from shelfmark.errors import (
    ConcurrentWriteError,
    DuplicateImageError,
    ImageInUseError,
    ImageNotFoundError,
    InvalidRowError,
)
from shelfmark.operators import checks, dedup, joins, lookups
from shelfmark.registry import COMMITS_PER_SNAPSHOT, Part, Registry
from shelfmark.schema import TABLES

TAG_COLUMNS = "image_id long, category string, tag string, score double"


def images(spark, *digits):
    return spark.createDataFrame([image_row(f"{d}.webp", d) for d in digits], IMAGE_COLUMNS)


def tag_rows(spark, *data):
    return spark.createDataFrame(list(data), TAG_COLUMNS)


def test_ids_count_up_from_one_over_batches(spark, registry, three_images):
    given = registry.add_images(three_images)
    assert rows(given) == [("a" * 64, 1), ("b" * 64, 2), ("c" * 64, 3)]
    assert rows(registry.add_images(images(spark, "e", "d"))) == [("d" * 64, 4), ("e" * 64, 5)]
    stored = registry.images()
    assert stored.columns == TABLES["images"].columns
    first = lookups.by_id(stored, 1).first()
    assert (first.file_location, first.width, first.file_type) == ("shelf/item-1.webp", 640, "webp")
    assert first.added_at == first.updated_at is not None


def test_adding_nothing_changes_nothing(spark, registry, three_images):
    assert rows(registry.add_images(three_images.limit(0))) == []
    assert registry.images().count() == 0
    registry.upsert_tags(tag_rows(spark).limit(0))
    assert registry.model_tags().count() == 0


def test_writes_of_tables_known_to_be_empty(registry):
    assert registry.remove_tags(99) == 0
    registry.upsert_tags(registry.model_tags())
    registry.add_images(registry.images())
    registry.archive_tags(registry.model_tags())
    registry.remove_images(99)
    registry.compact("images")
    with pytest.raises(ValueError):
        registry.update_images(registry.images())
    assert registry.images().count() == registry.model_tags().count() == 0


def test_duplicates_are_refused_in_the_batch_and_against_the_registry(spark, registry, three_images):
    with pytest.raises(DuplicateImageError):
        registry.add_images(three_images.union(images(spark, "a")))
    assert registry.images().count() == 0
    registry.add_images(three_images)
    with pytest.raises(DuplicateImageError):
        registry.add_images(images(spark, "e", "a"))
    assert registry.images().count() == 3
    # Numbers of refused rows are not used up.
    assert rows(registry.add_images(images(spark, "e")), "image_id") == [(4,)]


def test_required_columns(spark, registry, three_images):
    with pytest.raises(InvalidRowError):
        registry.add_images(three_images.withColumn("file_location", F.lit(None).cast("string")))
    registry.add_images(three_images)
    with pytest.raises(InvalidRowError):
        registry.upsert_tags(tag_rows(spark, (1, None, "x", 0.1)))


def test_lookups_by_hash(registry, three_images):
    registry.add_images(three_images)
    found = lookups.by_hashes(registry.images(), ["a" * 64, "c" * 64, "f" * 64])
    assert rows(found, "image_id") == [(1,), (3,)]


def test_removal(spark, registry, three_images):
    registry.add_images(three_images)
    registry.remove_images(2)
    assert rows(registry.images(), "image_id") == [(1,), (3,)]
    registry.remove_images([3, 999])
    assert rows(registry.images(), "image_id") == [(1,)]
    for nothing in (0, [], registry.images().limit(0)):
        with pytest.raises(ValueError):
            registry.remove_images(nothing)
    # Numbers are never given twice.
    assert rows(registry.add_images(images(spark, "b")), "image_id") == [(4,)]


def test_images_in_use_stay(spark, registry, three_images):
    registry.add_images(three_images)
    registry.upsert_tags(tag_rows(spark, (1, "general", "x", 0.5)))
    registry.upsert_notes(spark.createDataFrame([(2, "note")], "image_id long, content string"))
    for image_id in (1, 2):
        with pytest.raises(ImageInUseError):
            registry.remove_images([image_id, 3])
    assert registry.images().count() == 3
    assert registry.remove_tags(1) == 1
    registry.remove_images([1, 3])
    assert rows(registry.images(), "image_id") == [(2,)]


def test_update(spark, registry, three_images):
    registry.add_images(three_images)
    before = lookups.by_id(registry.images(), 2).first()
    changed = registry.images().where("image_id = 2").select(
        "image_id",
        F.lit("moved.png").alias("file_location"),
        F.lit(3840).alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.lit("png").alias("file_type"),
        F.lit("f" * 64).alias("hash"),
        "file_size",
    )
    unknown = changed.withColumn("image_id", F.lit(999).cast("long"))
    registry.update_images(changed.unionByName(unknown))
    after = lookups.by_id(registry.images(), 2).first()
    assert (after.file_location, after.width, after.height, after.file_type) == (
        "moved.png", 3840, None, "png",
    )
    assert (after.hash, after.added_at) == (before.hash, before.added_at)
    assert after.updated_at > before.updated_at
    assert registry.images().count() == 3
    with pytest.raises(ValueError):
        registry.update_images(changed.limit(0))


def test_tag_upsert_replaces_rows_and_clears_the_archive_mark(spark, registry, three_images):
    registry.add_images(three_images)
    registry.upsert_tags(tag_rows(spark, (1, "general", "x", 0.5), (1, "general", "y", 0.6)))
    keys = registry.model_tags().where("tag = 'x'")
    registry.archive_tags(keys)
    assert rows(lookups.active_tags(registry.model_tags()), "tag") == [("y",)]
    registry.upsert_tags(tag_rows(spark, (1, "general", "x", 0.9), (2, "meta", "x", 0.1)))
    assert rows(registry.model_tags()) == [
        (1, "general", "x", 0.9, False),
        (1, "general", "y", 0.6, False),
        (2, "meta", "x", 0.1, False),
    ]


def test_tags_of_unknown_images_are_refused(spark, registry, three_images):
    registry.add_images(three_images)
    with pytest.raises(ImageNotFoundError):
        registry.upsert_tags(tag_rows(spark, (1, "general", "x", 0.5), (9, "general", "x", 0.5)))
    with pytest.raises(ImageNotFoundError):
        registry.upsert_tags(tag_rows(spark, (9, "general", "x", 0.5)).drop("score"), "manual_tags")
    assert registry.model_tags().count() == 0


def test_tag_removal_counts_rows(spark, registry, three_images):
    registry.add_images(three_images)
    registry.upsert_tags(tag_rows(spark, (1, "g", "x", 0.5), (1, "g", "y", 0.5), (2, "g", "x", 0.5)))
    assert registry.remove_tags(1) == 2
    assert registry.remove_tags(1) == 0
    assert registry.remove_tags(99) == 0
    assert rows(registry.model_tags(), "image_id") == [(2,)]
    registry.upsert_tags(tag_rows(spark, (1, "g", "x", 0.7)))
    assert rows(lookups.by_id(registry.model_tags(), 1), "score") == [(0.7,)]


def test_notes_and_manual_tags(spark, registry, three_images):
    registry.add_images(three_images)
    note = "image_id long, content string"
    registry.upsert_notes(spark.createDataFrame([(1, "one"), (2, "two")], note))
    registry.upsert_notes(spark.createDataFrame([(1, "uno")], note))
    assert rows(registry.notes()) == [(1, "uno"), (2, "two")]
    manual = tag_rows(spark, (3, "general", "x", 0.0)).drop("score")
    registry.upsert_tags(manual, "manual_tags")
    registry.upsert_tags(manual, "manual_tags")
    assert rows(lookups.all_tags(registry.model_tags(), registry.manual_tags()), "image_id", "source") == [
        (3, "manual")
    ]


def test_a_failed_unit_of_work_leaves_no_trace(spark, registry, three_images):
    with pytest.raises(ImageNotFoundError):
        with registry.batch() as batch:
            batch.add_images(three_images)
            batch.upsert("model_tags", tag_rows(spark, (99, "g", "x", 0.5)))
    assert registry.images().count() == 0
    # The files of the attempt are still there; no record names them.
    assert os.listdir(os.path.join(registry.root, "images"))
    with registry.batch() as batch:
        batch.add_images(three_images.where(f"hash = '{'c' * 64}'"))
        batch.upsert("model_tags", tag_rows(spark, (1, "g", "x", 0.5)))
    assert rows(registry.images(), "image_id", "hash") == [(1, "c" * 64)]
    assert registry.model_tags().count() == 1


def test_a_record_without_its_file_is_no_commit(spark, registry, three_images):
    registry.add_images(three_images)
    # A writer that stopped before its record was whole.
    with open(os.path.join(registry.root, "commits", "2"), "w") as record:
        record.write('{"label": ')
    assert registry.images().count() == 3
    registry.add_images(images(spark, "d"))
    assert rows(registry.images(), "image_id") == [(1,), (2,), (3,), (4,)]


def test_of_two_writers_the_second_is_refused(spark, registry, three_images):
    first, second = registry.batch(), registry.batch()
    with first as batch:
        batch.add_images(three_images)
    with pytest.raises(ConcurrentWriteError), second as batch:
        batch.add_images(images(spark, "d"))
    assert rows(registry.images(), "hash") == [(d * 64,) for d in "abc"]
    registry.add_images(images(spark, "d"))
    assert registry.images().count() == 4


def test_many_commits_read_few_records(spark, registry, monkeypatch):
    for number in range(1, 1001):
        registry._commit(number, f"l:{number}", 1, False, [])
    monkeypatch.setattr(storage, "read", counted := Counted(storage.read))
    state = registry.state()
    assert state.batch_id == 1000 and len(state.labels) == 1000
    assert counted.calls <= COMMITS_PER_SNAPSHOT
    registry.init(overwrite=True)
    assert registry.state().labels == frozenset() and registry.state().batch_id == 1001


class Counted:
    def __init__(self, function):
        self.function, self.calls = function, 0

    def __call__(self, *args):
        self.calls += 1
        return self.function(*args)


@pytest.mark.parametrize("column, value", [("file_location", "  "), ("width", -1), ("hash", "XYZ"), ("height", None)])
def test_images_that_break_a_rule_are_refused(registry, three_images, column, value):
    kind = dict(three_images.dtypes)[column]
    with pytest.raises(InvalidRowError):
        registry.add_images(three_images.withColumn(column, F.lit(value).cast(kind)))
    assert registry.images().count() == 0


@pytest.mark.parametrize("column, value", [("file_location", None), ("file_location", ""), ("height", 0)])
def test_updates_that_break_a_rule_are_refused(registry, three_images, column, value):
    registry.add_images(three_images)
    before = rows(registry.images())
    kind = dict(three_images.dtypes)[column]
    with pytest.raises(InvalidRowError):
        registry.update_images(registry.images().withColumn(column, F.lit(value).cast(kind)))
    assert rows(registry.images()) == before


def test_a_thousand_and_more_parts_keep_their_order(spark, registry, three_images):
    registry.add_images(three_images)
    with registry.batch() as batch:
        batch.parts += [Part("notes", "insert", "notes/none", 0)] * 1500
        batch.upsert("notes", spark.createDataFrame([(1, "early")], "image_id long, content string"))
    registry.upsert_notes(spark.createDataFrame([(1, "late")], "image_id long, content string"))
    assert rows(registry.notes()) == [(1, "late")]


def test_tags_of_one_image_skip_row_groups(spark, registry, three_images, tmp_path):
    """The files of a tag table have a Bloom filter for the image."""
    registry.add_images(three_images)
    registry.upsert_tags(tag_rows(spark, (1, "g", "x", 0.5), (3, "h", "y", 0.5)))
    (part,) = [p for p in registry.state().parts if p.table == "model_tags"]
    folder = os.path.join(registry.root, part.path)
    found = [pq.ParquetFile(os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith(".parquet")]
    sizes = sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.endswith(".parquet"))
    assert sum(f.metadata.num_rows for f in found) == 2
    assert sizes > 2 * 1024  # filters take more room than two rows


def test_init_is_idempotent_and_overwrite_starts_anew(spark, registry, three_images):
    registry.add_images(three_images)
    registry.init()
    assert registry.images().count() == 3
    registry.init(overwrite=True)
    assert registry.images().count() == 0
    assert rows(registry.add_images(images(spark, "b")), "image_id") == [(1,)]


def test_a_missing_catalogue_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Registry(spark, str(tmp_path / "none")).images()


def test_compaction_keeps_the_rows(spark, registry, three_images):
    registry.add_images(three_images)
    registry.upsert_tags(tag_rows(spark, (1, "g", "x", 0.5), (1, "g", "y", 0.5), (2, "g", "x", 0.5)))
    registry.remove_tags(1)
    registry.upsert_tags(tag_rows(spark, (3, "g", "z", 0.5), (2, "g", "x", 0.8)))
    before = rows(registry.model_tags())
    assert "Join" in registry.model_tags()._jdf.queryExecution().optimizedPlan().toString() or before
    registry.compact("model_tags")
    assert rows(registry.model_tags()) == before
    plan = registry.model_tags()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    parts = len(registry.state().parts)
    registry.compact("model_tags")
    assert len(registry.state().parts) == parts
    registry.upsert_tags(tag_rows(spark, (1, "g", "x", 0.1)))
    assert registry.model_tags().count() == len(before) + 1


def test_plain_reads_prune_and_push_down(registry, three_images):
    registry.add_images(three_images)
    found = lookups.by_id(registry.images(), 2).select("image_id", "hash")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<image_id:bigint,hash:string>" in plan
    assert "EqualTo(image_id,2)" in plan


def test_views_and_tables(spark, registry, three_images):
    registry.add_images(three_images)
    registry.create_views("cat_")
    assert spark.sql("SELECT max(image_id) AS m FROM cat_images").first().m == 3
    assert {"cat_" + r.name for r in registry.tables().collect()} <= {
        r.tableName for r in spark.sql("SHOW TABLES").collect()
    }


# ---- buckets ----------------------------------------------------------------------------------


def exchanges(df):
    """Shuffles of the plan as it would be run, by what they deal by."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    return [m.replace("#", " ").split()[0] for m in re.findall(r"Exchange hashpartitioning\(([^,]*),", plan)]


@pytest.fixture
def nothing_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def catalogue(spark, registry):
    """Fifty images with two tags each, in buckets."""
    images = [(f"/f/{i}.png", i + 1, 5, "png", f"{i:064x}", 10) for i in range(50)]
    registry.add_images(spark.createDataFrame(images, IMAGE_COLUMNS))
    tags = [(i, c, f"t{i % 4}", 0.5) for i in range(1, 51) for c in ("x", "y")]
    registry.upsert_tags(spark.createDataFrame(tags, "image_id bigint, category string, tag string, score double"))
    for table in ("images", "model_tags"):
        registry.compact(table, buckets=4)
    return registry


def test_new_hashes_alone_are_shuffled_against_buckets(spark, catalogue, nothing_broadcast):
    new = spark.createDataFrame([(f"{i:064x}", i) for i in range(40, 60)], "hash string, n int")
    left = dedup.against_registry(new, catalogue.images())
    assert exchanges(left) == ["hash"]
    assert sorted(r.n for r in left.collect()) == list(range(50, 60))


def test_tags_in_buckets_stay_where_they_are(spark, catalogue, nothing_broadcast):
    images, tags = catalogue.images(), catalogue.model_tags()
    assert exchanges(tags.groupBy("image_id").count()) == []
    found = lookups.images_by_tag(images, tags, "t1", "x")
    assert exchanges(found) == ["image_id"] and found.count() == 13  # the images alone
    lone = checks.orphans(tags, images.where("width <= 40"))
    assert set(exchanges(lone)) == {"image_id"} and len(exchanges(lone)) == 1
    assert sorted(map(tuple, lone.collect())) == [(i, 2) for i in range(41, 51)]


def test_buckets_end_with_the_next_part_and_come_back(spark, catalogue):
    more = [("/f/new.png", 1, 5, "png", "f" * 64, 10)]
    catalogue.add_images(spark.createDataFrame(more, IMAGE_COLUMNS))
    assert catalogue.images().count() == 51
    catalogue.update_images(catalogue.images().where("image_id = 3").withColumn("width", F.lit(99)))
    catalogue.compact("images", buckets=8)
    rows_ = catalogue.images().collect()
    assert len(rows_) == 51 and {r.width for r in rows_ if r.image_id == 3} == {99}
    before = len(catalogue.state().parts)
    catalogue.compact("images", buckets=8)  # nothing to do
    assert len(catalogue.state().parts) == before
    catalogue.compact("images")
    assert catalogue.images().count() == 51 and not catalogue.state().parts[-1].buckets
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith('buckets_')]
