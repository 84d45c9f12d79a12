"""One query per operator over the test tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.columns import aspect_ratio, total_pixels, validity
from shelfmark.operators import changes, checks, dedup, ids, lookups, metadata, outcome, scoring, tags
from shelfmark.operators.joins import lookup_join
from shelfmark.plans import standins as data
from shelfmark.plans.register import fresh_files, register, registration_plan
from shelfmark.registry import Registry
from shelfmark.session import new_workspace, staged
from shelfmark.sources.files import file_stream
from shelfmark.sources.files import list_files as listed_files
from shelfmark.sources.vocab import parse_vocab
from shelfmark.streaming import register as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Key of the single-image lookups.
IMAGE_ID = 7
# Threshold of the flows that run the vowel scorer.
# Added to an id gives a number that is not exact as a 64-bit float.
BEYOND_DOUBLES = 2**53 + 1
VOWEL_THRESHOLD = 0.08
FILES_PER_LOT = 4000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- metadata and validity --------------------------------------------------------------------


@query
def asset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.assets(spark, sf_dir)


@query
def asset_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = F.col("width"), F.col("height")
    return data.assets(spark, sf_dir).select(
        "image_id",
        aspect_ratio(width, height).alias("aspect_ratio"),
        total_pixels(width, height).alias("total_pixels"),
    )


@query
def validate_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish files get a blank location, French ones an upper-case hash, tiny ones no width."""
    lang = F.split_part("file_location", F.lit("/"), F.lit(3))
    location = F.when(lang == "es", "　 \t").otherwise(F.col("file_location"))
    hash_value = F.when(lang == "fr", F.upper("hash")).otherwise(F.col("hash"))
    checked = validity(location, hash_value, F.col("width") - 7, F.col("height"))
    return data.assets(spark, sf_dir).select("image_id", checked.alias("validity"))


@query
def probe_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = data.as_image(data.table(spark, sf_dir, "documents"))
    return metadata.probe_dimensions(files).select("path", "width", "height")


@query
def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.extract_metadata(data.as_image(data.table(spark, sf_dir, "documents")))


@query
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine list: files that could not be read, with the reason."""
    files = data.as_image(data.table(spark, sf_dir, "documents"))
    return metadata.skipped_files(metadata.extract_metadata(files)).select("file_location", "status")


@query
def vocab_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties as a small vocabulary document.

    The event type is the category, except for error events, which give none.
    """
    category = F.when(F.col("event_type") == "error", "{}").otherwise(
        F.concat(F.lit('{"k": "'), "event_type", F.lit('"}'))
    )
    document = F.concat(
        F.lit('{"dataset_info": {"tag_mapping": {"tag_to_idx": '),
        "props",
        F.lit(', "tag_to_category": '),
        category,
        F.lit("}}}"),
    )
    return parse_vocab(data.table(spark, sf_dir, "events"), document, "event_id")


@query
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree, listed by folder; some names are hidden, some files empty."""
    folder = new_workspace(spark, "tree")
    data.write_files(spark, sf_dir, folder)
    listed = listed_files(spark, folder, recursive=True)
    return listed.select(F.regexp_extract("path", r"(/[^/]+/[^/]+/[^/]+)$", 1).alias("location"), "length")


# ---- copies -----------------------------------------------------------------------------------


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the registered files, as a stored table."""
    return staged(data.known_files(spark, sf_dir).select("hash"), "known")


@query
def dedup_against_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = data.assets(spark, sf_dir).select("image_id", "hash")
    return dedup.against_registry(incoming, _known(spark, sf_dir))


@query
def dedup_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check against a stored registry in buckets by hash, as for two sides too large to broadcast."""
    registry = _registry(spark, "dedup")
    registry.add_images(staged(data.known_files(spark, sf_dir).drop("image_id"), "known"))
    registry.compact("images", buckets=_buckets(spark))
    incoming = data.assets(spark, sf_dir).select("image_id", "hash")
    return dedup.against_registry(incoming, registry.images(), most_bytes=0)


@query
def dedup_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.assets(spark, sf_dir).select("image_id", "hash", "file_location")
    return dedup.keep_first(rows)


@query
def duplicate_hash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_hashes(data.assets(spark, sf_dir))


@query
def find_by_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose hash is among those of the toxic documents, their copies included."""
    rows = data.assets(spark, sf_dir).select("image_id", "file_location", "hash")
    toxic = data.labels(spark, sf_dir).where("toxic = 1")
    wanted = rows.join(toxic, "image_id", "left_semi").select("hash").distinct()
    return lookups.by_hashes(rows, staged(wanted, "wanted"))


# ---- tags -------------------------------------------------------------------------------------


@query
def tag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.decoded(spark, sf_dir)


@query
def tag_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.rank_tags(data.decoded(spark, sf_dir))


@query
def tag_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.top_tags(data.decoded(spark, sf_dir))


@query
def tag_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.allowed_tags(data.decoded(spark, sf_dir)).drop("idx")


@query
def tag_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = tags.nest_tags(data.decoded(spark, sf_dir))
    head = tags.head_tag(F.col("tags"))
    return nested.select(
        "image_id",
        "category",
        F.array_join("tags.tag", "|").alias("tags"),
        F.size("tags").cast("bigint").alias("n_tags"),
        head["tag"].alias("top_tag"),
        head["score"].alias("top_score"),
    )


@query
def tag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.explode_results(tags.tag_results(data.decoded(spark, sf_dir)))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = data.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"))
    scored = data.scored_files(files, spark, sf_dir).drop("scores")
    return outcome.classify(scored, data.decoded(spark, sf_dir), ["image_id"])


@query
def tagging_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("image_id", "n_tags", "outcome")


@query
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.outcome_counts(_classified(spark, sf_dir))


@query
def orphan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.orphans(data.decoded(spark, sf_dir), data.labels(spark, sf_dir))


# ---- ids and changes --------------------------------------------------------------------------


@query
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.keep_first(data.assets(spark, sf_dir).select("hash", "file_location"))
    return ids.assign_ids(staged(rows, "ids"))


def _known_and_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hashes of the registered files, and the files to add."""
    known = _known(spark, sf_dir)
    return known, fresh_files(data.assets(spark, sf_dir), known)


def _next_id(known: DataFrame) -> Column:
    return known.agg(F.count(F.lit(1)) + 1).scalar()


@query
def insert_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, fresh = _known_and_fresh(spark, sf_dir)
    rows = changes.numbered_images(staged(fresh, "fresh"), _next_id(known))
    return rows.drop("added_at", "updated_at")


@query
def register_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag rows of the documents that are new, scored and not empty.

    As in the stored flow, hashing and scoring happen once; what follows reads their result.
    """
    known, fresh = _known_and_fresh(spark, sf_dir)
    scored = data.scored_files(staged(fresh, "fresh"), spark, sf_dir)
    found = tags.decode_scores(scored, data.vocab(spark, sf_dir), ["hash"], data.THRESHOLD)
    files = scored.drop("scores")
    _, new_tags = registration_plan(files, staged(found, "tags"), _next_id(known))
    return new_tags


@query
def upsert_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled images are tagged again with a lower threshold; strong old tags were archived."""
    old = data.model_tags(spark, sf_dir).withColumn("archived", F.col("score") > 0.25)
    again = data.scores(spark, sf_dir).join(data.labels(spark, sf_dir), "image_id", "left_semi")
    new = tags.decode_scores(again, data.vocab(spark, sf_dir), ["image_id"], 0.0)
    return changes.upsert(old, tags.to_tag_rows(new), ["image_id", "category", "tag"])


@query
def update_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled files move; toxic ones lose their width, since nulls are written too."""
    moved = data.labels(spark, sf_dir).select(
        "image_id",
        F.concat(F.lit("/moved/"), "image_id", F.lit(".png")).alias("file_location"),
        F.when(F.col("toxic") == 0, F.col("quality") + 640).alias("width"),
        F.lit(480).alias("height"),
        F.lit("png").alias("file_type"),
        (F.col("image_id") + 1).alias("file_size"),
    )
    return changes.update_images(data.assets(spark, sf_dir), moved)


@query
def remove_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = data.labels(spark, sf_dir).where("toxic = 1")
    rows = data.assets(spark, sf_dir).select("image_id", "file_location", "hash")
    return changes.remove_rows(rows, toxic)


@query
def remove_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = data.labels(spark, sf_dir).where("toxic = 1")
    return changes.removed_counts(data.model_tags(spark, sf_dir), toxic)


@query
def notes_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled images have a note on their quality; French ones get another one."""
    old = data.labels(spark, sf_dir).select(
        "image_id", F.concat(F.lit("quality "), "quality").alias("content")
    )
    new = data.table(spark, sf_dir, "documents").where("lang = 'fr'")
    new = new.select(F.col("doc_id").alias("image_id"), F.col("source").alias("content"))
    return changes.upsert(old, new, ["image_id"])


# ---- lookups ----------------------------------------------------------------------------------


@query
def get_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_id(data.assets(spark, sf_dir), IMAGE_ID)


@query
def contains_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.contains(data.assets(spark, sf_dir), IMAGE_ID)


@query
def tags_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_id(data.model_tags(spark, sf_dir), IMAGE_ID)


@query
def count_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.count_rows(data.assets(spark, sf_dir))


@query
def count_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.count_rows(data.model_tags(spark, sf_dir))


@query
def list_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.listing(data.assets(spark, sf_dir), "image_id")


@query
def list_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.listing(data.model_tags(spark, sf_dir), "image_id", "category", "tag")


@query
def images_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that carry any of the artist tags."""
    images = data.assets(spark, sf_dir).select("image_id", "file_location", "hash")
    wanted = data.vocab(spark, sf_dir).where("category = 'artist'")
    return lookups.images_by_tags(images, data.model_tags(spark, sf_dir), wanted)


@query
def all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = data.labels(spark, sf_dir).select(
        "image_id", F.lit("quality").alias("category"), F.concat(F.lit("q"), "quality").alias("tag")
    )
    return lookups.all_tags(data.model_tags(spark, sf_dir), manual)


@query
def active_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of toxic images are archived; the mark is unknown for images without a label."""
    marks = data.labels(spark, sf_dir).select("image_id", (F.col("toxic") == 1).alias("archived"))
    marked = data.model_tags(spark, sf_dir).drop("archived").join(marks, "image_id", "left")
    return lookups.active_tags(marked).drop("archived")


# ---- user code --------------------------------------------------------------------------------


@query
def score_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vowel shares of every document from the batch scorer, with errors kept per file."""
    files = data.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("content")
    )
    scored = scoring.score_assets(files, data.letter_scorer)
    return scored.select(
        "image_id", F.posexplode_outer("scores").alias("idx", "score"), "error"
    ).withColumn("score", F.col("score").cast("double"))


def _count_words(text: str, large: int | None, lang: str) -> int:
    if lang == "es":
        raise LookupError(lang)
    return len(text.split(" ")) + (0 if large is None else large % 1000)


@query
def parallel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, plus the end of a number that no double holds; odd ids have none."""
    rows = data.table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + BEYOND_DOUBLES).alias("large")
    )
    mapped = scoring.parallel_map(rows, _count_words, T.LongType(), args=["text", "large"], kwargs=["lang"])
    return mapped.drop("text")


# ---- flows over a registry --------------------------------------------------------------------


def _registry(spark: SparkSession, name: str) -> Registry:
    return Registry(spark, new_workspace(spark, name)).init()


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _stored(registry: Registry) -> DataFrame:
    images = registry.images().select("image_id", "file_location", "width", "height", "hash")
    return registry.model_tags().join(images, "image_id")


@query
def register_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register all documents as image files, twice: the second run finds nothing new."""
    registry = _registry(spark, "register")
    files = data.as_image(data.table(spark, sf_dir, "documents"))
    words = data.vocab(spark, sf_dir)
    for _ in range(2):
        register(
            registry,
            files,
            data.letter_scorer,
            words,
            threshold=VOWEL_THRESHOLD,
            content="content",
        )
    return _stored(registry)


@query
def stream_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of document files."""
    registry = _registry(spark, "stream")
    schema = data.table(spark, sf_dir, "documents").schema
    # A pattern, since a stream takes folders and patterns but not the name of one file.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    streaming.stream_register(
        registry,
        data.as_image(stream),
        data.letter_scorer,
        data.vocab(spark, sf_dir),
        new_workspace(spark, "stream-state"),
        threshold=VOWEL_THRESHOLD,
        content="content",
    ).awaitTermination()
    return _stored(registry)


@query
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree, registered by a folder stream in lots; a second run has nothing due."""
    folder, registry = new_workspace(spark, "tree"), _registry(spark, "stream-files")
    data.write_files(spark, sf_dir, folder)
    words, state = data.vocab(spark, sf_dir), new_workspace(spark, "rounds")
    for _ in range(2):
        files = file_stream(spark, folder, recursive=True, files_per_batch=FILES_PER_LOT)
        streaming.stream_register(
            registry, files, data.letter_scorer, words, state, threshold=VOWEL_THRESHOLD
        ).awaitTermination()
    # numbers and, of copies, the file that is kept depend on the lots
    return _stored(registry).select("category", "tag", "score", "width", "height", "hash")


@query
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are registered first; a stream of all of them then asks a state for their hashes."""
    registry = _registry(spark, "stream-state")
    words = data.vocab(spark, sf_dir)
    labelled = data.table(spark, sf_dir, "labels").select("doc_id")
    documents = data.table(spark, sf_dir, "documents")
    first = data.as_image(lookup_join(documents, labelled, ["doc_id"], "left_semi"))
    register(registry, first, data.letter_scorer, words, threshold=VOWEL_THRESHOLD, content="content")
    stream = spark.readStream.schema(documents.schema).parquet(f"{sf_dir}/documents.parque[t]")
    streaming.stream_register(
        registry, data.as_image(stream), data.letter_scorer, words, new_workspace(spark, "stream-hashes"),
        threshold=VOWEL_THRESHOLD, content="content", state_from_bytes=-1,
    ).awaitTermination()
    # numbers and, of copies, the file that is kept depend on which of them came first
    return _stored(registry).select("category", "tag", "score", "width", "height", "hash")


@query
def commit_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit of work that fails leaves no image; the one after it stores images and tags."""
    registry = _registry(spark, "commit")
    images = staged(data.storable_files(spark, sf_dir), "images")

    def store(then_fail: bool) -> None:
        with registry.batch() as batch:
            new = batch.add_images(images, counted=True).join(images.select("hash", "file_size"), "hash")
            size_tag = F.concat(F.lit("bytes "), "file_size").alias("tag")
            batch.upsert(
                "manual_tags", new.select("image_id", F.lit("size").alias("category"), size_tag)
            )
            if then_fail:
                raise InterruptedError

    try:
        store(then_fail=True)
    except InterruptedError:
        pass
    store(then_fail=False)
    stored = registry.images().select("image_id", "hash")
    return stored.join(registry.manual_tags().select("image_id", "tag"), "image_id", "full")


@query
def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update, delete, insert again and compact, through stored batches."""
    registry = _registry(spark, "changes")
    files = staged(data.storable_files(spark, sf_dir), "files")
    registry.add_images(files, counted=True)
    large = registry.images().where("height >= 40")
    registry.update_images(
        large.withColumn("file_type", F.lit("long")).withColumn("width", F.lit(None).cast("int"))
    )
    small = registry.images().where("file_type = 'txt' and height = 1")
    registry.remove_images(small)
    # Removed files come back under new ids.
    registry.add_images(dedup.against_registry(files, registry.images()), counted=True)
    registry.compact("images")
    return registry.images().drop("added_at", "updated_at")


@query
def registry_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a stored catalogue: upserted, replaced, archived and removed, batch after batch."""
    registry = _registry(spark, "tags")
    registry.add_images(staged(data.storable_files(spark, sf_dir), "files"), counted=True)
    images = registry.images()
    unknown = F.lit("w")  # a tag has a name, also where the width has no value
    side = F.concat(F.lit("w"), F.coalesce((F.col("width") % 7).cast("string"), F.lit("")))
    tagged = images.select("image_id", F.lit("size").alias("category"), side.alias("tag"), (F.col("image_id") % 10 / 16).alias("score"))
    registry.upsert_tags(tagged)
    thirds = tagged.where("image_id % 3 = 0").withColumn("score", F.lit(0.75))
    registry.upsert_tags(thirds.unionByName(thirds.withColumn("category", F.lit("extra"))))
    registry.archive_tags(tagged.where("image_id % 5 = 0"))
    registry.remove_tags(images.where("image_id % 7 = 0"))
    return registry.model_tags().withColumn("tag", F.nullif("tag", unknown))


@query
def bucket_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by their tags, and tags without a large image, over stored tables in buckets."""
    registry = _registry(spark, "buckets")
    registry.add_images(staged(data.storable_files(spark, sf_dir), "files"), counted=True)
    images = registry.images()
    sizes = [(F.lit("size"), F.col("width") % 7), (F.lit("shape"), F.col("height") % 3)]
    for category, value in sizes:
        tag = F.concat(F.lit("v"), F.coalesce(value.cast("string"), F.lit("")))  # bare where the size is unknown
        registry.upsert_tags(images.select("image_id", category.alias("category"), tag.alias("tag"), F.lit(0.5).alias("score")))
    for name in ("images", "model_tags"):
        registry.compact(name, buckets=_buckets(spark))
    stored, tagged = registry.images(), registry.model_tags()
    wanted = spark.createDataFrame([("size", "v2"), ("shape", "v0")], "category string, tag string")
    found = lookups.images_by_tags(stored, tagged, wanted).select("image_id", "hash")
    lone = checks.orphans(tagged, stored.where("height > 2"))
    return found.join(lone, "image_id", "full")


@query
def registry_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a stored catalogue, replaced for every second image, beside what look-ups find."""
    registry = _registry(spark, "notes")
    registry.add_images(staged(data.storable_files(spark, sf_dir), "files"), counted=True)
    images = registry.images()
    registry.upsert_notes(images.select("image_id", F.concat(F.lit("first "), "hash").alias("content")))
    registry.upsert_notes(images.where("image_id % 2 = 0").select("image_id", F.lit("second").alias("content")))
    registry.upsert_tags(images.where("image_id % 4 = 0").select(
        "image_id", F.lit("kind").alias("category"), F.lit("fourth").alias("tag"), F.lit(0.5).alias("score")
    ))
    tagged = lookups.images_by_tag(registry.images(), registry.model_tags(), "fourth", "kind")
    found = tagged.select("image_id", F.lit(True).alias("fourth"))
    return registry.notes().join(found, "image_id", "left")
