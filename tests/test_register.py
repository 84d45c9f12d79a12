from __future__ import annotations

import json
import os

import pytest
from builders import gif, jpeg, png, rows

from shelfmark.errors import DuplicateImageError, InvalidRowError
from shelfmark.operators import joins
from shelfmark.plans.register import register
from shelfmark.registry import Registry
from shelfmark.sources import file_stream, read_vocab, scan_files
from shelfmark.streaming.register import stream_register


def last_byte_scorer():
    """Scores by the last byte: F fails, E is empty, anything else gives two tags."""

    def score(contents):
        return [
            ValueError("no") if c.endswith(b"F") else [-1.0, -1.0, -1.0] if c.endswith(b"E")
            else [float(c[-1]), -1.0, 2.5]
            for c in contents
        ]

    return score


@pytest.fixture
def vocab(spark, tmp_path):
    mapping = {"tag_to_idx": {"last": 0, "never": 1, "odd": 2}, "tag_to_category": {"last": "general"}}
    path = tmp_path / "vocab.json"
    path.write_text(json.dumps({"dataset_info": {"tag_mapping": mapping}}))
    return read_vocab(spark, str(path))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    return root


def put(root, **files):
    for name, content in files.items():
        (root / name.replace("_", ".")).write_bytes(content)


def stored(registry):
    """Images and tags by content, whatever the numbers."""
    both = registry.images().join(registry.model_tags(), "image_id")
    return rows(both, "hash", "width", "height", "category", "tag", "score")


def test_the_flow(registry, vocab, tree):
    put(
        tree,
        a_png=png(3, 4, b"A"), b_png=png(3, 4, b"A"), c_jpg=jpeg(5, 6) + b"C",
        fails_png=png(7, 8, b"F"), empty_gif=gif(9, 9) + b"E", broken_png=b"no picture",
    )
    result = register(registry, str(tree), last_byte_scorer, vocab)
    assert (result.files, result.skipped, result.known) == (6, 1, 1)
    assert (result.success, result.failure, result.empty) == (2, 1, 1)
    scored = result.success + result.failure + result.empty
    assert scored == result.files - result.skipped - result.known
    assert rows(result.skipped_files, "status") == [("unsupported",)]
    assert rows(result.outcomes, "file_type", "outcome", "error") == [
        ("gif", "empty", None),
        ("jpg", "success", None),
        ("png", "failure", "ValueError: no"),
        ("png", "success", None),
    ]
    found = registry.images().collect()
    assert sorted(r.image_id for r in found) == [1, 2]
    assert {os.path.basename(r.file_location) for r in found} == {"a.png", "c.jpg"}
    assert rows(registry.model_tags(), "image_id", "category", "tag") == [
        (1, "general", "last"), (1, "unknown", "odd"), (2, "general", "last"), (2, "unknown", "odd"),
    ]


def test_a_second_run_adds_nothing_and_retries_what_failed(registry, vocab, tree):
    put(tree, a_png=png(3, 4, b"A"), f_png=png(7, 8, b"F"))
    register(registry, str(tree), last_byte_scorer, vocab)
    before = stored(registry)
    again = register(registry, str(tree), last_byte_scorer, vocab)
    assert (again.known, again.success, again.failure) == (1, 0, 1)
    assert stored(registry) == before
    put(tree, moved_png=png(3, 4, b"A"), new_png=png(1, 1, b"N"))
    third = register(registry, str(tree), last_byte_scorer, vocab)
    assert (third.known, third.success) == (2, 1)
    assert rows(registry.images(), "image_id") == [(1,), (2,)]


@pytest.mark.parametrize("content", [b"broken", png(7, 8, b"F"), gif(9, 9) + b"E", None])
def test_nothing_is_written_without_a_success(registry, vocab, tree, content):
    if content:
        put(tree, x_png=content)
    before = registry.state()
    result = register(registry, str(tree), last_byte_scorer, vocab)
    assert result.success == 0
    assert registry.state() == before


def test_strict_batches_refuse_copies(registry, vocab, tree):
    put(tree, a_png=png(3, 4, b"A"), b_png=png(3, 4, b"A"))
    with pytest.raises(DuplicateImageError):
        register(registry, str(tree), last_byte_scorer, vocab, on_duplicate="error")
    assert registry.images().count() == 0


def test_bytes_from_the_table_and_from_the_files_agree(spark, registry, vocab, tree, tmp_path):
    put(tree, a_png=png(3, 4, b"A"), b_png=png(5, 6, b"B"), e_gif=gif(9, 9) + b"E")
    register(registry, str(tree), last_byte_scorer, vocab)
    other = Registry(spark, str(tmp_path / "other")).init()
    files = scan_files(spark, str(tree)).repartition(7)
    register(other, files, last_byte_scorer, vocab, content="content")
    assert stored(other) == stored(registry)


def test_a_large_registry_gives_the_same(registry, vocab, tree, monkeypatch):
    put(tree, a_png=png(3, 4, b"A"), b_png=png(5, 6, b"B"))
    register(registry, str(tree), last_byte_scorer, vocab)
    put(tree, c_png=png(5, 6, b"C"), d_png=png(5, 6, b"B"))
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 10)
    result = register(registry, str(tree), last_byte_scorer, vocab)
    assert (result.known, result.success) == (3, 1)
    assert registry.images().count() == 3


def test_a_labelled_batch_runs_once(registry, vocab, tree):
    put(tree, a_png=png(3, 4, b"A"))
    register(registry, str(tree), last_byte_scorer, vocab, label="x:0")
    put(tree, b_png=png(3, 4, b"B"))
    again = register(registry, str(tree), last_byte_scorer, vocab, label="x:0")
    assert again.files == 0
    assert registry.images().count() == 1


def test_bad_files_are_told_and_end_nothing(registry, vocab, tree):
    put(tree, a_png=png(3, 4, b"A"), z_png=b"")
    (tree / "_DSC1.png").write_bytes(png(3, 4, b"B"))
    (tree / ".h.png").write_bytes(png(3, 4, b"C"))
    (tree / "gone.png").symlink_to(tree / "nowhere")
    result = register(registry, str(tree), last_byte_scorer, vocab)
    assert (result.files, result.skipped, result.known, result.success) == (5, 2, 0, 3)
    assert rows(result.skipped_files, "status") == [("empty",), ("unreadable",)]


def test_a_run_that_broke_off_scores_nothing_again(registry, vocab, tree, tmp_path, monkeypatch):
    log = tmp_path / "scored"

    def factory():
        inner = last_byte_scorer()

        def score(contents):
            with open(log, "a") as stream:
                stream.write("x" * len(contents))
            return inner(contents)

        return score

    put(tree, a_png=png(3, 4, b"A"), b_png=png(5, 6, b"B"))
    with monkeypatch.context() as broken:
        broken.setattr(Registry, "_commit", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            register(registry, str(tree), factory, vocab, label="night")
    assert log.read_text() == "xx" and registry.images().count() == 0
    put(tree, c_png=png(7, 8, b"C"))  # comes too late for this batch
    again = register(registry, str(tree), factory, vocab, label="night")
    assert log.read_text() == "xx" and again.success == 2
    assert os.path.exists(again.workspace)
    again.release()
    assert not os.path.exists(again.workspace)


def test_a_vocabulary_with_a_tag_twice_is_refused(registry, vocab, tree):
    put(tree, a_png=png(3, 4, b"A"))
    twice = vocab.unionByName(vocab.selectExpr("idx + 3 AS idx", "tag", "category"))
    with pytest.raises(InvalidRowError):
        register(registry, str(tree), last_byte_scorer, twice)


def many(root, start, stop):
    for i in range(start, stop):
        # Every third file is a copy of another one.
        (root / f"{i}.png").write_bytes(png(i + 1, 10, b"A") if i % 3 else png(1, 1, b"A"))


@pytest.mark.parametrize("files_per_batch", [3, 100])
def test_stream_equals_batch(spark, registry, vocab, tree, tmp_path, files_per_batch):
    many(tree, 0, 10)
    seen = []
    stream_register(
        registry,
        file_stream(spark, str(tree), files_per_batch=files_per_batch),
        last_byte_scorer,
        vocab,
        str(tmp_path / "state"),
        on_batch=lambda number, result: seen.append((number, result.files)),
    ).awaitTermination()
    assert sum(files for _, files in seen) == 10
    assert len(seen) == -(-10 // files_per_batch)
    other = Registry(spark, str(tmp_path / "other")).init()
    register(other, str(tree), last_byte_scorer, vocab)
    assert stored(registry) == stored(other)


def test_stream_takes_new_files_and_survives_a_lost_checkpoint(spark, registry, vocab, tree, tmp_path):
    def run(state):
        stream_register(
            registry,
            file_stream(spark, str(tree)),
            last_byte_scorer,
            vocab,
            str(tmp_path / state),
            name=state,
        ).awaitTermination()

    many(tree, 0, 4)
    run("one")
    first = stored(registry)
    run("one")
    assert stored(registry) == first
    many(tree, 4, 6)
    run("one")
    second = stored(registry)
    assert len(second) == len(first) + 4
    run("two")
    assert stored(registry) == second
    ids = [r.image_id for r in registry.images().collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
