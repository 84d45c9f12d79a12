from __future__ import annotations

import json

import pytest
from builders import png, rows

from pyspark.sql import functions as F

from shelfmark.operators.metadata import extract_metadata, extraction_status, file_metadata
from shelfmark.session import staged
from shelfmark.sources import list_files, read_by_path, read_files, read_vocab, scan_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.png").write_bytes(png(1, 2))
    (root / "b c%20.PNG").write_bytes(png(3, 4))
    (root / "noext").write_bytes(png(5, 6))
    (root / "empty.png").write_bytes(b"")
    (root / ".hidden.png").write_bytes(png(7, 8))
    (root / "_under.png").write_bytes(png(9, 10))
    (root / "sub" / "d.png").write_bytes(png(11, 12))
    (root / "link.png").symlink_to(root / "sub" / "d.png")
    (root / "linked").symlink_to(root / "sub")
    (root / "dangling.png").symlink_to(root / "nothing")
    return root


ODD = [".hidden.png", "_under.png", "a.png", "b c%20.PNG", "dangling.png", "empty.png", "link.png", "linked", "noext"]


def _statuses(found, root):
    return {r.file_location.removeprefix(f"{root}/"): r.status for r in found.collect()}


@pytest.mark.parametrize("content", [True, False])
@pytest.mark.parametrize("recursive", [True, False])
def test_every_file_is_listed_with_its_status(spark, tree, content, recursive):
    listed = list_files(spark, str(tree), recursive)
    found = _statuses(extract_metadata(read_files(listed)) if content else file_metadata(listed), tree)
    assert sorted(found) == ODD + ["sub/d.png"] * recursive
    wrong = {"dangling.png": "unreadable", "linked": "unreadable", "empty.png": "empty"}
    assert found == {name: wrong.get(name, "ok") for name in found}


def test_files_that_vanish_or_are_closed_to_us(spark, tree):
    listed = staged(list_files(spark, str(tree)), "listed")
    (tree / "a.png").unlink()
    (tree / "noext").unlink()
    (tree / "noext").mkdir()
    found = file_metadata(listed)
    bad = {r.file_location.rsplit("/", 1)[-1]: r.error for r in found.where("status = 'unreadable'").collect()}
    assert set(bad) == {"a.png", "noext", "linked", "dangling.png"}
    assert bad["a.png"].startswith("FileNotFoundError") and bad["noext"].startswith("IsADirectoryError")


def test_a_file_beyond_a_columns_size(spark, tree, monkeypatch):
    """Bytes in a column are limited and told so; metadata of files is not."""
    import shelfmark.sources.files as files

    monkeypatch.setattr(files, "MAX_CONTENT", 5)
    probed = list(files._probed(files.opener(), str(tree / "a.png")))
    assert probed[0] == len(png(1, 2)) and probed[-1] is None
    assert extraction_status_of(spark, files.TOO_LARGE) == "too_large"


def extraction_status_of(spark, error):
    one = F.lit(1)
    return spark.range(1).select(extraction_status(F.lit("/x"), one, one, F.lit(error), one)).first()[0]


def test_bytes_and_files_give_the_same_metadata(spark, tree):
    from builders import jpeg

    (tree / "long.jpg").write_bytes(b"\xff\xd8" + (b"\xff\xe1\xff\xff" + bytes(65533)) * 40 + jpeg(64, 48)[2:])
    listed = list_files(spark, str(tree), recursive=True)
    columns = ["path", "file_location", "width", "height", "file_type", "hash", "status"]
    assert rows(file_metadata(listed), *columns) == rows(extract_metadata(read_files(listed)), *columns)
    assert rows(file_metadata(listed).where("file_type = 'jpg'"), "width", "height", "status") == [(64, 48, "ok")]


def test_a_folder_that_is_gone_or_closed_is_one_row(spark, tree):
    """Between two levels a folder vanishes, another turns out to be a file: the listing goes on."""
    import shelfmark.sources.files as files

    paths = [(str(tree / name),) for name in ("sub", "gone", "a.png")]
    found = files._entries(spark.createDataFrame(paths, "path string"), None)
    assert {(r.path, r.kind) for r in found.collect()} == {
        (str(tree / "sub" / "d.png"), "file"), (str(tree / "gone"), "closed"), (str(tree / "a.png"), "closed"),
    }
    (row,) = file_metadata(found.where("path like '%gone'")).collect()
    assert row.status == "unreadable" and row.error.startswith("FileNotFoundError")


def test_a_large_flat_folder_leaves_its_task_in_pieces(spark, tmp_path):
    import tracemalloc

    import shelfmark.sources.files as files

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(30_000):
        (flat / f"{i:05d}.png").touch()
    tracemalloc.start()
    pieces = sum(1 for _ in files.batched(files._inside(str(flat)), files.LISTED_AT_ONCE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces == 3 and peak < 20_000_000
    assert list_files(spark, str(flat)).count() == 30_000
    assert list_files(spark, str(flat), name_pattern="0000*").count() == 10


def test_pipes_are_left_out(spark, tmp_path):
    import os

    os.mkfifo(tmp_path / "pipe")
    (tmp_path / "file").write_bytes(b"x")
    assert [r.path for r in list_files(spark, str(tmp_path)).collect()] == [str(tmp_path / "file")]


def test_a_file_gives_itself_and_a_missing_path_raises(spark, tree):
    found = scan_files(spark, str(tree / "a.png"))
    assert [r.length for r in found.collect()] == [len(png(1, 2))]
    with pytest.raises(FileNotFoundError):
        scan_files(spark, str(tree / "missing"))


def test_name_pattern(spark, tree):
    assert scan_files(spark, str(tree), name_pattern="a*").count() == 1
    assert list_files(spark, str(tree), recursive=True, name_pattern="d*").count() == 2
    assert list_files(spark, str(tree / "a.png"), name_pattern="b*").count() == 0


def test_locations_lead_back_to_the_bytes(spark, tree):
    read = read_by_path()
    for row in extract_metadata(scan_files(spark, str(tree))).where("status = 'ok'").collect():
        assert len(read(row.file_location)) == len(read(row.path)) == row.file_size


def test_vocabulary_document(spark, tmp_path):
    mapping = {
        "tag_to_idx": {"cat": 0, "dog": 1, "odd": 2},
        "tag_to_category": {"cat": "general", "dog": "character"},
    }
    path = tmp_path / "vocab.json"
    path.write_text(json.dumps({"dataset_info": {"tag_mapping": mapping}}, indent=2))
    assert rows(read_vocab(spark, str(path))) == [
        (0, "cat", "general"),
        (1, "dog", "character"),
        (2, "odd", "unknown"),
    ]
