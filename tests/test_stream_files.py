from __future__ import annotations

import os

import pytest
from builders import png
from pyspark.sql import functions as F
from test_register import last_byte_scorer, many, stored, vocab  # noqa: F401

from shelfmark.plans.register import register
from shelfmark.registry import Registry
from shelfmark.session import staged
from shelfmark.sources import file_stream
from shelfmark.streaming import register as streaming
from shelfmark.streaming import rounds
from shelfmark.streaming.register import stream_register


def name_of(location):
    return location.rsplit("/", 1)[-1]


@pytest.fixture
def follow(spark, registry, vocab, tmp_path):  # noqa: F811
    """A folder and a function that works off what it has; the calls of on_batch are told to ``seen``."""
    root = tmp_path / "growing"
    root.mkdir()
    seen, skipped = [], []

    def run(scorer=last_byte_scorer, fail=False, files_per_batch=3, **more):
        def once(number, result):
            seen.append((number, result.files))
            if result.metadata is not None:
                skipped.extend((name_of(r.file_location), r.status) for r in result.skipped_files.collect())
            if fail:
                raise InterruptedError("lost")

        stream = file_stream(spark, str(root), files_per_batch=files_per_batch)
        query = stream_register(registry, stream, scorer, vocab, str(tmp_path / "state"), on_batch=once, **more)
        query.awaitTermination()
        return query

    run.root, run.seen, run.skipped, run.state = root, seen, skipped, tmp_path / "state"
    return run


def registered(registry):
    return sorted(name_of(r.file_location) for r in registry.images().collect())


def test_stream_takes_files_of_any_name_and_size(registry, follow):
    root, seen = follow.root, follow.seen
    (root / "a.png").write_bytes(png(1, 2, b"A"))
    (root / "_DSC1234.png").write_bytes(png(3, 4, b"A"))
    (root / ".x.png").write_bytes(png(5, 6, b"A"))
    (root / "empty.png").write_bytes(b"")
    query = follow()
    assert query.exception() is None and not query.isActive and query.lastProgress["sources"]
    assert seen == [(0, 3), (1, 1)] and follow.skipped == [("empty.png", "empty")]
    assert registered(registry) == [".x.png", "_DSC1234.png", "a.png"]
    follow()
    assert len(seen) == 2
    (root / "_later.png").write_bytes(png(7, 8, b"A"))
    with pytest.raises(Exception, match="lost"):
        follow(fail=True)
    assert len(registered(registry)) == 4  # the lot was committed before the run broke off
    follow()
    assert len(registered(registry)) == 4 and seen[2:] == [(2, 1), (2, 0)]
    assert len([n for n in os.listdir(follow.state / "rounds") if n.isdigit()]) == 2


def test_changed_files_come_again(registry, follow):
    whole = png(9, 9, b"body of the image A")
    (follow.root / "cut.png").write_bytes(whole[:12])
    (follow.root / "same.png").write_bytes(png(1, 1, b"A"))
    follow()
    assert follow.skipped == [("cut.png", "unsupported")] and registered(registry) == ["same.png"]
    (follow.root / "cut.png").write_bytes(whole)
    follow()
    assert registered(registry) == ["cut.png", "same.png"]
    (follow.root / "same.png").write_bytes(png(2, 2, b"A"))
    follow()
    assert follow.seen == [(0, 2), (1, 1), (2, 1)] and registered(registry) == ["cut.png", "same.png", "same.png"]
    (follow.root / "cut.png").unlink()
    follow()
    (follow.root / "cut.png").write_bytes(whole)
    follow()  # it was away, so it is looked at; its content is known
    assert follow.seen[3:] == [(3, 1)] and len(registered(registry)) == 3


def flaky(marks):
    """Fails on each content until its mark is there."""

    def make():
        def score(contents):
            return [ValueError("not yet") if not os.path.exists(f"{marks}/ready") else [1.0, -1.0, -1.0] for _ in contents]

        return score

    return make


def test_failed_files_are_tried_a_bounded_number_of_times(registry, follow, tmp_path):
    (follow.root / "later.png").write_bytes(png(1, 2, b"A"))
    os.symlink(follow.root / "target", follow.root / "link.png")
    follow(flaky(tmp_path))
    follow(flaky(tmp_path))
    assert follow.seen == [(0, 2), (1, 2)] and registered(registry) == []
    (tmp_path / "ready").write_text("")
    (follow.root / "target").write_bytes(png(3, 4, b"A"))
    follow(flaky(tmp_path))
    # link and target are one content
    assert len(registered(registry)) == 2 and "later.png" in registered(registry)
    before = len(follow.seen)
    os.symlink(follow.root / "nowhere", follow.root / "dangling.png")
    for _ in range(rounds.MAX_ATTEMPTS + 2):
        follow(flaky(tmp_path))
    assert len(follow.seen) == before + rounds.MAX_ATTEMPTS
    assert [s for s in follow.skipped if s[0] == "dangling.png"] == [("dangling.png", "unreadable")] * rounds.MAX_ATTEMPTS


def test_lots_have_positions_and_one_that_broke_off_is_taken_up(spark, registry, vocab, follow, tmp_path):  # noqa: F811
    many(follow.root, 0, 23)
    told = []

    def breaks(number, result):
        told.append(result.position)
        if number == 4 and len(told) == 5:
            raise InterruptedError("lost")

    def run():
        stream = file_stream(spark, str(follow.root), files_per_batch=4)
        stream_register(registry, stream, last_byte_scorer, vocab, str(tmp_path / "st"), on_batch=breaks).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert [(p.lot, p.offset) for p in told] == [(1, 0), (2, 4), (3, 8), (4, 12), (5, 16), (5, 16), (6, 20)]
    assert {(p.lots, p.files) for p in told} == {(6, 23)} and told[0].is_first and told[-1].is_last
    other = Registry(spark, str(tmp_path / "other")).init()
    register(other, str(follow.root), last_byte_scorer, vocab)
    assert stored(registry) == stored(other)


def test_a_lot_reads_its_own_rows_only(spark, follow, tmp_path):
    """Each lot is found by a range of a sorted column, pushed down to the scan."""
    many(follow.root, 0, 40)
    plans = []

    def work(lot, position, label):
        plans.append((lot.count(), lot._jdf.queryExecution().executedPlan().toString()))
        return rounds.Registration()

    steps = rounds.Rounds(file_stream(spark, str(follow.root), files_per_batch=7), work, str(tmp_path / "c"))
    steps(None, 0)
    assert [n for n, _ in plans] == [7, 7, 7, 7, 7, 5]
    assert all("PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in p and "Exchange" not in p for _, p in plans)
    steps(None, 1)
    assert len(plans) == 6


def run_lots(registry, root, state, vocab, each, on_batch=None):  # noqa: F811
    """Counts of each lot, images and tags of a stream over a folder."""
    told = []

    def seen(number, result):
        paths = sorted(name_of(r.path) for r in result.metadata.collect())
        done = sorted(r.outcome for r in result.outcomes.collect()) if result.outcomes is not None else []
        told.append((result.position, result.files, result.skipped, result.known, result.success, result.failure, result.empty, paths, done))
        if on_batch:
            on_batch(number)

    stream = file_stream(registry.spark, str(root), files_per_batch=each)
    stream_register(registry, stream, last_byte_scorer, vocab, str(state), on_batch=seen).awaitTermination()
    images = sorted(registry.images().select("image_id", "file_location", "width", "height", "hash").collect())
    tags = sorted(registry.model_tags().select("image_id", "category", "tag", "score").collect())
    return told, images, tags


def copies_and_failures(root):
    """Each content comes several times: good, failing and empty ones, and files that are no images."""
    for i in range(14):
        content = [png(i + 1, 2, b"A"), png(1, 1, b"A"), png(2, 2, b"F"), png(3, 3, b"E"), b"no image"][i % 5]
        (root / f"{i:02}.png").write_bytes(content)
        os.utime(root / f"{i:02}.png", (i, i))


def test_lots_together_equal_one_by_one(spark, registry, vocab, monkeypatch, tmp_path):  # noqa: F811
    root = tmp_path / "files"
    root.mkdir()
    copies_and_failures(root)
    found = run_lots(registry, root, tmp_path / "state", vocab, 3)
    assert len(found[0]) == 5
    alone = Registry(spark, str(tmp_path / "alone")).init()
    monkeypatch.setattr(streaming, "Rounds", lambda files, work, checkpoint, many: rounds.Rounds(files, work, checkpoint))
    assert found == run_lots(alone, root, tmp_path / "alone-state", vocab, 3)
    assert registry.state().labels and registry.state().batch_id == alone.state().batch_id
    assert [(p.table, p.kind, p.rows) for p in registry.state().parts] == [(p.table, p.kind, p.rows) for p in alone.state().parts]


def test_another_writer_between_lots(spark, registry, vocab, tmp_path):  # noqa: F811
    """What a caller commits after a lot, the lots after it see."""
    root = tmp_path / "files"
    root.mkdir()
    copies_and_failures(root)

    def comes_between(number):
        if number == 0:
            gone = registry.images().where("width = 1 and height = 1").select("image_id")
            registry.remove_tags(gone)
            registry.remove_images(registry.images().where("width = 1 and height = 1"))

    told, images, tags = run_lots(registry, root, tmp_path / "state", vocab, 3, comes_between)
    assert len(told) == 5 and sum(t[1] for t in told) == 14
    assert [r.hash for r in images].count(next(r.hash for r in images if (r.width, r.height) == (1, 1))) == 1
    assert {r.image_id for r in tags} == {r.image_id for r in images}
    assert name_of(next(r.file_location for r in images if (r.width, r.height) == (1, 1))) == "06.png"


def test_jobs_do_not_grow_with_lots(spark, registry, vocab, tmp_path):  # noqa: F811
    root = tmp_path / "files"
    root.mkdir()
    many(root, 0, 12)
    jobs = []
    for each in (12, 1):
        registry = Registry(spark, str(tmp_path / f"catalogue-{each}")).init()
        before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
        stream = file_stream(spark, str(root), files_per_batch=each)
        stream_register(registry, stream, last_byte_scorer, vocab, str(tmp_path / f"state-{each}")).awaitTermination()
        jobs.append(spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before)
        assert registry.images().count() == 9
    assert jobs[1] < jobs[0] + 24  # one by one, eleven more lots took over 200 jobs more


def test_stretches_are_bounded_by_bytes_and_lots(spark, tmp_path, monkeypatch):
    sizes = [10, 10, 90, 10, 10, 10, 200, 10]
    for i, size in enumerate(sizes):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * size)
        os.utime(tmp_path / f"{i}.bin", (i, i))
    monkeypatch.setattr(rounds, "BYTES_TOGETHER", 100)
    monkeypatch.setattr(rounds, "LOTS_TOGETHER", 2)
    seen = []

    def together(files, lots, known, settle):
        placed = sorted((r.lot, name_of(r.path)) for r in files.select("lot", "path").collect())
        seen.append(placed)
        for position, _ in lots:
            yield position, rounds.Registration()

    state = str(tmp_path.parent / f"{tmp_path.name}-state")
    rounds.Rounds(file_stream(spark, str(tmp_path), files_per_batch=1), None, state, together)(None, 0)
    assert [[n for n, _ in s] for s in seen] == [[0, 1], [2, 3], [4, 5], [6], [7]]
    assert all(name == f"{n}.bin" for s in seen for n, name in s)


def test_streams_merge_parts(registry, follow, monkeypatch):
    monkeypatch.setattr(streaming, "MAX_PARTS", 3)
    many(follow.root, 0, 12)
    follow(files_per_batch=2)
    parts = [p.table for p in registry.state().parts]
    assert parts.count("images") <= 4 and registry.images().count() == 9


def test_a_stream_goes_on_until_it_is_stopped(registry, follow, monkeypatch):
    import time

    monkeypatch.setattr(streaming, "INTERVAL", 1)
    many(follow.root, 0, 2)
    query = stream_register(
        registry, file_stream(registry.spark, str(follow.root)), last_byte_scorer, staged_vocab(registry.spark),
        str(follow.state), available_now=False,
    )
    for stop, images in ((2, 2), (4, 3)):
        many(follow.root, stop - 2, stop)
        end = time.time() + 60
        while registry.images().count() < images and time.time() < end:
            time.sleep(0.5)
    query.stop()
    assert registry.images().count() == 3 and not query.isActive


def staged_vocab(spark):
    return staged(spark.createDataFrame([(0, "last", "general")], "idx int, tag string, category string"), "vocab")


# ---- the registry's hashes as state -------------------------------------------------------------


@pytest.fixture
def hashes(spark, registry, tmp_path):
    from shelfmark.streaming.hash_state import HashState

    state = HashState(registry, str(tmp_path / "hashes"))

    def ask(*numbers):
        rows_ = spark.createDataFrame([(f"{n:064x}", n) for n in numbers], "hash string, n int")
        return sorted(r.n for r in state.unknown(rows_, registry.state()).collect())

    ask.folder = tmp_path / "hashes"
    return ask


def add(registry, *numbers):
    rows_ = [(f"/f/{n}.png", 1, 1, "png", f"{n:064x}", 1) for n in numbers]
    columns = "file_location string, width int, height int, file_type string, hash string, file_size bigint"
    registry.add_images(registry.spark.createDataFrame(rows_, columns))


def test_state_follows_commits_of_all_kinds(spark, registry, hashes):
    assert hashes(1, 2) == [1, 2] and hashes(1, 1, 2) == [1, 1, 2]  # asking does not make known
    add(registry, 1, 2, 3)
    assert hashes(1, 2, 4) == [4]
    registry.remove_images(registry.images().where("file_location = '/f/2.png'"))
    assert hashes(1, 2, 3) == [2]
    registry.update_images(registry.images().where("file_location = '/f/3.png'").withColumn("width", F.lit(7)))
    add(registry, 2, 5)
    assert hashes(1, 2, 3, 4, 5) == [4]
    registry.remove_images(registry.images().where("file_location = '/f/5.png'"))
    registry.compact("images")
    assert hashes(1, 2, 3, 4, 5) == [4, 5]
    assert hashes() == []
    registry.init(overwrite=True)
    assert hashes(1, 2) == [1, 2] and len(os.listdir(hashes.folder)) == 1


def test_rows_read_do_not_grow_with_the_registry(spark, registry, hashes, monkeypatch):
    from shelfmark.streaming import hash_state

    fed = []
    feed = hash_state.HashState._feed

    def counted(self, root, rows_):
        fed.append(rows_.count())
        feed(self, root, rows_)

    monkeypatch.setattr(hash_state.HashState, "_feed", counted)
    add(registry, *range(500))
    assert hashes(1, 600) == [600] and fed == [500, 2]  # the first question feeds all
    for n in (600, 601):
        add(registry, n)
        del fed[:]
        assert hashes(5, n, 700) == [700] and fed == [1, 3]


def test_stream_with_state_equals_batch(spark, registry, vocab, follow, tmp_path):  # noqa: F811
    many(follow.root, 0, 8)
    follow(state_from_bytes=-1, files_per_batch=4)
    many(follow.root, 8, 14)
    with pytest.raises(Exception, match="lost"):
        follow(state_from_bytes=-1, files_per_batch=4, fail=True)
    follow(state_from_bytes=-1, files_per_batch=4)
    other = Registry(spark, str(tmp_path / "other")).init()
    register(other, str(follow.root), last_byte_scorer, vocab)
    assert stored(registry) == stored(other)
