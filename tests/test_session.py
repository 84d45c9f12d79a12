from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from shelfmark.session import CHECKPOINT_DIR, new_workspace, shared_dir


def _session(master: str, **settings: str):
    conf = SimpleNamespace(get=lambda key, default: settings.get(key, default))
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_shared_folder_of_the_cluster_is_used():
    session = _session("spark://host:7077", **{CHECKPOINT_DIR: "s3a://bucket/shared"})
    assert shared_dir(session) == "s3a://bucket/shared"
    assert new_workspace(session, "x").startswith("s3a://bucket/shared/x-")
    assert new_workspace(session, "x") != new_workspace(session, "x")


def test_a_cluster_without_it_is_refused():
    with pytest.raises(ValueError):
        shared_dir(_session("yarn"))


def test_a_local_session_falls_back_to_one_temporary_folder():
    session = _session("local[2]")
    assert os.path.isdir(shared_dir(session))
    assert shared_dir(session) == shared_dir(session)
