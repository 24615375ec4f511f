import threading
from pathlib import Path
from types import SimpleNamespace

import pytest

from rangeloom import storage


def test_materialize_and_scratch(spark):
    with storage.scratch() as tables:
        gone = storage.materialize(spark.range(3), "a")
        kept = tables.keep(storage.materialize(spark.range(4), "b"))
    assert not Path(gone._stored_at).exists() and kept.count() == 4
    with pytest.raises(RuntimeError), storage.scratch():
        left = storage.materialize(spark.range(5), "c")
        raise RuntimeError
    assert left.count() == 5 and not storage._open.get()


def test_scratch_of_one_thread_leaves_others_tables(spark):
    made, go = [], threading.Event()

    def other():
        made.append(storage.materialize(spark.range(6), "d"))
        go.set()

    with storage.scratch():
        t = threading.Thread(target=other)
        t.start()
        go.wait(60)
        t.join()
    assert made[0].count() == 6 and Path(made[0]._stored_at).exists()


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=context)

    with pytest.raises(ValueError):
        storage.shared_dir(session("spark://host:7077"))
    assert storage.shared_dir(session("local[4]"))
