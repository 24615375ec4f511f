import random

import pytest

from rangeloom import cli
from rangeloom.sources import binary


@pytest.fixture
def lineitem(tmp_path):
    rng = random.Random(1)
    rows = [f"{k},2,3,{k % 7},5.0,6.0,0.1,0.2,{rng.choice('ANR')},{rng.choice('OF')},1996-03-13,1996-02-12,1996-03-22,{rng.choice(['NONE', 'COLLECT COD'])},TRUCK,comment {k}" for k in range(400)]
    path = tmp_path / "lineitem.csv"
    path.write_text(",".join(f"c{i}" for i in range(16)) + "\n" + "\n".join(rows) + "\n")
    return str(path)


def test_sort_and_verify(spark, lineitem, tmp_path, capsys):
    cli.main(["sort", lineitem, "--format", "lineitem", "--verify", "--merge", "3", "--runs-of", "2", "--output", str(tmp_path / "out")], spark)
    said = capsys.readouterr().out
    assert "verified: 400 rows, 0 out of order, complete: True" in said and "Merge 1: 2 runs into 3 partitions" in said
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_estimate_and_plan(spark, lineitem, capsys):
    cli.main(["sort", lineitem, "--format", "lineitem", "--estimate-size"], spark)
    assert "Estimated size: 0.0" in capsys.readouterr().out
    cli.main(["sort", lineitem, "--format", "lineitem", "--print-plan"], spark)
    assert "regime: ThreadBound" in capsys.readouterr().out
    cli.main(["plan", "--dataset-mb", "204800", "--memory-mb", "256", "--threads", "16"])
    assert "regime: MemoryBound" in capsys.readouterr().out


def test_convert_discard_scan_generate(spark, lineitem, tmp_path, capsys):
    cli.main(["convert", lineitem, "--format", "lineitem", "--output", str(tmp_path / "kv")], spark)
    assert binary.read_kvbin(spark, str(tmp_path / "kv")).count() == 400
    cli.main(["sort", str(tmp_path / "kv"), "--format", "kvbin", "--discard", "--partition", "KeyOnly", "--warmup", "1", "--imbalance", "2"], spark)
    assert capsys.readouterr().out.count("400 rows") == 2
    cli.main(["scan", lineitem, "--format", "lineitem", "--splits", "1,2"], spark)
    assert capsys.readouterr().out.count("M rows/s") == 2
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    cli.main(["generate", "freq_key", "--rows", "500", "--output", str(tmp_path / "gen")], spark)
    assert binary.read_kvbin(spark, str(tmp_path / "gen")).count() == 500
    cli.main(["sketch", "--rows", "5000"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 25
