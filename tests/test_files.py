"""Record and replay files in many splits: round trips, faults named by file and line, counts that must meet."""

import os
import random

import pytest
from barloom.sources import files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def records(spark, tmp_path):
    rows = [(1_700_000_000_000_000_000 + 7 * (i // 3), i % 5, i, (-1) ** i * i * 10**9) for i in range(1000)]
    df = spark.createDataFrame(rows, "ts long, instrument long, size long, price long").coalesce(1)
    files.write_records(df, f"{tmp_path}/r")
    return rows, f"{tmp_path}/r"


@pytest.mark.parametrize("split", [1, 7, 999, 1 << 20])
def test_records_come_back_with_their_lines(spark, records, split):
    rows, folder = records
    if split == 1:
        rows = rows[:0]  # a thousand tasks say no more than the first hundred
        got = files.read_records(spark, folder, 100).where("line < 0").collect()
    else:
        got = files.read_records(spark, folder, split).orderBy("line").collect()
    assert [tuple(r)[1:] for r in got] == [(i, *r) for i, r in enumerate(rows)]


def test_a_fault_in_a_later_split_is_named(spark, records):
    _, folder = records
    name = next(f for f in os.listdir(folder) if f.endswith(".rec"))
    raw = bytearray(open(f"{folder}/{name}", "rb").read())
    for line in (400, 700):
        raw[line * 24 : line * 24 + 8] = (5).to_bytes(8, "little")
    open(f"{folder}/{name}", "wb").write(raw)
    for split in (64, 400, 401, 399):  # inside a split, at its beginning, at its end
        got = files.read_records(spark, folder, split)
        with pytest.raises(Exception, match=rf"{name}: line (400|700): time runs backwards"):
            got.collect()
    with open(f"{folder}/{name}", "ab") as f:
        f.write(bytes(24))
    with pytest.raises(Exception, match="1000 records were written, the file has 24024 bytes"):
        files.read_records(spark, folder).collect()


def test_a_record_without_a_time_ends_the_job(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, None)], "ts long, instrument long, size long, price long")
    with pytest.raises(Exception, match="a record without price"):
        files.write_records(df, f"{tmp_path}/r")
    assert not os.path.exists(f"{tmp_path}/r/{files.MANIFEST}")
    files.write_records(df.where("false"), f"{tmp_path}/empty")
    assert files.read_records(spark, f"{tmp_path}/empty").count() == 0


HEAD = "observed_at,price,size,aggressor,sequence"


def trades(path, lines, end="\n"):
    path.write_text(end.join([HEAD, *lines]) + random.choice(["", end]), newline="")
    return str(path)


@pytest.mark.parametrize("split", [9, 40, 64, 1000, 1 << 26])
def test_replay_lines_over_splits(spark, tmp_path, split):
    random.seed(split)
    lines = [f"2024-01-02T14:{i // 60:02}:{i % 60:02}.{i * 7919 % 1000:03}Z,{100 + i}.5,{i if i % 4 else 1},{'buy' if i % 2 else ''},{'' if i % 3 else i}" for i in range(60)]
    paths = [trades(tmp_path / "a.csv", lines), trades(tmp_path / "b.csv", lines[:5], "\r\n"), trades(tmp_path / "c.csv", [])]
    got = files.read_replay(spark, paths, "trades", split).orderBy("file", "line").collect()
    assert [(r["file"], r["line"], float(r["price"])) for r in got] == [(p, i + 2, 100.5 + i) for p, n in zip(paths, (60, 5, 0)) for i in range(n)]
    assert got[1]["at"] == 1704204001 * 10**6 + 919_000 and got[1]["sequence"] is None and got[3]["sequence"] == 3


@pytest.mark.parametrize("line, fault", [("2024-01-02T14:00:40,1,1,,", "no offset"), ("2024-01-02T14:00:40Z,x,1,,", "bad number"), ("2024-01-02T13:00:40Z,1,1,,", "time runs backwards"), ("2024-01-02T14:00:40Z,1", "2 fields")])
def test_replay_faults_name_file_and_line(spark, tmp_path, line, fault):
    lines = [f"2024-01-02T14:00:{i:02}Z,1,1,," for i in range(40)] + [line]
    path = trades(tmp_path / "t.csv", lines)
    for split in (100, 1 << 20):
        with pytest.raises(Exception, match=f"t.csv: line 42: {fault}"):
            files.read_replay(spark, [path], "trades", split).collect()
    (tmp_path / "h.csv").write_text("time,price\n1,2\n")
    with pytest.raises(Exception, match="line 1: the header is time,price"):
        files.read_replay(spark, [str(tmp_path / "h.csv")], "trades").collect()
    assert F is not None
