"""CSV with line breaks in quotes, read by many tasks."""

import csv
import random

import pytest

from cohorta.sources import csvfile as C
from cohorta.sources.readers import read_source

VALUES = ["a", "x,y", 'say "hi"', "two\nlines", "crlf\r\nin", "", '5" pipe', "end\n", "\n\nmany\n\n\n", "é漢", " q ", "long " * 60,
          '"', '""\n"', "tab\there"]


@pytest.fixture()
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def write(path, rows, header=("id", "a", "b"), sep=",", end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end, delimiter=sep)
        w.writerow(header)
        w.writerows(rows)


def plain(rows):
    # Spark reads an empty field as NULL
    return sorted(tuple(None if x == "" else x for x in r) for r in rows)


def read(spark, path):
    return sorted(tuple(r) for r in read_source(spark, path).collect())


@pytest.mark.parametrize("joined", [C.JOINED_SPLITS, 0])
def test_line_breaks_over_many_splits(spark, tmpdir_path, small_splits, monkeypatch, joined):
    monkeypatch.setattr(C, "JOINED_SPLITS", joined)
    rng = random.Random(joined)
    rows = [(str(i), rng.choice(VALUES), rng.choice(VALUES)) for i in range(300)]
    path = f"{tmpdir_path}/a.csv"
    write(path, rows)
    assert read(spark, path) == plain(rows)
    assert C._lines(spark, path).rdd.getNumPartitions() > 10


def test_records_longer_than_a_split(spark, tmpdir_path, small_splits):
    rows = [("1", "begin\n" + "line of text\n" * 400, "z"), ("2", "x", "y"), ("3", '"\n' * 900, "")]
    write(f"{tmpdir_path}/long.csv", rows)
    assert read(spark, f"{tmpdir_path}/long.csv") == plain(rows)


def test_folder_tsv_and_line_ends(spark, tmpdir_path, small_splits):
    import os
    os.mkdir(f"{tmpdir_path}/some.csv")
    rows = [[(f"{k}-{i}", VALUES[(i + k) % len(VALUES)], "b\nc") for i in range(40)] for k in range(3)]
    for k, part in enumerate(rows):
        write(f"{tmpdir_path}/some.csv/{k}.csv", part, end="\r\n")
    assert read(spark, f"{tmpdir_path}/some.csv") == plain(sum(rows, []))
    write(f"{tmpdir_path}/t.tsv", rows[0], sep="\t")
    assert read(spark, f"{tmpdir_path}/t.tsv") == plain(rows[0])


def test_header_with_a_line_break_and_odd_names(spark, tmpdir_path):
    write(f"{tmpdir_path}/h.csv", [("1", "x\ny", "z")], header=("id", "two\nlines", "c`d"))
    got = read_source(spark, f"{tmpdir_path}/h.csv")
    assert got.columns == ["id", "two\nlines", "c`d"] and tuple(got.first()) == ("1", "x\ny", "z")


def test_plain_files_take_the_plain_reader(spark, tmpdir_path):
    rows = [("1", 'say "x", y', "5\" pipe"), ("2", "", "b")]
    write(f"{tmpdir_path}/p.csv", rows)
    got = read_source(spark, f"{tmpdir_path}/p.csv")
    assert "csv" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == plain(rows)
    # a quote inside an unquoted field opens nothing
    with open(f"{tmpdir_path}/stray.csv", "w") as f:
        f.write('id,a\n1,5" pipe\n2,"two\nlines"\n3,6" and 7"\n')
    assert read(spark, f"{tmpdir_path}/stray.csv") == [("1", '5" pipe'), ("2", "two\nlines"), ("3", '6" and 7"')]


def test_states():
    for line in ['a,"b', 'a,b', '"x"', '"x', '""', '"a""', 'a"b,"c,"', ',"",', '"a","b', 'x"']:
        out, inside = False, False
        # a plain automaton over characters
        for start, want in ((False, C.ends_inside(line, False, ",")), (True, C.ends_inside(line, True, ","))):
            inside, field_start, i = start, not start, 0
            while i < len(line):
                ch = line[i]
                if inside and ch == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside = False
                elif not inside and ch == '"' and field_start:
                    inside = True
                field_start = not inside and ch == ","
                i += 1
            assert inside == want, (line, start)
