"""One table in many splits with quoted line ends and lone quotes, against the csv module; order of files, marks and labels."""

import csv
import io
import random

import pytest

from adipose.sources import delimited, quoted
from test_sources import _plain, _read


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_walks_as_the_csv_module():
    r = random.Random(1)
    for _ in range(5000):
        text = "".join(r.choice(['"', '"', "a", ",", ",", "\n", "\r", "\r\n", " ", '""']) for _ in range(r.randint(0, 25)))
        want = [[x.strip() for x in row] for row in csv.reader(io.StringIO(text, newline="")) if row]
        lines = text.removesuffix("\n").split("\n")
        scanner, cut = quoted.Scanner(","), r.randint(0, len(lines))
        first, whole = quoted.Walk(scanner, False, False), quoted.Walk(scanner, False)
        texts = [t for line in lines for _, t in whole.feed(line)] + ["\n".join(whole.parts)] * bool(whole.parts)
        assert quoted.cells_of(texts, ",") == want
        for line in lines[:cut]:
            first.feed(line)
        second = quoted.Walk(scanner, first.inside, False)
        for line in lines[cut:]:
            second.feed(line)
        assert first.started() + second.started() == len(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_file_of_many_splits(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    parts = ["a", "b c", ",", '""', " ", "ü", "\n", "\r\n", "line of some length"]
    cell = lambda: r.choice(["", "x", '5"', 'a""b', "12"]) if r.random() < 0.7 else '"' + "".join(r.choice(parts) for _ in range(r.randint(0, 9))) + '"' + r.choice(["", "tail"])
    lines = ['"name\nof it",s1,s2'] + [",".join(cell() for _ in range(r.choice([2, 3, 3, 4]))) for _ in range(900)]
    lines[300] = '"a field over splits ' + "\n".join(f"part {k}, 5" for k in range(1500)) + '",2'  # some eight splits inside one field
    path = tmp_path / "t.csv"
    path.write_text(r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n"]), newline="")
    names, rows, about = _read(spark, path)
    assert (names, rows) == _plain(path, ",")
    assert about.file_size_bytes == path.stat().st_size > 20 * 2048


def test_no_task_reads_a_whole_file(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("n,x\n" + '"a\nb",5"\n' * 2000)
    read = delimited.read_dataset(spark, str(path))
    states = quoted.split_states(spark.read.option("lineSep", "\n").text(str(path)).selectExpr("_metadata.file_path as file", "_metadata.file_block_start as block", "value as line"), ",")
    assert read.raw_rows.count() == 2000 and states.count() > 8
    assert max(r.rows for r in states.collect()) < 400


def test_more_splits_than_are_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(quoted, "BROADCAST_SPLITS", 0)
    path = tmp_path / "t.csv"
    path.write_text("n,x\n" + "".join(f'"a\n{k}",5"\n' for k in range(1500)))
    assert _read(spark, path)[:2] == _plain(path, ",")


@pytest.mark.parametrize("odd", ["", '5"'])
def test_files_in_order_of_their_paths(spark, tmp_path, odd):
    folder = tmp_path / "many"
    folder.mkdir()
    for k, n in enumerate([2, 400, 30]):
        (folder / f"{k}.csv").write_text("n,x\n" + "".join(f"p{k},{j}{odd}\n" for j in range(n)))
    rows = _read(spark, folder)[1]
    assert [r[0][0] for r in rows] == ["p0"] * 2 + ["p1"] * 400 + ["p2"] * 30
    assert [r[0][1] for r in rows[:4]] == [f"0{odd}", f"1{odd}", f"0{odd}", f"1{odd}"]


@pytest.mark.parametrize("odd", ["", '5"'])
def test_marks_and_short_labels_alike(spark, tmp_path, odd):
    path = tmp_path / "m.csv"
    path.write_bytes(b"\xef\xbb\xbf" + f"name,a,b\nLabel,wt\nx,1{odd},2\n".encode())
    one, many = delimited.read_dataset(spark, str(path), has_labels=True), delimited.read_batch(spark, str(path), has_labels=True)
    for done in (one, many):
        assert [(r.column, r.label) for r in done.columns.orderBy("col_idx").collect()] == [("name", "Label"), ("a", "wt"), ("b", None)]
        assert [(r.row_idx, list(r.cells)) for r in done.raw_rows.collect()] == [(1, ["x", f"1{odd}", "2"])]


def test_lone_quotes_and_open_ends(spark, tmp_path):
    for k, text in enumerate(['n,x\n5",1\na,"b\nc', '"n\nm",x\n1,2\n', 'n,x\n\n"",""\n\r\n"a"b"c,"\n', '\n\n"n",x\n1,"', '"']):
        path = tmp_path / f"{k}.csv"
        path.write_text(text, newline="")
        assert _read(spark, path)[:2] == _plain(path, ",")
