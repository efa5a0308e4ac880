"""The data source of many small files: one parse for all outputs, partitions by size."""

import pytest

from adipose.operators import export, validate
from adipose.sources import delimited, files


def _folder(tmp_path):
    (tmp_path / "a.csv").write_text("lipid,s1\nABC,1\nDEF,2\n")
    (tmp_path / "b.tsv").write_bytes("lipid\ts1\nsäure\tx\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text('lipid,s1\n"q\nr",1,2\n')
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "_hidden").write_text("x")
    return tmp_path


def test_outputs_come_from_one_parse(spark, tmp_path):
    """The files are gone before any output is asked for, so each was read once."""
    batch = delimited.read_batch(spark, str(_folder(tmp_path)))
    for p in tmp_path.iterdir():
        p.unlink()
    name = lambda x: x.rsplit("/", 1)[1]
    assert {(name(r.dataset_id), r.row_idx): list(r.cells) for r in batch.raw_rows.collect()} == {("a.csv", 1): ["ABC", "1"], ("a.csv", 2): ["DEF", "2"], ("b.tsv", 1): ["säure", "x"], ("c.csv", 1): ["q\nr", "1"]}
    assert {name(r.source_file): (r.delimiter, r.encoding, r.file_size_bytes) for r in batch.datasets.collect()} == {"a.csv": (",", "utf-8", 21), "b.tsv": ("\t", "latin-1", 17), "c.csv": (",", "utf-8", 19), "none.csv": (",", "utf-8", 0)}
    assert batch.columns.count() == 6 and batch.errors.count() == 0
    reports = {name(r.dataset_id): (r.passed, r.issue_count) for r in export.report(*validate.validate(batch.raw_rows, batch.columns)).collect()}
    assert reports == {"a.csv": (True, 0), "b.tsv": (False, 1), "c.csv": (False, 1)}


def test_files_that_fail_do_not_stop_the_others(spark, tmp_path):
    _folder(tmp_path)
    batch = delimited.read_batch(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.tsv")], encoding="utf-8")
    assert [r.dataset_id.rsplit("/", 1)[1] for r in batch.errors.collect()] == ["b.tsv"] and batch.raw_rows.count() == 2
    with pytest.raises(Exception, match="does not exist"):
        delimited.read_batch(spark, str(tmp_path / "absent"))


def test_patterns_and_stores_without_pyarrow(spark, tmp_path, monkeypatch):
    _folder(tmp_path)
    shown = lambda b: sorted((r.dataset_id.rsplit("/", 1)[1], r.row_idx, *r.cells) for r in b.raw_rows.collect())
    one = shown(delimited.read_batch(spark, f"{tmp_path}/*.csv"))
    monkeypatch.setattr(files, "can_open", lambda paths: False)
    assert one == shown(delimited.read_batch(spark, f"{tmp_path}/*.csv")) == [("a.csv", 1, "ABC", "1"), ("a.csv", 2, "DEF", "2"), ("c.csv", 1, "q\nr", "1")]


def test_partitions_by_size(monkeypatch):
    monkeypatch.setattr(files, "OPEN_BYTES", 10)
    found = [files.Found(f"f{k}", n) for k, n in enumerate([5, 500, 40, 40, 0, 90])]
    bins = files.packed(found, 100)
    assert sorted(p for b in bins for p in b) == [f"f{k}" for k in range(6)] and bins[0] == ["f1"] and bins[1] == ["f5"]
    size = {f.path: f.size + 10 for f in found}
    assert all(len(b) == 1 or sum(size[p] for p in b) <= 100 for b in bins)


def test_can_open():
    assert files.can_open(["/a/b", "file:/a/b", "file:///a"]) and not files.can_open(["viewfs://store/in"])


def test_a_file_that_fails_late_leaves_no_rows(spark, tmp_path):
    _folder(tmp_path)
    (tmp_path / "late.csv").write_text("lipid,s1\n" + "ok,1\n" * 6000 + "x" * 140_000 + ",1\n")
    batch = delimited.read_batch(spark, str(tmp_path))
    name = lambda t: {r.dataset_id.rsplit("/", 1)[1] for r in t.select("dataset_id").distinct().collect()}
    assert name(batch.errors) == {"late.csv"}
    assert not {"late.csv"} & (name(batch.raw_rows) | name(batch.columns) | name(batch.datasets))
    assert name(batch.raw_rows) == {"a.csv", "b.tsv", "c.csv"}
