import csv
import random

import pytest
from pyspark.sql import functions as F

from adipose.functions.order import with_row_idx
from adipose.functions.text import number, strip
from adipose.operators import columns, profile, quant, samples, stats
from adipose.sources import delimited
from adipose.sources import reference_tables as ref


def test_numbers(spark):
    good = {"1_000": 1000.0, ".5": 0.5, "5.": 5.0, " 1e5\t": 1e5, "-inf": float("-inf"), "+Infinity": float("inf"), "7": 7.0}
    bad = ["1d", "2.5f", "0x1p3", "1__0", "", "  ", "_1", "NA", None]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad, "+nan"]], "x string").select("x", number(F.col("x")).alias("v"), strip(F.col("x")).alias("s")).collect()
    found = {r.x: r.v for r in rows}
    assert {k: found[k] for k in good} == good
    assert all(found[k] is None for k in bad)
    assert found["+nan"] != found["+nan"]


def test_delimiters(spark):
    texts = {"a,b\n1,2": ",", "a\tb": "\t", "a;b;c": ";", "a|b": "|", "abc": ",", "a,b;c": ",", ",," + "x" * 9000 + ";" * 5: ","}
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", delimited.delimiter(F.col("x")).alias("d")).collect()
    assert {r.x: r.d for r in rows} == texts


def test_row_numbers_follow_the_input(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(f"line {k}" for k in range(1, 501)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = with_row_idx(spark.read.text(str(tmp_path / "x.csv"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.value: r.row_idx for r in rows} == {f"line {k}": k for k in range(1, 501)}


def test_table_with_ragged_rows_and_labels(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name,a,b\nLabel,wt,hb\nPC(16:0), 1 ,2\n"x, y",3\nz,4,5,0.4,\n\nw,,6\n')
    rows, cols = delimited.read_table(spark, str(path), has_labels=True)
    got = {r.row_idx: (list(r.cells), list(r.missing_columns), list(r.extra_fields)) for r in rows.collect()}
    assert got == {1: (["PC(16:0)", "1", "2"], [], []), 2: (["x, y", "3", ""], ["b"], []), 3: (["z", "4", "5"], [], ["0.4", ""]), 4: (["w", "", "6"], [], [])}
    assert [(r.column, r.label) for r in cols.orderBy("col_idx").collect()] == [("name", "Label"), ("a", "wt"), ("b", "hb")]


def _plain(path, sep, encoding="utf-8"):
    """Header and rows as the csv module has them, cells trimmed, wholly empty lines left out."""
    with open(path, encoding=encoding, newline="") as f:
        lines = [[x.strip() for x in r] for r in csv.reader(f, delimiter=sep) if r]
    n = len(lines[0])
    return lines[0], [((r + [""] * n)[:n], lines[0][len(r) :], r[n:]) for r in lines[1:]]


def _read(spark, path, **options):
    done = delimited.read_dataset(spark, str(path), **options)
    rows = [(list(r.cells), list(r.missing_columns), list(r.extra_fields)) for r in done.raw_rows.orderBy("row_idx").collect()]
    assert [r.row_idx for r in done.raw_rows.orderBy("row_idx").select("row_idx").collect()] == list(range(1, len(rows) + 1))
    return [r.column for r in done.columns.orderBy("col_idx").collect()], rows, done.datasets.first()


@pytest.mark.parametrize("multiline", [False, True])
def test_tables_as_the_csv_module_reads_them(spark, tmp_path, multiline):
    r = random.Random(5)
    parts = ["a", "b c", ",", ";", '""', " ", "ü", "\\", "1"] + ["\n", "\r\n"] * multiline
    cell = lambda: r.choice(["", " x ", 'PC ""y""', "\\n"]) if r.random() < 0.3 else '"' + "".join(r.choice(parts) for _ in range(r.randint(0, 6))) + '"' + r.choice(["", "", "tail"])
    lines = ["name,s 1,s2"] + [",".join(cell().replace('PC ""y""', "PC y") for _ in range(r.choice([1, 2, 3, 3, 3, 5]))) for _ in range(300)]
    lines += ["", "   ", ",,", '"PC ""x"" 1",1,2', "z" + ",9" * 90]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines) + "\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        names, rows, about = _read(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (names, rows) == _plain(path, ",")
    assert (about.delimiter, about.encoding, about.format_type, about.file_size_bytes) == (",", "utf-8", "standard", path.stat().st_size)
    assert len(rows[-1][2]) == 88


def test_encodings_formats_and_heads(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("näme;s1\nsäure;1\n".encode("latin-1"))
    names, rows, about = _read(spark, path)
    assert (names, rows, about.encoding, about.delimiter) == (["näme", "s1"], [(["säure", "1"], [], [])], "latin-1", ";")
    path = tmp_path / "msdial.txt"
    path.write_text("Alignment ID\tx, y, z\t(a, b)\n1\t2\t3,4\n")
    names, rows, about = _read(spark, path)
    assert (names, rows, about.format_type) == (["Alignment ID", "x, y, z", "(a, b)"], [(["1", "2", "3,4"], [], [])], "msdial")
    path = tmp_path / "short.csv"
    path.write_text("a,b,c\n" + "1;2\n" * 200)  # the delimiter is counted in 8192 characters, not in the first lines
    assert _read(spark, path)[2].delimiter == ";"
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text("n,x\n" + f"p{k},{k}\n" * 3)
    assert sorted(_read(spark, folder)[1]) == sorted([([f"p{k}", str(k)], [], [])] * 3 for k in range(3) for _ in [0])[0] + [([f"p{k}", str(k)], [], []) for k in (1, 2) for _ in range(3)]
    (tmp_path / "none.csv").write_text("")
    assert _read(spark, tmp_path / "none.csv")[:2] == ([], [])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        _read(spark, tmp_path / "absent.csv")


def test_batch_of_unlike_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x\np,1\nq,2,3\n")
    (tmp_path / "b.txt").write_bytes("n;x\nsäure;1\n".encode("latin-1"))
    (tmp_path / "c.tsv").write_text("Alignment ID\tx, y, z\n1\t2\n")
    batch = delimited.read_batch(spark, str(tmp_path))
    sets = {r.source_file.rsplit("/", 1)[1]: (r.delimiter, r.encoding, r.format_type) for r in batch.datasets.collect()}
    assert sets == {"a.csv": (",", "utf-8", "standard"), "b.txt": (";", "latin-1", "standard"), "c.tsv": ("\t", "utf-8", "msdial")}
    rows = {(r.dataset_id.rsplit("/", 1)[1], r.row_idx): (list(r.cells), list(r.extra_fields)) for r in batch.raw_rows.collect()}
    assert rows == {("a.csv", 1): (["p", "1"], []), ("a.csv", 2): (["q", "2"], ["3"]), ("b.txt", 1): (["säure", "1"], []), ("c.tsv", 1): (["1", "2"], [])}
    assert batch.errors.count() == 0


def test_name_table_file(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("Input name\tStandardized name\tLM_ID\tExact mass\nA\tA1\tLM1\t1.5\nB\t-\t-\theavy\nA\tA2\t\t-\n\tX\tLM3\t2\n")
    got = {r.input_name: (r.standardized_name, r.lm_id, r.exact_mass, r.formula) for r in ref.name_table(spark, str(tmp_path / "n.tsv")).collect()}
    assert got == {"A": ("A2", None, None, None), "B": (None, None, None, None)}


def test_structure_and_id_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("Name\tLM_ID\tAbbrev\nPC\tLM1\t\n")
    row = ref.structure_table(spark, str(tmp_path / "s.tsv")).first()
    assert (row.name, row.lm_id, row.abbrev, row.sys_name) == ("PC", "LM1", None, None)
    (tmp_path / "c.tsv").write_text("lm_id\tAbbrev_Chains\nLM1\t34.1\nLM2\t16:0_18:1\n")
    assert [(r.lm_id, r.abbrev_chains) for r in ref.structure_table(spark, str(tmp_path / "c.tsv")).collect()] == [("LM1", 34.1), ("LM2", None)]
    texts = spark.createDataFrame([('[{"id": 7, "reactants": []}, {"reaction_id": 3, "id": 8, "enzyme_ids": ["e"]}]',)], "text string")
    assert [(r.reaction_id, r.enzyme_ids) for r in ref.reactions_from_json(texts).collect()] == [(7, None), (3, ["e"])]
    (tmp_path / "i.csv").write_text('lm_id,name\nLM1,"PE(13:0/18:4(6Z,9Z))"\n')
    assert ref.id_name_table(spark, str(tmp_path / "i.csv")).collect() == [("LM1", "PE(13:0/18:4(6Z,9Z))")]
    keys = ref.structure_keys(spark.createDataFrame([("PC", "LM2", "X", None, "b"), ("X", "LM1", "PC", "a", None)], "name string, lm_id string, sys_name string, abbrev string, abbrev_chains string"))
    assert {r.key: (r.matched_field, r.lm_id) for r in keys.collect()} == {"PC": ("name", "LM2"), "X": ("name", "LM1"), "a": ("abbrev", "LM1"), "b": ("abbrev_chains", "LM2")}


def test_columns():
    names = ["id", "x", "", "y"]
    assert columns.lipid_column(names) == 0 and columns.lipid_column(names, "y") == 3 and columns.lipid_column(names, 1) == 1
    assert columns.sample_columns(names, 0) == [1, 3] and columns.sample_columns(names, 0, "y") == [3] and columns.sample_columns(names, 0, [2, 3]) == [3]
    with pytest.raises(ValueError, match="4 columns"):
        columns.lipid_column(names, 9)
    with pytest.raises(ValueError, match="id, x"):
        columns.lipid_column(names, "z")


def _raw(spark, names, rows):
    raw = spark.createDataFrame([("d", k, r, [], []) for k, r in enumerate(rows, 1)], "dataset_id string, row_idx long, cells array<string>, missing_columns array<string>, extra_fields array<string>")
    cols = spark.createDataFrame([("d", k, n, None) for k, n in enumerate(names)], "dataset_id string, col_idx int, column string, label string")
    return raw, cols


def test_profile_extract_and_statistics(spark):
    names = ["Lipid", "Control_1", "Control_2", "Control_3", "note", "none"]
    raw, cols = _raw(spark, names, [["PC(16:0/18:1)", "120.5", "118.7", "121.2", "a-1", ""], ["", "1", "2", "3", "b", ""], ["x", "1", "", "2", "c", ""]])
    kinds = profile.column_profile(profile.long_cells(raw))
    assert {r.col_idx: r.column_type for r in kinds.collect()} == {0: "text", 1: "numeric", 2: "numeric", 3: "numeric", 4: "identifier", 5: None}
    q = quant.extract(raw, cols, kinds)
    assert q.count() == 5
    sample = samples.sample_table(q.select("dataset_id", "ordinal", "sample_id").distinct())
    row = stats.lipid_group_values(q, sample).where("row_idx = 1").first()
    assert (row.group, round(row["mean"], 6), round(row["std"], 6)) == ("Control", 120.133333, 1.053038)
    z = {r.sample_id: r.z for r in stats.zscores(q).where("row_idx = 3").collect()}
    assert z == {"Control_1": -1.0, "Control_3": 1.0}


def test_columns_that_are_half_text_are_dropped(spark):
    raw, cols = _raw(spark, ["s", "a"], [["p", "1"], ["q", "x"]])
    assert quant.extract(raw, cols, profile.column_profile(profile.long_cells(raw))).count() == 0


def test_groups(spark):
    ids = ["dr_young_2", "N-FS-CamN-11C", "12a", "___", "wt"]
    got = {r.sample_id: r.group for r in samples.sample_table(spark.createDataFrame([(x,) for x in ids], "sample_id string")).collect()}
    assert got == {"dr_young_2": "dr_young", "N-FS-CamN-11C": "N-FS-CamN-", "12a": "unknown", "___": "unknown", "wt": "wt"}


def test_labels_by_name_and_position(spark):
    _, cols = _raw(spark, ["m", "a", "b", "c"], [])
    cols = cols.withColumn("label", F.concat(F.lit("l"), "col_idx"))
    chosen = spark.createDataFrame([("d", 0, "b"), ("d", 1, "c")], "dataset_id string, ordinal int, sample_id string")
    assert {r.sample_id: r.label for r in samples.with_labels(chosen, cols).collect()} == {"b": "l2", "c": "l3"}
    assert {r.sample_id: r.label for r in samples.with_labels(chosen, cols, by="position").collect()} == {"b": "l1", "c": "l2"}
