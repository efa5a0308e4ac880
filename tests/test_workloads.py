import pytest

from adipose.jobs import workloads
from test_operators import NAME, _compound, _reactions


def test_import_of_a_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Lipid,Control_1,Control_2,Treated_1\nLabel,c,c,t\nPC(16:0),1,3,5\nPE,2,,x\n,1,1,1\n")
    names = spark.createDataFrame([("PE", "PE1", "LM2", *[None] * 8)], NAME)
    done = workloads.import_table(spark, str(path), names, has_labels=True)
    assert {(r.group, r.input_name): (r["mean"], r["std"]) for r in done.means.collect()} == {("Control", "PC(16:0)"): (2.0, 1.0), ("Control", "PE"): (2.0, 0.0)}
    assert {r.group: (r.sample_count, r.lipid_coverage) for r in done.coverage.collect()} == {"Control": (2, 2), "Treated": (1, 0)}
    assert {r.input_name: r.lm_id for r in done.lipids.collect()} == {"PC(16:0)": None, "PE": "LM2"}
    assert {r.sample_id: r.label for r in done.samples.collect()} == {"Control_1": "c", "Control_2": "c", "Treated_1": "t"}
    with pytest.raises(ValueError):
        workloads.import_table(spark, str(path), names, lipid="none")


def test_reports_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lipid,s1\nABC,1\nDEF,2\n")
    (tmp_path / "b.tsv").write_text("lipid\ts1\nABC\tx\n")
    (tmp_path / "c.csv").write_text("lipid,s1\n")
    got = {r.dataset_id.rsplit("/", 1)[1]: (r.passed, r.issue_count) for r in workloads.validate_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (True, 0), "b.tsv": (False, 1), "c.csv": (False, 1)}


def test_links_of_filled_lipids(spark):
    lipids = spark.createDataFrame([(1, "A", None, "LM1", "RefMet"), (2, "B", None, None, None), (3, "PC-1 x", None, None, None)], "row_idx long, input_name string, standardized_name string, lm_id string, lm_id_found_by string")
    structures = spark.createDataFrame([("B", "LM2", None, None, None)], "name string, lm_id string, sys_name string, abbrev string, abbrev_chains string")
    heads = spark.createDataFrame([("PC-1", ["LM3"])], "headgroup string, lm_ids array<string>")
    m = "lm_main"
    table = _reactions(spark, [([_compound(m, "a", "LM1")], [_compound(m, "b", "LM2")]), ([_compound(m, "z", "LM9")], [])])
    done = workloads.link_reactions(lipids, structures, heads, table)
    assert {r.row_idx: r.lm_id for r in done.lipids.collect()} == {1: "LM1", 2: "LM2", 3: "LM3"}
    assert sorted((r.lm_id, r.role) for r in done.links.collect()) == [("LM1", "reactant"), ("LM2", "product")]
    assert done.edges.collect() == [("a", "b", 100, "a -> b")]
