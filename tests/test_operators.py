from pyspark.sql import functions as F

from adipose.operators import annotate, export, reactions, stats, validate
from adipose.sources import reference_tables as ref
from test_sources import _raw

NAME = "input_name string, standardized_name string, lm_id string, formula string, exact_mass double, super_class string, main_class string, sub_class string, chebi_id string, kegg_id string, refmet_id string"


def test_fill_keeps_ids_and_says_who_found_them(spark):
    lipids = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "PE-x 1")], "row_idx long, input_name string")
    names = spark.createDataFrame([("A", "A1", "LM1", *[None] * 8), ("B", "B1", None, *[None] * 8)], NAME)
    done = annotate.standardise(lipids, names)
    keys = spark.createDataFrame([("B1", "sys_name", "LM2"), ("A1", "name", "LM9")], "key string, matched_field string, lm_id string")
    filled = annotate.fill_from_structures(done, keys)
    heads = annotate.fill_from_headgroups(filled, spark.createDataFrame([("PE-x", ["LM7", "LM8"]), ("C", [""])], "headgroup string, lm_ids array<string>"))
    got = {r.row_idx: (r.lm_id, r.lm_id_found_by, r.matched_field) for r in heads.collect()}
    assert got == {1: ("LM1", "RefMet", None), 2: ("LM2", "LMSD", "sys_name"), 3: (None, None, None), 4: ("LM7", "headgroup", None)}
    assert [r.row_idx for r in annotate.fill_report(filled).collect()] == [2]
    assert annotate.fill_from_structures(done, keys, use_standardized_name=False).where("was_filled").count() == 0


def _compound(kind, name, lm, generic=None):
    return (kind, name, lm, None, None, generic)


def _reactions(spark, rows):
    kind = f"array<{ref.COMPOUND}>"
    data = [(k, k + 100, f"r{k}", a, b) for k, (a, b) in enumerate(rows)]
    return spark.createDataFrame(data, f"reaction_ord long, reaction_id long, reaction_name string, reactants {kind}, products {kind}")


def test_reactions(spark):
    m = "lm_main"
    rows = [
        ([_compound(m, "A", "LM1")], [_compound(m, "B", "LM2"), _compound("x", "ATP", None)]),
        ([_compound("x", "y", None)], []),
        ([_compound(m, "", "LM2")], [_compound(m, None, None, "G3")]),
        ([_compound(m, "B", "LM2")], [_compound(m, "A", "LM1")]),
        ([_compound(m, "A", "LM1")], [_compound(m, "B", "LM2")]),
        ([_compound(m, None, None)], [_compound(m, "C", "LM3")]),
    ]
    r = _reactions(spark, rows)
    main = {x.reaction_ord: x.reaction_name for x in reactions.keep_main(r).collect()}
    assert main == {0: "A -> B", 2: "LM2 -> G3", 3: "B -> A", 4: "A -> B", 5: "Unknown -> C"}
    edges = {(x.src, x.dst): x.reaction_id for x in reactions.edges(reactions.keep_main(r)).collect()}
    assert edges == {("A", "B"): 104, ("LM2", "G3"): 102, ("B", "A"): 103, ("Unknown", "C"): 105}
    assert reactions.graph_size(reactions.edges(reactions.keep_main(r))).first() == (6, 4)
    ids = spark.createDataFrame([("LM1",), ("LM2",)], "lm_id string")
    assert sorted(x.reaction_ord for x in reactions.touching(r, ids).collect()) == [0, 2, 3, 4]
    assert sorted(x.reaction_ord for x in reactions.complete_reactions(r, spark.createDataFrame([("LM2",)], "lm_id string")).collect()) == [2]
    assert sorted(x.reaction_ord for x in reactions.complete_reactions(r, spark.createDataFrame([("LM2",)], "lm_id string"), complete=False).collect()) == [0, 2, 3, 4]
    lipids = spark.createDataFrame([(1, "a", "LM1"), (2, "b", "LM9"), (3, "c", None)], "row_idx long, input_name string, lm_id string")
    nested = {x.row_idx: x.reactions and [(y.reaction_ord, y.role) for y in x.reactions] if x.reactions is not None else None for x in reactions.nested_reactions(lipids, reactions.reaction_links(r, lipids)).collect()}
    assert nested == {1: [(0, "reactant"), (3, "product"), (4, "reactant")], 2: [], 3: None}


def test_links_of_a_hub_are_counted_and_dealt(spark, monkeypatch):
    c = lambda *k: [_compound("lm_main", None, f"LM{x}") for x in k]
    rows = [(c(k, 0), c(k + 1, 0)) for k in range(1, 12)] + [(c(50), c(0)), (c(0), c(51))]
    r = _reactions(spark, rows)
    made, used = [{x[2] for x in b} for _, b in rows], [{x[2] for x in a} for a, _ in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and made[i] & used[j]}
    for hub in (1000, 2):
        monkeypatch.setattr(reactions, "HUB", hub)
        assert {tuple(x) for x in reactions.next_reactions(r).collect()} == want
    counts = {x.lm_id: (x.producers, x.consumers, x.links) for x in reactions.compound_links(r).collect()}
    assert counts["LM0"] == (12, 12, 133) and counts["LM2"] == (1, 1, 1) and "LM50" not in counts


def test_details_of_links(spark):
    r = _reactions(spark, [([_compound("lm_main", "A", "LM1")], [])]).withColumn("enzyme_ids", F.array(F.lit("E1"))).withColumn("type", F.lit(""))
    ids = spark.createDataFrame([(1, "a", "LM1")], "row_idx long, input_name string, lm_id string")
    row = reactions.reaction_links(r, ids, details=True).first()
    assert (row.reaction_id, row.type, row.enzyme_ids, row.pathway_ids, row.role) == ("100", "species-level", ["E1"], None, "reactant")
    assert '"compound_name":"A"' in row.details
    assert reactions.nested_reactions(ids, reactions.reaction_links(r, ids)).first().reactions[0].enzyme_ids == ["E1"]


def test_chains_end_at_cycles(spark):
    c = lambda k: [_compound("lm_main", None, f"LM{k}")]
    r = _reactions(spark, [(c(1), c(2)), (c(2), c(3)), (c(3), c(1))])
    paths = {tuple(x.path) for x in reactions.chains(r, 5).collect()}
    assert paths == {(0, 1), (1, 2), (2, 0), (0, 1, 2), (1, 2, 0), (2, 0, 1)}


def test_validation_of_small_tables(spark):
    raw, cols = _raw(spark, ["lipid", "s1", "s2"], [["A", "1", "-2"], ["A", "x", ""], ["", "0", "0"], ["NA", "", ""]])
    issues, summary = validate.validate(raw, cols)
    found = sorted((r.check_id, r.severity) for r in issues.collect())
    assert found == [("V10", "error"), ("V11", "warning"), ("V13", "warning"), ("V14", "info"), ("V15", "info"), ("V16", "warning"), ("V8", "error"), ("V9", "warning"), ("V9", "warning")]
    row = summary.first()
    assert (row.total_rows, row.total_columns, row.sample_columns, row.completeness_percent, row.validation_passed) == (4, 3, 2, 62.5, False)
    assert export.report(issues, summary).first().issue_count == 9


def test_a_table_without_rows_is_only_told_so(spark):
    raw, cols = _raw(spark, ["lipid", "s1"], [])
    issues, summary = validate.validate(raw, cols)
    assert [(r.check_id, r.severity) for r in issues.collect()] == [("V1", "critical")]
    assert summary.first().completeness_percent == 0.0


def test_one_column(spark):
    raw, cols = _raw(spark, ["lipid"], [["A"], ["BCD"]])
    assert sorted(r.check_id for r in validate.validate(raw, cols)[0].collect()) == ["V14", "V16", "V2", "V6"]


def test_grouped_data_has_empty_maps(spark):
    q = spark.createDataFrame([("d", 1, "A", 0, "x1", 1.0), ("d", 2, "B", 1, "y1", 2.0)], "dataset_id string, row_idx long, input_name string, ordinal int, sample_id string, value double")
    s = spark.createDataFrame([("d", "x1", "x"), ("d", "y1", "y")], "dataset_id string, sample_id string, group string")
    got = {(r.group, r.row_idx): dict(r["values"]) for r in stats.grouped_data(q, s).collect()}
    assert got == {("x", 1): {"x1": 1.0}, ("y", 1): {}, ("x", 2): {}, ("y", 2): {"y1": 2.0}}


def test_wide_matrix_refuses_too_many(spark):
    import pytest

    q = spark.createDataFrame([("d", 1, "A", "x1", 1.0)], "dataset_id string, row_idx long, input_name string, sample_id string, value double")
    assert export.wide_matrix(q, ["x1", "x2"]).drop("dataset_id").collect() == [(1, "A", 1.0, None)]
    with pytest.raises(ValueError):
        export.wide_matrix(q, [str(k) for k in range(20_000)])


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([(1, "A", "LM1", None, None, None, 1.5)], "row_idx long, input_name string, lm_id string, standardized_name string, refmet_id string, formula string, mass double")
    export.write_annotations(a, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text == "sample,lm_id,standardized_name,refmet_id,formula,exact_mass\nA,LM1,,,,1.5\n"
    nulls = spark.createDataFrame([(1, "r", None, ["x"])], "reaction_id long, reaction_name string, reactants array<string>, products array<string>")
    assert export.reaction_rows(nulls).select(F.size("reactants"), F.size("products")).first() == (0, 1)
