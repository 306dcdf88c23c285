"""Plans: what reaches the scan, and that nothing is crossed or broadcast unchecked."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name,columns", [
    ("l10_machine_readable_kind", {"doc_id", "text"}), ("l0_lexicon_hits", {"doc_id", "segments"}), ("b6_data_type_clauses", None), ("e5_latency", {"event_type", "value"}),
])
def test_scans_read_only_what_they_need(spark, name, columns):
    p = plan(entry.queries()[name](spark, SF))
    schemas = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", p)]
    assert schemas and (columns is None or all(s <= columns for s in schemas))


@pytest.mark.parametrize("name", ["r14_merge_relations", "q3_graph_edges", "s12_assemble_targets", "c22_first_per_content", "u7_graph_model"])
def test_no_cross_joins(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_are_pushed(spark):
    p = plan(entry.queries()["l10_machine_readable_kind"](spark, SF))
    assert "IsNotNull(text)" in p


def test_names_and_oracles():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 79
    assert {f"p{i}_found" for i in (3,)} <= set(q)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
