"""Command line: ``python -m tessella COMMAND ...``.

list                       names of all registered queries
run QUERY DIR OUT          run one over a folder of tables and write its rows as Parquet
classify DIR OUT           documents and targets of a collection, as CSV and JSON
report DIR                 scores and counts, printed
graph DIR OUT              knowledge graphs of all pages, as JSON lines
contradictions DIR         contradictions of the stored graphs, printed
terms DIR                  terms used against the ontology, printed
flows DIR ENTITY:DATA ...  whether flows agree with what the graphs say, printed
ontology DIR TERM ...      ancestors and descendants of terms, printed
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph, typology
from tessella.operators.scratch import release
from tessella.plans import links, scalars, sheets
from tessella.plans import queries as core
from tessella.plans.ship import ship
from tessella.sources import corpus

#: Queries that make up a report.
REPORT = ("e1_relevance", "e2_coverage", "e3_agreement", "e6_naming_rate", "e7_policy_identification", "e8_list_identification", "e10_ontology_accommodation", "e13_grouped_report", "c33_collection_report")


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description="Disclosure analytics on Spark")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("list", help="names of all registered queries")
    for name, more in (("run", ("query", "dir", "out")), ("classify", ("dir", "out")), ("report", ("dir",)), ("graph", ("dir", "out")), ("contradictions", ("dir",)), ("terms", ("dir",)), ("flows", ("dir",)), ("ontology", ("dir",))):
        s = c.add_parser(name)
        for m in more:
            s.add_argument(m)
        if name in ("flows", "ontology"):
            s.add_argument("terms", nargs="+")
    return p


def _show(df: DataFrame) -> None:
    """Prints a report of a few rows, or the first hundred of a long one."""
    df.show(100, truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = build_parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(core.QUERIES)))
        return 0
    own = spark is None
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    ship(spark)
    t = core.Tables(spark, a.dir)
    if a.command == "run":
        core.QUERIES[a.query](spark, a.dir).write.mode("overwrite").parquet(a.out)
    elif a.command == "classify":
        c = core.materialize(typology.classify_documents(core._documents_to_classify(t), t.gazetteer_(), core._verdicts(t)), "classified")
        corpus.write_results(c, typology.assemble_targets(c), a.out)
    elif a.command == "report":
        for name in REPORT:
            print(name)
            _show(core.QUERIES[name](spark, a.dir))
    elif a.command == "graph":
        s = core.annotate.document_sentences(t.parsed_docs.select("doc_id", "raw"))
        graph.graph_json(*core.annotate.build_graphs(s, tuple(n for n, _ in t.gazetteer_().types))).write.mode("overwrite").json(a.out)
    elif a.command == "contradictions":
        _show(links.a9_contradiction_report(spark, a.dir))
    elif a.command == "terms":
        _show(links.a7_check_terms(spark, a.dir))
    elif a.command == "flows":
        e = core.materialize(core._graph(t), "edges")
        reach, up = links._subsumed(t, e)
        asked = spark.createDataFrame([(x,) for x in a.terms], "spec string").select(graph.parse_flows(F.col("spec")).alias("f"))
        flows = e.select("graph_id").distinct().crossJoin(F.broadcast(asked)).select("graph_id", "f.entity", "f.data_type")  # as many rows as arguments, for each graph
        _show(graph.classify_flows(flows, links._ends(e), e, reach, up))
    else:
        up = graph.closure(links._low(t), src="hypernym", dst="hyponym")
        names = [x.lower() for x in a.terms]
        _show(up.where(F.col("ancestor").isin(names) | F.col("descendant").isin(names)).orderBy("ancestor", "descendant"))
    if own:
        release(spark)  # everything is written or printed
    return 0


assert scalars and sheets  # they register their queries

if __name__ == "__main__":
    sys.exit(main())
