import zlib

import pytest
from pyspark.sql import functions as F

from tessella import sql
from tessella.functions import pdf
from tessella.operators import labels, verdicts


def make_pdf(text_ops: bytes, deflate: bool) -> bytes:
    body = zlib.compress(text_ops) if deflate else text_ops
    filt = b"/Filter /FlateDecode " if deflate else b""
    return b"%PDF-1.4\n1 0 obj <<" + filt + b"/Length " + str(len(body)).encode() + b">>\nstream\n" + body + b"\nendstream endobj\n%%EOF"


OPS = b"BT /F1 12 Tf 72 700 Td (We share data \\(some\\) with) Tj 0 -14 Td (partners & friends.) Tj 0 -14 Td [(Sec)-20(ond)-300(line)] TJ T* <436166E9> Tj ET"


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(spark, deflate):
    data = make_pdf(OPS, deflate)
    assert pdf.pdf_text(data).split("\n") == ["We share data (some) with", "partners & friends.", "Second line", "Café"]
    df = spark.createDataFrame([(bytearray(data), "T<"), (None, "x"), (bytearray(b"%PDF-broken"), None), (bytearray(b"no"), "")], "d binary, t string")
    got = [r["h"] for r in df.select(pdf.pdf_to_html(F.col("d"), F.col("t")).alias("h")).collect()]
    assert "<title>T&lt;</title>" in got[0] and "<p>We share data (some) with partners &amp; friends.</p>" in got[0] and got[1:] == ["", "", ""]


def test_verdicts(spark):
    d = spark.createDataFrame([("a", ["we share with vendors", "x"]), (" a ", ["dup"]), ("b", ["nothing"]), ("c", []), (None, None)], "text string, segments array<string>")
    v = {r["text_hash"]: r["main_third"] for r in verdicts.document_verdicts(d.limit(1).unionByName(d.where("text = 'b'"))).collect()}
    assert sorted(v.values()) == [0, 1]
    known = spark.createDataFrame([(h,) for h in v], "text_hash string")
    assert verdicts.document_verdicts(d.where("text = 'b'"), known).count() == 0


def test_manual_docs(spark):
    s = spark.createDataFrame([("t", "d1", "u1", "manual", ""), ("t", "d2", "u2", "x", "0")], "target_id string, doc_id string, url string, role string, gold_relevant string")
    up = spark.createDataFrame([("t", "d1", "0", 1), ("t", "d1", "1", 2), ("t", "d2", None, 1), ("z", "d9", "1", 1)], "target_id string, doc_id string, gold_relevant string, _ord int")
    assert {r["doc_id"]: r["gold_relevant"] for r in labels.save_cells(s, up, ["target_id", "doc_id"], ["gold_relevant"]).collect()} == {"d1": "1", "d2": "0"}
    assert [r["doc_id"] for r in labels.remove_manual_doc(s, "t", "d1").collect()] == ["d2"] and labels.remove_manual_doc(s, "t", "d2").count() == 2
    m = s.select("target_id", "doc_id", "url", "role")
    assert labels.add_manual_doc(m, m.limit(1).withColumn("url", F.lit("u3"))).count() == 3
    with pytest.raises(Exception, match="duplicate address"):
        labels.add_manual_doc(m, m.limit(1)).collect()


def test_sql_surface(spark):
    made = sql.register(spark, "/root/testdata/sf0.001")
    assert {"docs", "clean_docs", "relations"} <= set(made)
    assert spark.sql("SELECT slug('  A & B ') s, has_category('our vendors') c, has_generic('none') g, registry_kind('a.com, 1, DIRECT') k").first() == ("a-b", True, False, "ads_txt")
    assert spark.sql("SELECT count(*) FROM clean_docs WHERE ok").first()[0] > 0
    sql.view_of_query(spark, "/root/testdata/sf0.001", "e5_latency")
    assert spark.table("e5_latency").count() > 0
