"""The command line, end to end on the smallest tables."""

import json
import os

import pytest

from tessella.__main__ import build_parser, main

SF = "/root/testdata/sf0.001"


def test_arguments():
    p = build_parser()
    assert p.parse_args(["flows", "d", "we:email_address", "x:y"]).terms == ["we:email_address", "x:y"]
    with pytest.raises(SystemExit):
        p.parse_args([])


def test_list(capsys):
    assert main(["list"]) == 0 and "s11_classify_documents" in capsys.readouterr().out


def test_commands(spark, tmp_path, capsys):
    assert main(["run", "e2_coverage", SF, str(tmp_path / "q")], spark) == 0 and spark.read.parquet(str(tmp_path / "q")).count() == 1
    assert main(["classify", SF, str(tmp_path / "c")], spark) == 0 and set(os.listdir(tmp_path / "c")) == {"documents", "targets", "summary"}
    assert main(["graph", SF, str(tmp_path / "g")], spark) == 0
    lines = [x for f in (tmp_path / "g").glob("*.json") for x in f.read_text().splitlines()]
    assert lines and {"graph_id", "json"} <= set(json.loads(lines[0]))
    capsys.readouterr()
    assert main(["ontology", SF, "email address"], spark) == 0 and "ancestor" in capsys.readouterr().out
    assert main(["flows", SF, "we:email_address"], spark) == 0 and "disclosure" in capsys.readouterr().out
