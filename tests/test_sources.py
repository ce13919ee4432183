"""CSV, JSON, Python values, and the command line."""

import json as pyjson

import pytest

from loomframe import cli, errors
from loomframe.sources import csv, frames, json


def test_csv_types_come_from_all_values(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('i,x,b,s,n,q\n1,1.5,true,a,NA,"x,y"\n-2,2,FALSE, 7,-,"say ""hi"""\nNULL,nan,None,1d,,z\n')
    df = csv.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"i": "bigint", "x": "double", "b": "boolean", "s": "string", "n": "string", "q": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "a", None, "x,y"), (-2, 2.0, False, " 7", None, 'say "hi"'), (None, None, None, "1d", None, "z")]


def test_csv_options(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("1;a\n2;b\n")
    df = csv.read_csv(spark, str(p), delimiter=";", header=False, dtypes={"col_0": "double"})
    assert df.dtypes == [("col_0", "double"), ("col_1", "string")] and df.count() == 2
    p.write_text("a,a\n1,2\n")
    with pytest.raises(errors.DuplicateColumn):
        csv.read_csv(spark, str(p))
    p.write_text("a,b\n")
    empty = csv.read_csv(spark, str(p))
    assert empty.dtypes == [("a", "string"), ("b", "string")] and empty.count() == 0
    p.write_text("a\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv.read_csv(spark, str(p), dtypes={"a": "long"}).collect()
    with pytest.raises(errors.ColumnNotFound):
        csv.read_csv_column(spark, str(p), "b")


def test_csv_round_trip(spark, tmp_path, make):
    df = make(k=[1, 2, None], s=["a,b", 'c"d', None], x=[0.5, None, 2.0])
    csv.write_csv(df, str(tmp_path / "o"), delimiter="|", na_value="NA", single=True)
    back = csv.read_csv(spark, str(tmp_path / "o"), delimiter="|")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("orient,lines", [("records", False), ("columns", False), ("records", True)])
def test_json_round_trip_keeps_nulls(spark, tmp_path, make, orient, lines):
    df = make(k=[1, 2, 3], s=["a", None, "c"])
    json.write_json(df, str(tmp_path / "o"), orient, lines)
    text = "".join(f.read_text() for f in (tmp_path / "o").glob("part*"))
    assert "null" in text
    back = json.read_json(spark, str(tmp_path / "o"), orient, lines).select("k", "s")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_json_checks(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(pyjson.dumps({"a": [1, 2], "b": [1]}))
    with pytest.raises(errors.InvalidShape):
        json.read_json(spark, str(p), "columns")
    p.write_text(pyjson.dumps([{"a": 1}, {"b": "x"}]))
    df = json.read_json(spark, str(p), numbers_as_double=True)
    assert dict(df.dtypes) == {"a": "double", "b": "string"} and df.count() == 2
    with pytest.raises(errors.InvalidArgument):
        json.read_json(spark, str(p), "table")


def test_python_values(spark):
    df = frames.from_columns(spark, {"a": [1, None], "b": [True, False], "c": [1, 2.5], "d": [None, None]})
    assert [t for _, t in df.dtypes] == ["bigint", "boolean", "double", "string"]
    with pytest.raises(errors.InvalidShape):
        frames.from_columns(spark, {"a": [1], "b": []})
    assert frames.series(spark, "s", [1, 2], [False, True]).collect()[1][0] is None


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "a.csv"
    p.write_text("k,v\n1,a\n2,b\n3,a\n")
    cli.main(["info", str(p)])
    assert "rows\t3" in capsys.readouterr().out
    cli.main(["tail", str(p), "-n", "1"])
    assert capsys.readouterr().out == "k\tv\n3\ta\n"
    cli.main(["filter", str(p), "-c", "v", "-v", "a"])
    assert capsys.readouterr().out == "k\tv\n1\ta\n3\ta\n"
    cli.main(["convert", str(p), str(tmp_path / "o.jsonl")])
    assert spark.read.json(str(tmp_path / "o.jsonl")).count() == 3
    cli.main(["describe", str(p)])
    assert "column\tcount" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["select", str(p), "-c", "nope"])
