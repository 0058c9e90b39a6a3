import json

import pytest

from pathloom import fixtures
from pathloom.cli import main
from pathloom.operators.documents import extract
from pathloom.sources.files import read_documents, write_results
from pathloom.streaming.queries import write_stream


def run(capsys, *args):
    code = main(list(args))
    return code, capsys.readouterr().out


def test_parse(capsys):
    code, out = run(capsys, "parse", "-j", "$.item.(next|side.next){*}.leaf")
    assert code == 0
    assert json.loads(out) == {"expression": "$.item.(next|side.next){*}.leaf", "parsed": "$.item(.next|.side.next){*}.leaf", "root": "$", "segment_count": 3, "segments": [".item", "(.next|.side.next){*}", ".leaf"]}
    assert main(["parse", "item"]) == 1


def test_test(capsys, tmp_path):
    code, out = run(capsys, "test", "-j", "-v", "$.person.lines[0].kind", fixtures.PERSON)
    result = json.loads(out)
    assert code == 0 and result["total_paths"] == 11 and result["matches"] == ["$.person.lines[0].kind"] and len(result["all_paths"]) == 11
    (tmp_path / "d.json").write_text('{"a": {"b": 1}}')
    assert run(capsys, "test", "-q", "$.a.zz", f"@{tmp_path}/d.json") == (1, "")
    assert run(capsys, "test", "$.a.b", "-f", f"{tmp_path}/d.json")[0] == 0
    assert run(capsys, "test", "-q", "--observed", "$.a.(x|y)", f"@{tmp_path}/d.json")[0] == 0


@pytest.mark.parametrize("text, valid", [(j, v) for j, v in fixtures.VALIDITY])
def test_validate(capsys, text, valid):
    assert main(["validate", "-q", text]) == (0 if valid else 1)


def test_extract(capsys, tmp_path):
    (tmp_path / "d.json").write_text('{"u": [{"n": 1.50}, {"n": "é"}]}')
    code, out = run(capsys, "extract", "-j", "-p", "-v", "--elementwise", "$.u.n", f"{tmp_path}/d.json")
    assert code == 0 and '1.50' in out
    assert json.loads(out)["values"] == [1.5, "é"] and json.loads(out)["paths"] == ["$.u[0].n", "$.u[1].n"]
    assert run(capsys, "extract", "$.zz", f"{tmp_path}/d.json")[0] == 1
    assert main(["extract", "$.zz", f"{tmp_path}/none.json"]) == 1


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"k": 1}\n\n{"k": 2}\nbroken\n')
    (folder / "b.json").write_text('{"k": 3}')
    lines = read_documents(spark, str(folder))
    assert lines.count() == 4
    whole = read_documents(spark, str(folder), "whole")
    assert whole.count() == 2
    found = extract(lines, "$.k", value="variant")
    for form in ("parquet", "json", "orc"):
        write_results(found.select("path", "value"), str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() == 3
    write_results(lines, str(tmp_path / "docs"))
    assert read_documents(spark, str(tmp_path / "docs"), "parquet").count() == 4
    with pytest.raises(ValueError):
        read_documents(spark, str(folder), "csv")


def test_a_stream_takes_each_document_once(spark, tmp_path):
    source = tmp_path / "source"
    docs = lambda a, b: spark.createDataFrame([(i, f'{{"k": {{"k": {i}}}}}') for i in range(a, b)], "doc_id long, json string")
    docs(0, 5).write.parquet(str(source))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for low, high in ((5, 9), (9, 9)):
        stream = spark.readStream.schema("doc_id long, json string").parquet(str(source))
        write_stream(extract(stream, "$.(k){*}"), out, state, once=True).awaitTermination()
        docs(low, high).write.mode("append").parquet(str(source))
    assert spark.read.parquet(out).count() == 3 * 9
