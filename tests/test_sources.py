"""Sources, sinks, streams and the command line."""

import io
import json
import zipfile
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from proofweave.jobs import run
from proofweave.sinks import files
from proofweave.sources import docx, jsonfiles, markdown
from proofweave.streaming import jobs
from tests.conftest import rows

DOC = """---
doc_id: "D 1"
title: Witness Statement
date: 'x'
---
# Title line
First line
goes on.

<!-- page 2 -->
12. Second paragraph
# not a break
with a tail

WITNESS STATEMENT OF someone
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text(DOC)
    (tmp_path / "README.md").write_text("skip me")
    (tmp_path / "02_b.md").write_text("plain text\n---\nnot front matter")
    (tmp_path / "open.md").write_text("---\nk: v: w\nno body")
    docs, paras = markdown.parse(markdown.read_lines(spark, str(tmp_path)))
    meta = {r["doc_id"]: r["meta"] for r in docs.collect()}
    assert meta == {"D 1": {"doc_id": "D 1", "title": "Witness Statement", "date": "x"}, "02_b": {}, "open": {"k": "v: w"}}
    assert rows(paras.where("doc_id = 'D 1'"), "pos", "page", "label", "text") == [(0, 1, "", "First line goes on."), (1, 2, "12.", "12. Second paragraph with a tail"), (2, 2, "", "WITNESS STATEMENT OF someone")]
    assert rows(paras.where("doc_id = '02_b'"), "text") == [("plain text --- not front matter",)]
    assert dict(rows(markdown.kinds(docs, paras, pleadings="02*.md"))) == {"D 1": "witness_statement", "02_b": "pleading", "open": "other"}
    assert markdown.prompts(paras).where("doc_id = 'D 1'").first()["text"].count("[page ") == 2


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr><w:tr>{cell('d')}</w:tr><w:tr>{cell('')}</w:tr></w:tbl></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "03_Some_name.docx").write_bytes(raw.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"x")
    got = {r["doc_id"]: r for r in docx.read(spark, str(tmp_path)).collect()}
    assert got["03_Some_name"]["text"] == "One two\n\n| a | b\\|c |\n| --- | --- |\n| d |  |"
    assert got["03_Some_name"]["title"] == "Some name" and got["bad"]["error"] == "BadZipFile"
    assert rows(files.manifest(docx.read(spark, str(tmp_path))), "status", "n") == [("failed", 1), ("ok", 1)]
    assert rows(files.manifest(docx.read(spark, str(tmp_path)).withColumn("p", F.lit(2)), "p")) == [("failed", 1, 2), ("ok", 1, 2)]


def test_docx_spans_and_containers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    inner = f"<w:tc><w:tbl><w:tr>{cell('x')}{cell('y')}</w:tr></w:tbl><w:p/></w:tc>"
    top = f"<w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('c', '<w:vMerge w:val=\"restart\"/>')}</w:tr>"
    xml = f"<w:document {w}><w:body><w:sdt><w:sdtContent><w:p><w:r><w:t>In a control</w:t></w:r></w:p></w:sdtContent></w:sdt><w:tbl>{top}<w:tr>{cell('a')}{inner}{cell('again', '<w:vMerge/>')}</w:tr></w:tbl></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx.body_text(raw.getvalue()) == "In a control\n\n| wide |  | c |\n| --- | --- | --- |\n| a | x y |  |"


def test_json(spark, tmp_path):
    matrix = [{"proposition": {"id": "P1", "text": "t", "source": {"doc_id": "D"}}, "links": [{"evidence_id": "E1", "relation": "supportive", "confidence": 0.7}]}, {"proposition": {"text": "no id"}, "links": []}]
    (tmp_path / "m.json").write_text(json.dumps(matrix))
    props, links = jsonfiles.read_matrix(spark, str(tmp_path / "m.json"))
    assert rows(props, "prop_id", "quote_ok", "doc_id") == [("P1", True, "D")]
    assert rows(links, "prop_id", "evidence_id", "confidence", "witness") == [("P1", "E1", 0.7, "")]
    (tmp_path / "d.json").write_text(json.dumps({"dependencies": [{"from": "P1", "to": "P2", "rationale": "r"}]}))
    assert rows(jsonfiles.read_dependencies(spark, str(tmp_path / "d.json")), "dep_id", "from_id", "to_id") == [(0, "P1", "P2")]
    claims = spark.createDataFrame([("a", '{"citations": [{"source_id": "1", "quote": "q"}, {"source": "2", "text": "r"}]}'), ("b", '{"source": "3", "quote": "s"}'), ("c", "{}"), ("d", None)], "id string, payload string")
    assert rows(jsonfiles.citations(claims)) == [("a", "1", "q"), ("a", "2", "r"), ("b", "3", "s")]


def test_sinks(spark, tmp_path):
    rows_ = spark.createDataFrame([("k1", 'a "q"\nb', 1)], "id string, text string, v long")
    files.write_csv(rows_, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert rows(back) == [("k1", 'a "q"\nb', "1")]
    files.write_json(rows_, str(tmp_path / "json"))
    assert rows(spark.read.json(str(tmp_path / "json")), "id", "v") == [("k1", 1)]
    for _ in range(2):
        got = files.upsert(spark, str(tmp_path / "up"), spark.createDataFrame([("k1", 2), ("k2", 1)], "id string, v long"), ["id"], "v")
    got = files.upsert(spark, str(tmp_path / "up"), spark.createDataFrame([("k1", 1), ("k2", 5)], "id string, v long"), ["id"], "v")
    assert rows(got) == [("k1", 2), ("k2", 5)]
    (tmp_path / "up").rename(tmp_path / "up.next")  # a merge lost between its moves
    got = files.upsert(spark, str(tmp_path / "up"), spark.createDataFrame([("k3", 1)], "id string, v long"), ["id"], "v")
    assert rows(got) == [("k1", 2), ("k2", 5), ("k3", 1)]


def test_report(spark, data, tmp_path):
    from proofweave.operators import matrix as M
    from proofweave.sources import views as V

    nested = M.nested(V.propositions(spark, data), V.matrix_links(spark, data))
    files.write_report(nested, str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.count("### ") == nested.count()
    assert max(text.find("— MISSING"), 0) <= text.find("— supported")


def test_streams(spark, tmp_path):
    schema = "kind string, key string, refs long, existing long"
    spark.createDataFrame([("evidence", "E1", 1, 0), ("evidence", "E2", 1, 1)], schema).write.parquet(str(tmp_path / "in" / "a"))
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.merge_reference_counts(source(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert rows(jobs.current_orphans(spark, str(tmp_path / "state")), "key") == [("E1",)]
    spark.createDataFrame([("evidence", "E1", 0, 1)], schema).write.parquet(str(tmp_path / "in" / "b"))
    jobs.merge_reference_counts(source(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert jobs.current_orphans(spark, str(tmp_path / "state")).count() == 0
    jobs.compact_reference_counts(spark, str(tmp_path / "state"), str(tmp_path / "small"))
    assert rows(jobs.reference_counts(spark, str(tmp_path / "small"))) == rows(jobs.reference_counts(spark, str(tmp_path / "state")))


def test_additions_stream_as_batch(spark, tmp_path):
    schema = "prop_id string, evidence_id string, relation string, confidence double, ts timestamp"
    batch = [("P1", "E1", "adverse", 0.7, dt(2024, 1, 1)), ("P1", "E1", "supportive", 0.9, dt(2024, 1, 2))]
    spark.createDataFrame(batch, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.merge_additions(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "table")), "relation") == [("supportive",)]


def test_event_windows_stream_as_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("windows"), "event_type", "n") == rows(jobs.event_windows(events), "event_type", "n")


def test_command_line(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "build_session", lambda master: spark)
    for kind in ("csv", "json", "parquet"):
        assert run.main(["status_counts", "--data", data, "--out", str(tmp_path / kind), "--format", kind]) == 0
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 4
    with pytest.raises(SystemExit):
        run.main(["no_such_query", "--data", data, "--out", "x"])
