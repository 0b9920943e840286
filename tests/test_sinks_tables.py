import json

import pytest
from pyspark.sql import functions as F

from kairograph.functions import tables
from kairograph.operators import code, modules, render
from kairograph.sources import named, transcripts


def test_a_file_for_each_row(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a.md", "eins", "2"), ("A.md", "zwei", "1"), ("x/../y.md", "drei", "3"), (None, None, "4"), ("..", "punkte", "5"), ("plain", "sechs", "6"), ("é" * 200 + ".md", "lang", "7")]
    named.write(spark.createDataFrame(rows, "name string, value string, key string").repartition(3), path)
    got = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert got == {"A.md": "zwei", "a~2.md": "eins", "x_.._y.md": "drei", "x": "", "x..": "punkte", "plain": "sechs", "é" * 80 + ".md": "lang"}
    named.write(spark.createDataFrame([("plain", "neu", "1")], "name string, value string, key string"), path)
    assert (tmp_path / "out" / "plain").read_text() == "neu" and len(list((tmp_path / "out").iterdir())) == 7
    bad = spark.createDataFrame([("b.md", "1")], "name string, key string").withColumn("value", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        named.write(bad, path)
    assert len(list((tmp_path / "out").iterdir())) == 7


SOURCE = b"class Svc:\n    dep: Repo\n    def go(self):\n        publish(DoneEvent())\n"


def found(spark):
    return modules.modules(code.python_classes(spark.createDataFrame([("/a/svc.py", SOURCE), ("/b/svc.py", SOURCE), ("/c/other.py", SOURCE)], "path string, content binary")))


def test_modules_of_equal_name_keep_their_files(spark, tmp_path):
    modules.write_pages(modules.base(found(spark)), str(tmp_path / "md"))
    assert sorted(p.name for p in (tmp_path / "md").iterdir()) == ["other.md", "svc.md", "svc~2.md"]
    assert "/b/svc.py" in (tmp_path / "md" / "svc~2.md").read_text()
    modules.write_payloads(modules.base(found(spark)), str(tmp_path / "json"))
    assert json.loads((tmp_path / "json" / "svc.json").read_text())["module_name"] == "svc"


class Writer:
    def __call__(self, system, text):
        assert system == modules.SYSTEM and "def go" not in text and "DoneEvent" in text
        if "'other'" in text:
            raise ConnectionError("refused")
        return '```json\n{"description": "Fait.", "composants": ["File"], "risques": ["aucun test"]}\n```'


def test_generated_documents_fall_back(spark, tmp_path):
    got = {r["file_path"]: r for r in modules.generate(found(spark), Writer(), str(tmp_path), tasks=2).collect()}
    assert got["/a/svc.py"]["description"] == "Fait." and got["/a/svc.py"]["composants"] == ["File"] and got["/a/svc.py"]["flux"] == [] and got["/a/svc.py"]["error"] is None
    assert got["/c/other.py"]["description"] == "" and got["/c/other.py"]["classes"] == ["Svc"] and "refused" in got["/c/other.py"]["error"]
    page = modules.generate(found(spark), Writer(), str(tmp_path), tasks=2).where("file_path = '/b/svc.py'").select(modules.page().alias("p")).first()["p"]
    assert "Fait." in page and "- `File`" in page and "- aucun test" in page


TEXT = "[00:01] Ann Lee: oui\n\n  bonjour\n1:02:03.5 Bob: non"
VTT = "skip\nWEBVTT\n\nNOTE x\n1\n00:00:01.000 --> 00:00:02.000\nAnn: a\nb\n00:00:03.000 --> 00:00:04.000\n\n2\n00:00:05.000 --> 00:00:06.000\nfin"
PAGE = "# T\n\n| a | b |\n|---|---|\n| 1 | 2 |\ntext\n| c |\n\n- x\n---\n"


def test_table_functions_from_sql_agree_with_the_columns(spark):
    tables.register(spark)
    rows = spark.createDataFrame([("t", TEXT), ("n", None), ("e", "")], "file string, value string")
    rows.createOrReplaceTempView("said")
    got = spark.sql("SELECT file, s.* FROM said, LATERAL transcript_segments(value, 'text') s ORDER BY file, seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in transcripts.from_text(rows.fillna("")).orderBy("file", "seq").collect()] and len(got) == 3
    cues = spark.createDataFrame([("v", VTT)], "file string, value string")
    cues.createOrReplaceTempView("cues")
    got = spark.sql("SELECT s.ts, s.speaker, s.text FROM cues, LATERAL transcript_segments(value, 'vtt') s ORDER BY seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in transcripts.from_vtt(cues).orderBy("seq").select("ts", "speaker", "text").collect()] and len(got) == 2
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "id int, page string")
    pages.createOrReplaceTempView("pages_")
    got = spark.sql("SELECT id, b.* FROM pages_, LATERAL markdown_blocks(page) b ORDER BY pos").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in render.grouped_blocks(pages, "id", "page").select("id", "pos", "kind", "lines").orderBy("pos").collect()] and len(got) == 5
    xml = '<mxfile><diagram name="P"><mxGraphModel><root><mxCell id="a" vertex="1" value="Un"/></root></mxGraphModel></diagram></mxfile>'
    assert spark.sql(f"SELECT body FROM drawing_pages('{xml}')").first()[0].startswith("# Diagramme drawio : P\n\n## Éléments\n- Un")
    assert spark.sql("SELECT * FROM drawing_pages('<bad')").collect() == []


def test_table_functions_check_their_arguments(spark):
    tables.register(spark)
    for wrong, said in (("markdown_blocks(1)", "not a text"), ("transcript_segments('x', 'doc')", "neither text nor vtt"), ("drawing_pages(array('x'))", "not a text")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM {wrong}").collect()
