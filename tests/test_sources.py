import http.server
import io
import json
import subprocess
import threading
import urllib.parse
import zipfile

import pytest
from pyspark.sql import functions as F

from kairograph.functions import text as T
from kairograph.sources import binary, files, git, paged, records, transcripts

DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">%s</w:document>'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def documents(spark, schema, rows, make):
    return [r.asDict() for r in make(spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(x) for x in rows]))).collect()]


def test_ticket_bodies(spark):
    full = {"key": "SM-1", "fields": {
        "summary": "Panne", "description": "Texte", "status": {"name": "Open"}, "reporter": None, "assignee": {"displayName": "Ann"}, "created": "2024-01-02T03:04:05+00:00",
        "comment": {"comments": [{"author": {"displayName": "Bob"}, "body": "vu"}, {"body": "rien"}]},
        "issuelinks": [{"type": {"name": "Blocks"}, "outwardIssue": {"key": "SM-2"}}, {"inwardIssue": {"key": "SM-3"}}]},
        "changelog": {"histories": [{"created": "2024-02-01", "items": [{"field": "status", "fromString": "Open", "toString": "Done"}, {"field": "other"}]}]}}
    a, b = documents(spark, records.ISSUE, [full, {"key": "SM-9", "fields": {"summary": "x"}}], lambda df: records.tickets(df, "https://t"))
    assert a["body"] == "Texte\n\n=== Commentaires ===\n[Bob] vu\n\n[?] rien\n\n=== Historique statuts ===\n2024-02-01 : Open → Done\n\n=== Liens ===\nBlocks : SM-2\n? : SM-3"
    assert (a["title"], a["author"], a["url"]) == ("[SM-1] Panne", "Ann", "https://t/browse/SM-1")
    assert json.loads(a["meta"]) == {"key": "SM-1", "status": "Open", "assignee": "Ann", "nb_comments": 2, "nb_status_changes": 1, "nb_links": 2}
    assert (b["title"], b["body"], b["comments"], b["author"]) == ("[SM-9] x", "", 0, None)


def test_wiki_bodies(spark):
    page = {"id": "7", "body": {"storage": {"value": "<p>Bonjour</p>"}}, "version": {"number": 3}, "space": {"key": "S"}, "metadata": {"labels": {"results": [{"name": "a"}]}}}
    comments = spark.createDataFrame([("7", 2, None, "<b>deux</b>"), ("7", 1, "Ann", "un")], "id string, seq int, author string, value string")
    (a,) = documents(spark, records.PAGE, [page], lambda df: records.wiki_pages(df, comments, "https://w/"))
    assert (a["title"], a["body"]) == ("(sans titre)", "Bonjour\n\n=== Commentaires ===\n[Ann] un\n\n[?] deux")
    assert a["url"] == "https://w/wiki/spaces/S/pages/7" and json.loads(a["meta"]) == {"space_key": "S", "version_number": 3, "nb_comments": 2, "labels": ["a"]}


def test_cues_need_no_blank_line(spark):
    cue = "00:00:0{}.000 --> 00:00:09.000"
    text = "\n".join(["WEBVTT", cue.format(1), "Bob Roy: un", cue.format(2), "Ann: deux", "et trois", "", "12", cue.format(3), "NOTE x", "quatre", "", "stray", ""])
    rows = transcripts.from_vtt(spark.createDataFrame([("f", text), ("g", "no header\n" + cue.format(1) + "\nx"), ("h", "")], "file string, value string")).orderBy("seq").collect()
    assert [(r["ts"], r["speaker"], r["text"]) for r in rows] == [("00:00:01.000", "Bob Roy", "un"), ("00:00:02.000", "Ann", "deux et trois"), ("00:00:03.000", None, "quatre")]


def test_drawings():
    xml = (
        '<mxfile><diagram name="P"><mxGraphModel><root><mxCell id="0"/><mxCell id="a" vertex="1" value="&lt;b&gt;Un&lt;/b&gt;"/><object label="Deux"><mxCell id="b" vertex="1"/></object>'
        '<mxCell id="c" vertex="1"/><mxCell id="e" edge="1" source="a" target="b" value="lit"/><mxCell id="f" edge="1" source="a" target="gone"/><mxCell id="g" edge="1" source="a"/></root></mxGraphModel></diagram></mxfile>'
    )
    want = "# Diagramme drawio : {}\n\n## Éléments\n- Un\n- Deux\n- c\n\n## Connexions\n- Un --lit--> Deux\n- Un --> gone"
    assert binary.drawio(xml.encode())[0][:2] == ("P", want.format("P"))
    model = xml[xml.index("<mxGraphModel") : xml.index("</diagram>")]
    assert binary.drawio(model.encode())[0][:2] == ("page1", want.format("page1"))
    assert binary.drawio(b"<bad") == []


def test_broken_files_go_to_quarantine(spark):
    good = DOC % '<w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Titre</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body>'
    rows = [("file:/x/a.docx", archive({"word/document.xml": good})), ("b", archive({"word/document.xml": DOC % ""})), ("c", None), ("d", b"no zip"), ("e", archive({"other": ""}))]
    found = binary.parts(spark.createDataFrame(rows, "path string, content binary"), "docx").cache()
    (a,) = binary.documents(found, "docx").collect()
    assert (a["id_source"], a["title"], a["body"]) == ("/x/a.docx", "a", "## Titre\n\n| a\\|b |\n| --- |")
    assert {r["path"] for r in binary.broken(found).collect()} == {"c", "d", "e"}


def test_sheets_and_pages(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row><row><c r="B2"><v>3</v></c></row></sheetData></worksheet>'
    book = archive({
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Un" r:id="r1"/><sheet name="Vide" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>a|b</t></si></sst>", "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": f"<worksheet {ns}/>"})
    (a,) = binary.documents(binary.parts(spark.createDataFrame([("/d/t.xlsx", book)], "path string, content binary"), "xlsx"), "xlsx").collect()
    assert (a["id_source"], a["title"], a["body"]) == ("/d/t.xlsx#Un", "t — Un", "## Feuille : Un\n\n| a|b | 2 |\n| --- | --- |\n|  | 3 |")
    read = binary.pdf(lambda data: (["un", " \n", "trois"], {"author": "Ann", "creationDate": "D:20240102030405Z"}))
    a, b = binary.documents(binary.parts(spark.createDataFrame([("/d/t.pdf", b"x")], "path string, content binary"), "pdf", read), "pdf").orderBy("id_source").collect()
    assert (b["id_source"], b["title"], b["body"], b["author"], str(b["created_at"])) == ("/d/t.pdf#page3", "t — page 3", "[Page 3]\ntrois", "Ann", "2024-01-02 03:04:05")


def test_git(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    run("init", "-b", "main")
    (tmp_path / "f.txt").write_text("1")
    run("add", "f.txt")
    run("commit", "-m", "premier\n\nsuite")
    run("tag", "leger")
    run("tag", "-a", "v1", "-m", "annonce")
    for i in range(3):
        run("commit", "--allow-empty", "-m", f"c{i}")
    git.register(spark)
    log = git.commit_documents(spark.read.format("gitlog").option("pagesize", 2).load(str(tmp_path)), "p").collect()
    assert len(log) == 4
    (first,) = [r for r in log if r["title"] == "premier"]
    assert first["body"] == "Message : premier\n\nsuite\nAuteur : Ann <a@b.c>\nFichiers modifiés (1) :\n  - f.txt" and json.loads(first["meta"])["fichiers"] == ["f.txt"]
    refs = {r["id_source"]: r for r in git.ref_documents(spark.read.format("gitrefs").load(str(tmp_path)), "p").collect()}
    assert set(refs) == {"branch:main", "tag:leger", "tag:v1"}
    assert refs["tag:v1"]["body"].strip() == "Tag : v1\nMessage : annonce" and refs["tag:leger"]["body"] == "Tag : leger\nMessage : premier\n\nsuite"
    assert refs["branch:main"]["body"].startswith("Branche : main\nDernier commit : ") and refs["branch:main"]["body"].endswith(" — c2\nAuteur : Ann")
    assert spark.read.format("gitlog").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("total", [True, False])
def test_paged_services(spark, total):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            at, n = int(asked.get("startAt", asked.get("start", 0))), int(asked.get("maxResults", asked.get("limit", 0)))
            rows = [] if "child" in self.path else [{"key": f"K{i}", "id": str(i), "fields": {"summary": "s"}} for i in range(at, min(at + n, 120))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"issues": rows, "results": rows, **({"total": 120} if total else {})}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    found = paged.tickets(spark, url, "project=K")
    assert found.select("key").distinct().count() == found.count() == 120
    assert paged.tickets(spark, url, "project=K", limit=70).count() == 70
    assert files.read(spark, "confluence", url=url, space="S").count() == 120
    server.shutdown()
    with pytest.raises(Exception, match="ServiceError"):
        paged.pages(spark, "http://127.0.0.1:9", "S", wait="0.01").count()


def test_registry_and_scans(spark, tmp_path):
    for name, text in {"a.py": "class A: pass", "node_modules/b.py": "x", "d/c.java": "class C {}", "x.puml": "@startuml", "blank.mmd": " ", "m.txt": "[00:01] Ann Lee: oui\nnon"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["language"] for r in files.source_code(spark, str(tmp_path)).collect()} == {"python", "java"}
    (d,) = files.read(spark, "diagram", path=str(tmp_path)).collect()
    assert (d["title"], d["body"], json.loads(d["meta"])["format"]) == ("x", "@startuml", "plantuml")
    (m,) = files.read(spark, "meeting", path=str(tmp_path)).collect()
    assert m["body"] == "[00:01] Ann Lee: oui\nnon" and json.loads(m["meta"])["participants"] == ["Ann Lee"]
    for wrong in ({"source": "nothing"}, {"source": "git"}, {"source": "git", "path": "x", "more": "y"}):
        with pytest.raises(ValueError):
            files.read(spark, **wrong)


def test_html_by_parser(spark):
    rows = spark.createDataFrame([("<p>a &amp; b</p><!-- c --><i title='>'> d </i>",), (None,)], "h string")
    assert [r[0] for r in rows.select(T.html_text_exact(F.col("h"))).collect()] == ["a & b\nd", None]
    assert spark.sql("select unhex('c3a9c3') as b").select(T.first_bytes(F.col("b"), 3)).first()[0] == "é"
