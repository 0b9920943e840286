"""A service that fails, caps its pages, has comments and changes while it is read."""

import http.server
import json
import re
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kairograph.sources import files, paged, records


class Service(http.server.ThreadingHTTPServer):
    def __init__(self):
        self.rows = [self.row(i, f"2024-01-{1 + i % 28:02d}T10:{i % 60:02d}:00.000+0100") for i in range(137)]
        self.cap, self.total, self.down, self.seen, self.lock = 20, True, {}, Counter(), threading.Lock()
        self.comments = {"3": [{"author": {"displayName": "Ann"}, "body": {"view": {"value": "<p>oui &amp; non</p>"}}}] * 23 + [{"body": {"storage": {"value": "fin"}}}]}
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                outer.serve(self)

            def log_message(self, *args):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server_port}"
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @staticmethod
    def row(i, when):
        return {"key": f"K{i}", "id": str(i), "title": f"P{i}", "fields": {"summary": f"s{i}", "updated": when}, "version": {"number": 1, "when": when}, "body": {"storage": {"value": f"<p>a &lt; {i}</p>"}}}

    def serve(self, request):
        parsed = urllib.parse.urlparse(request.path)
        asked = dict(urllib.parse.parse_qsl(parsed.query))
        at, n = int(asked.get("startAt", asked.get("start", 0))), min(self.cap, int(asked.get("maxResults", asked.get("limit", 0))))
        with self.lock:
            self.seen[at] += 1
            code = self.down.get(at, [])
            if code:
                request.send_response(code.pop(0))
                request.end_headers()
                return
        rows, said = self.rows, asked.get("jql", asked.get("cql", ""))
        if found := re.search(r"content/(\w+)/child", parsed.path):
            rows = self.comments.get(found[1], [])
        when = lambda r: r["fields"]["updated"][:16].replace("T", " ")
        for op, bound in re.findall(r'(?:updated|lastmodified) ([<>]=) "([^"]*)"', said):
            rows = [r for r in rows if (when(r) >= bound if op == ">=" else when(r) <= bound)]
        if "DESC" in said:
            rows = sorted(rows, key=lambda r: paged._time(r["fields"]["updated"]), reverse=True)
        part = rows[at : at + n]
        request.send_response(200)
        request.end_headers()
        request.wfile.write(json.dumps({"issues": part, "results": part, **({"total": len(rows)} if self.total else {})}).encode())


@pytest.fixture
def service():
    server = Service()
    yield server
    server.shutdown()


@pytest.mark.parametrize("total", [True, False])
def test_capped_pages_and_passing_failures_lose_nothing(spark, service, total):
    service.total, service.down = total, {40: [500, 503], 60: [429], 100: [502]}
    for read in (lambda **m: paged.tickets(spark, service.url, "project=K", wait="0.01", **m), lambda **m: paged.pages(spark, service.url, "S", wait="0.01", **m)):
        rows = [r[0] for r in read().select(F.coalesce(*[c for c in ("key", "title") if c in read().columns])).collect()]
        assert sorted(x[1:] for x in rows) == sorted(str(i) for i in range(137))
        assert read(limit=30).count() == 30


def test_failures_that_last_are_errors_and_not_gaps(spark, service):
    service.down = {50: [500] * 99}
    with pytest.raises(Exception, match="ServiceError"):
        paged.tickets(spark, service.url, "project=K", wait="0.01").count()
    service.down = {0: [403] * 99}
    before = service.seen[0]
    with pytest.raises(Exception, match="403"):
        paged.tickets(spark, service.url, "project=K", wait="5").count()
    assert service.seen[0] - before <= 2  # a refusal isn't tried again


def test_pages_have_their_comments_and_entities(spark, service):
    rows = {r["id_source"]: r["body"] for r in files.read(spark, "confluence", url=service.url, space="S").collect()}
    assert len(rows) == 137 and rows["5"] == "a < 5"
    assert rows["3"].startswith("a < 3\n\n=== Commentaires ===\n[Ann] oui & non\n\n[Ann]") and rows["3"].endswith("[?] fin") and rows["3"].count("[Ann]") == 23


@pytest.mark.parametrize("kind", ["tickets", "pages"])
def test_a_stream_goes_on_where_it_stopped(spark, service, tmp_path, kind):
    def run():
        read = paged.changed_tickets(spark, service.url, "project=K", wait="0.01") if kind == "tickets" else paged.changed_pages(spark, service.url, "S", wait="0.01")
        rows = read.select(F.col("fields.updated").alias("u"), "key") if kind == "tickets" else read.select(F.col("version.when").alias("u"), F.concat(F.lit("K"), "id").alias("key"))
        return rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    def got():
        return sorted((r["key"], r["u"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def want(rows):
        return sorted((r["key"], r["fields"]["updated"]) for r in rows)

    run().awaitTermination()
    first = list(service.rows)
    assert got() == want(first)
    service.rows[5] = Service.row(5, "2024-02-01T00:00:30.000+0100")
    service.rows.append(Service.row(900, "2024-02-01T00:00:10.000+0000"))
    service.down = {0: [200] * 0, 20: [500] * 99}
    service.rows += [Service.row(1000 + i, "2024-02-01T00:00:20.000+0000") for i in range(40)]
    query = run()
    with pytest.raises(Exception, match="ServiceError"):
        query.awaitTermination()
    assert got() == want(first)  # stopped midway: nothing of it
    service.down = {}
    run().awaitTermination()
    late = [r for r in service.rows if r["fields"]["updated"] > "2024-02"]
    assert len(late) == 42 and got() == want(first + late)
    run().awaitTermination()
    assert got() == want(first + late)


def test_a_folder_by_suffix(spark, tmp_path):
    (tmp_path / "a.puml").write_text("@startuml")
    (tmp_path / "b.MD").write_text("# Note")
    (tmp_path / "c.txt").write_text("[00:01] Ann Lee: oui")
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.zip").write_bytes(b"?")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.drawio").write_text('<mxfile><diagram name="P"><mxGraphModel><root><mxCell id="a" vertex="1" value="Un"/></root></mxGraphModel></diagram></mxfile>')
    (tmp_path / "h.mmd").write_text(" ")
    documents, broken = files.folder(spark, str(tmp_path))
    rows = documents.orderBy("path").collect()
    assert [(r["source_type"], r["title"]) for r in rows] == [("diagram", "a"), ("obsidian", "b"), ("meeting", "c"), ("diagram", "g — P")]
    assert {r["path"].rpartition("/")[2]: r["reason"] for r in broken.collect()}.keys() == {"d.docx", "e.zip", "f.pdf"}
    with_pdf, left = files.folder(spark, str(tmp_path), pdf=files.binary.pdf(lambda data: (["texte"], {})))
    assert with_pdf.where("source_type = 'pdf'").count() == 1 and left.count() == 2
    assert files.quarantined(spark, "folder", str(tmp_path)).count() == 3 and files.quarantined(spark, "docx", str(tmp_path)).count() == 1
    assert records.route(spark.createDataFrame([("x.Md",)], "path string")).first()["reader"] == "obsidian"
