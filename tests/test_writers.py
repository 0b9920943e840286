import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from kairograph.operators import code, deltas, graph, modules, render, retrieval, writer
from kairograph.schemas import EXTRACTION
from kairograph.streaming import ingest


def extraction(spark, entities, relations, ref="r"):
    return spark.createDataFrame([(ref, [(k, t, n, None, None) for k, t, n in entities], [(a, b, "lie", "fait", None, None) for a, b in relations])], EXTRACTION)


def test_graph_write(spark, tmp_path):
    root = str(tmp_path)
    first = extraction(spark, [("a", "Person", "A"), ("b", "Ticket", "B"), ("b", "Person", "B2")], [("a", "b"), ("a", "gone")])
    numbers = lambda *args, **more: tuple(writer.write_graph(*args, **more).first())
    assert numbers(first, root, dry_run=True) == (3, 0, 1, 1) and not list(tmp_path.iterdir())
    assert numbers(first, root) == (3, 0, 1, 1)
    edges = writer.edges(spark, root).collect()
    last = spark.range(1).select(graph.node_uuid(F.lit(writer.GROUP), F.lit("Person"), F.lit("b"))).first()[0]
    assert [e["target_uuid"] for e in edges] == [last]  # of entities with a key the last counts
    assert numbers(first, root) == (0, 3, 1, 1)
    assert numbers(extraction(spark, [("a", "Person", "new name"), ("c", "Person", "C")], []), root) == (1, 1, 0, 0)
    nodes = {r["key"] + r["type"]: r["name"] for r in writer.nodes(spark, root).collect()}
    assert nodes == {"aPerson": "new name", "bTicket": "B", "bPerson": "B2", "cPerson": "C"}
    assert numbers(first, root, "other") == (3, 0, 1, 1)
    assert writer.edges(spark, root).count() == 1
    before = sorted(map(str, writer.nodes(spark, root).collect())), sorted(map(str, writer.edges(spark, root).collect()))
    assert writer.compact_graph(spark, root) == 4 and writer.compact_graph(spark, root) is None
    deltas.vacuum(spark, f"{root}/graph/group_id={writer.GROUP}")
    assert (sorted(map(str, writer.nodes(spark, root).collect())), sorted(map(str, writer.edges(spark, root).collect()))) == before
    assert len(list((tmp_path / "graph" / f"group_id={writer.GROUP}" / "nodes").iterdir())) == 1
    assert numbers(extraction(spark, [("a", "Person", "newest")], []), root) == (0, 1, 0, 0)
    assert {r["name"] for r in writer.nodes(spark, root).where("key = 'a'").collect()} == {"newest"}


ROWS = "uuid string, name string"


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    root = str(tmp_path)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    deltas.write(root, {"nodes": spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("uuid"), F.lit("x").alias("name"))})
    large = size()
    deltas.write(root, {"nodes": spark.createDataFrame([("one", "new")], ROWS)})
    assert size() - large < large / 100 and deltas.read(spark, root, "nodes", ROWS).count() == 50_001


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    put = lambda i: deltas.write(root, {"nodes": spark.createDataFrame([(f"own{i}", str(i)), ("same", str(i))], ROWS), "edges": spark.createDataFrame([(f"e{i}", "x")], ROWS)})
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(put, range(8)))
    assert sorted(numbers) == list(range(1, 9))
    got = {r["uuid"]: r["name"] for r in deltas.read(spark, root, "nodes", ROWS).collect()}
    assert got == {**{f"own{i}": str(i) for i in range(8)}, "same": str(numbers.index(8))}
    assert deltas.read(spark, root, "edges", ROWS).count() == 8


def test_compaction_keeps_later_deltas_and_gives_way_to_another(spark, tmp_path, monkeypatch):
    root, schemas = str(tmp_path), {"nodes": ROWS}
    put = lambda *rows: deltas.write(root, {"nodes": spark.createDataFrame(list(rows), ROWS)})
    got = lambda: {r["uuid"]: r["name"] for r in deltas.read(spark, root, "nodes", ROWS).collect()}
    put(("a", "1"), ("b", "1"))
    put(("a", "2"))
    read = deltas.read

    def late(*args, **more):
        monkeypatch.setattr(deltas, "read", read)
        state = read(*args, **more)
        put(("b", "late"), ("c", "late"))  # after the compaction has chosen what to read
        return state

    monkeypatch.setattr(deltas, "read", late)
    assert deltas.compact(spark, root, schemas) == 4
    assert got() == {"a": "2", "b": "late", "c": "late"}
    put(("d", "5"))

    def other(*args, **more):
        monkeypatch.setattr(deltas, "read", read)
        state = read(*args, **more)
        deltas.compact(spark, root, schemas)
        return state

    monkeypatch.setattr(deltas, "read", other)
    with pytest.raises(deltas.Conflict):
        deltas.compact(spark, root, schemas)
    assert got() == {"a": "2", "b": "late", "c": "late", "d": "5"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("uuid"), F.lit("x").alias("name"))
    with pytest.raises(Exception, match="no"):
        deltas.write(root, {"nodes": spark.createDataFrame([("a", "1")], ROWS), "edges": bad})
    assert deltas.read(spark, root, "nodes", ROWS).count() == 0 and not list(tmp_path.rglob("*.parquet"))


def test_edges_that_differ_in_nulls_or_dates_are_apart(spark):
    rows = [("a", "b", None, "x", None), ("a", "b", "x", None, None), ("a", "b", "x|y", None, None), ("a", "b", "x", "y", None), ("a", "b", "x", "y", "2024-01-01")]
    relations = [(s, t, n, f, v, None) for s, t, n, f, v in rows]
    one = spark.createDataFrame([("r", [("a", "Person", "A", None, None), ("b", "Person", "B", None, None)], relations)], EXTRACTION.replace("timestamp", "string"))
    one = one.withColumn("relations", F.col("relations").cast("array<struct<source_key: string, target_key: string, name: string, fact: string, valid_at: timestamp, invalid_at: timestamp>>"))
    edges, dropped = writer.edges_of(one, writer.nodes_of(one))
    assert edges.select("uuid").distinct().count() == 5 and dropped.count() == 0


DOCS = "id_source string, source_type string, title string, body string, url string, modified_at timestamp, seq int"


def docs(spark, rows):
    return spark.createDataFrame([(i, "git", "t", b, "u", None, n) for n, (i, b) in enumerate(rows)], DOCS)


def test_ingest_as_one_after_another(spark, tmp_path):
    root = str(tmp_path)
    # keys carry the content here, so that equal ones are copies
    rows = [("1", "x"), ("1", "x"), ("2", "y"), ("1", "z"), ("1", "x")]
    run = lambda b, rows, **more: sorted((r["episode_key"].split(":")[1], r["skipped"]) for r in writer.ingest(docs(spark, rows), root, b, order="seq", **more).collect())
    want = [("1", False), ("1", False), ("1", True), ("1", True), ("2", False)]
    assert run("b1", rows, dry_run=True) == want and not list(tmp_path.iterdir())
    assert run("b1", rows) == want
    assert run("b1", rows) == want  # done again: the same, and nothing twice
    assert spark.read.parquet(f"{root}/episodes").count() == 3 and spark.read.parquet(f"{root}/ledger").count() == 3
    assert run("b2", [("1", "x"), ("3", "w")]) == [("1", True), ("3", False)]
    episode = spark.read.parquet(f"{root}/episodes").where("source_description = 'git:3 (u)'").first()
    assert episode["kind"] == "text" and episode["reference_time"] is not None and episode["group_id"] == writer.GROUP


def test_stream_twice(spark, tmp_path):
    source = str(tmp_path / "in")
    docs(spark, [("1", "x"), ("2", "y"), ("1", "x")]).write.parquet(source)
    for more in ([], [("2", "y"), ("4", "n")]):
        if more:
            docs(spark, more).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DOCS).parquet(source)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"), order="seq").awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "episodes")).count() == (3 if more else 2)


def test_a_stream_with_a_new_checkpoint_keeps_what_others_committed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, [("1", "x"), ("2", "y"), ("3", "z")]).write.parquet(source)
    stream = lambda: spark.readStream.schema(DOCS).parquet(source)
    ingest.ingest(stream(), out, str(tmp_path / "first"), order="seq").awaitTermination()
    docs(spark, [("4", "n")]).write.mode("append").parquet(source)
    ingest.ingest(stream(), out, str(tmp_path / "second"), order="seq").awaitTermination()
    for table in ("episodes", "ledger"):
        assert spark.read.parquet(f"{out}/{table}").count() == 4


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 2, "a", 1.0, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(12)], "event_id int, user_id int, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    ingest.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["window"]["start"], r["n"], r["total"]) for r in spark.table("tumbled").collect())
    assert got == sorted((r["window"]["start"], r["n"], r["total"]) for r in ingest.tumbling(events).collect()) and len(got) == 3


JAVA = """package com.acme; // class Hidden {}
public class Meter implements Runnable {
    private final Billing billing;
    private List<String> names = new ArrayList<>();
    private ReadEvent last;
    @Override public void run(int a) { if (a > 0) { bus.publish(new ReadEvent(a)); } }
    void wire() { bus.subscribe(PaidEvent.class, e -> {}); String s = "class Fake {"; }
    class Inner { void hidden() {} }
}
interface Port { void open(); }
"""
CS = """namespace Acme.Core { public class Hub { private Store store; public event EventHandler Changed; public void Go() { bus.Send(new StartedEvent()); } } }"""


def test_code_documents(spark, tmp_path):
    python = b"class Svc:\n    dep: Repo\n    def go(self):\n        publish(DoneEvent())\n"
    files = spark.createDataFrame([("d/Meter.java", JAVA.encode(), "java"), ("d/Hub.cs", CS.encode(), "csharp"), ("d/svc.py", python, "python"), ("n.py", None, "python"), ("bad.py", b"def (", "python")], "path string, content binary, language string")
    found = {r["class"]: r for r in code.classes(files).collect()}
    meter = found["Meter"]
    assert set(found) == {"Meter", "Port", "Hub", "Svc"}
    assert (meter["methods"], meter["published"], meter["subscribed"], meter["package"], meter["kind"]) == (["run", "wire"], ["ReadEvent"], ["PaidEvent"], "com.acme", "class")
    assert set(meter["dependencies"]) == {"Billing", "List"} and (meter["line"], meter["line_end"]) == (2, 9)
    assert (found["Port"]["kind"], found["Port"]["methods"]) == ("interface", ["open"])
    assert (found["Hub"]["published"], found["Hub"]["dependencies"], found["Hub"]["package"]) == (["StartedEvent", "Changed"], ["Store"], "Acme.Core")
    mods = modules.modules(code.classes(files))
    body = modules.documents(mods, files).where("url = 'd/svc.py'").first()
    summary = json.loads(body["body"].split("```json\n")[1].split("\n```")[0])
    assert summary == [{"name": "Svc", "kind": "class", "lines": "1-4", "methods": ["go"], "events_published": ["DoneEvent"], "calls": ["Repo"]}]
    assert (body["id_source"], body["title"], body["source_type"]) == ("code:python:d/svc.py", "[Code] svc", "obsidian") and body["body"].endswith(python.decode() + "\n```")
    assert modules.only(mods, "svc").select(modules.diagram()).first()[0] == 'flowchart LR\n  c_Svc["Svc"]\n  e_DoneEvent{{"DoneEvent"}}\n  d_Repo(["Repo"])\n  c_Svc -->|publie| e_DoneEvent\n  c_Svc -.->|appelle| d_Repo'
    with pytest.raises(ValueError, match="Meter"):
        modules.only(mods, "none")
    base = modules.base(modules.only(mods, "svc"))
    again = modules.completed(modules.payloads(base))
    assert again.columns == [c for c in base.columns if c != "contexte"] and again.first()["sources"] == ["d/svc.py:1-4 (Svc)"]
    text = again.withColumn("risques", F.array(F.lit("dette"))).select(modules.page()).first()[0]
    assert text.startswith("---\nmodule: svc\nlanguage: python\ntags: [code, python, reverse-engineering]\n---\n\n# svc\n\n## Description fonctionnelle\n\n_Aucune description générée._\n\n## Diagramme\n")
    assert text.endswith("## Composants\n\n- `Svc`\n\n## Flux\n\n- **Événements publiés** : `DoneEvent`\n\n## Risques / dette technique\n\n- dette\n\n## Sources\n\n- `d/svc.py:1-4 (Svc)`\n")
    modules.write_pages(again, str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "svc.md").read_text().startswith("---\nmodule: svc\n")


def test_markdown_tables_are_one_block(spark):
    text = "# T\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| c |\npara\n- x\n---\n## S\n- y"
    found = render.numbered_sections(render.grouped_blocks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t"), "id").orderBy("pos").collect()
    assert [(r["kind"], len(r["lines"]), r["section"]) for r in found] == [("heading", 1, 0), ("table", 2, 0), ("table", 1, 0), ("paragraph", 1, 0), ("bullet", 1, 0), ("heading", 1, 1), ("bullet", 1, 1)]
    rows = spark.createDataFrame([(1, ["x"], None)], "n int, xs array<string>, t string")
    assert render.table_rows(rows, "n").first()["cells"] == ["1", '["x"]', ""]


def test_odd_vectors_are_not_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.5]), (6, [1.0, 0.0, 0.0]), (7, [1.0, None])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in retrieval.cosine_search(v, v).orderBy("query_id").collect()] == [(1, 5), (5, 1)]


def test_least_depths(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(40), draw.randrange(40)) for _ in range(45)]
    near = {i: set() for i in range(40)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    depth, step = {0: 0, 1: 0}, {0, 1}
    for d in range(1, 4):
        step = {y for x in step for y in near[x]} - set(depth)
        depth |= dict.fromkeys(step, d)
    edges, seeds = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(0,), (1,)], "node long")
    assert {r["node"]: r["depth"] for r in graph.neighbourhood(edges, seeds, 3).collect()} == depth
