import random

import pytest
from pyspark.sql import functions as F

from kairograph.functions import text as T
from kairograph.operators import code, context, graph, ledger, render, retrieval
from kairograph.sources import records, transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_episode_key(spark):
    ts = F.to_timestamp(F.lit("2024-03-10T12:00:00Z"))
    assert one(spark, T.episode_key(F.lit("confluence"), F.lit("CONF-123"), F.lit("b"), ts)) == "confluence:CONF-123:2024-03-10T12:00:00+00:00"
    assert one(spark, T.episode_key(F.lit("git"), F.lit("a\\b"), F.lit("b"))).startswith("git:a/b:")


def test_pdf_date(spark):
    assert str(one(spark, T.parse_pdf_date(F.lit("D:20240115103000+01'00'")))) == "2024-01-15 10:30:00"
    assert one(spark, T.parse_pdf_date(F.lit("D:2024"))) is None


def test_ledger_skips_only_unchanged(spark):
    docs = ledger.with_keys(spark.createDataFrame([("git", "1", "a"), ("git", "2", "b")], "source_type string, id_source string, body string"))
    seen = docs.select("episode_key", "content_hash", F.lit(0).alias("ingested_at"))
    assert ledger.not_ingested(docs, seen).count() == 0
    newer = seen.withColumn("content_hash", F.lit("x")).withColumn("ingested_at", F.lit(1))
    assert ledger.not_ingested(docs, seen.unionByName(newer)).count() == 2


def test_phase(spark):
    rows = spark.createDataFrame([("en PR2 ?",), ("PR 3",), ("sprint1",), ("PR99",), ("rien",)], "q string")
    assert [str(r[0]) for r in rows.select(retrieval.phase_date(F.col("q"))).collect()] == ["2023-12-01", "2024-06-01", "2023-03-01", "None", "None"]


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(1, "a b", i, t, i) for i, t in enumerate(["x", "a b", "a", "y"])], "item_id int, question string, doc_id int, text string, rank int")
    assert [r["doc_id"] for r in retrieval.rerank(rows, 3).orderBy("new_rank").collect()] == [1, 2, 0]


def tokens(s):
    return max(1, int(len(s.split()) * 1.3))


def plain_pack(question, items, budget):
    used, out = tokens(f"## Question\n{question}"), f"## Question\n{question}"
    for kind, heading in context.SECTIONS:
        own = [e for k, e in items if k == kind]
        if not own:
            continue
        h = tokens(heading)
        if used + h >= budget:
            break
        entries = []
        for e in own:
            if used + h + tokens(e) > budget:
                break
            entries.append(e)
            used += tokens(e)
        if entries:
            used += h
            out += "\n\n" + heading + "\n" + "\n".join(entries)
    return out


@pytest.mark.parametrize("budget", [5, 20, 40, 80])
def test_pack_matches_a_plain_loop(spark, budget):
    draw = random.Random(budget)
    rows, want = [], {}
    for q in range(25):
        items = [(draw.choice(context.SECTIONS)[0], "- " + "w " * draw.randint(1, 14) + str(i)) for i in range(draw.randint(0, 9))]
        rows += [(q, f"q {q}", k, i, e) for i, (k, e) in enumerate(items)] or [(q, f"q {q}", None, 0, None)]
        want[q] = plain_pack(f"q {q}", items, budget)
    frame = spark.createDataFrame(rows, "item_id int, question string, class string, rank int, entry string")
    assert {r["item_id"]: r["context"] for r in context.pack(frame, budget).collect()} == want


def test_as_of(spark):
    facts = spark.createDataFrame([(1, 0, 10), (2, 5, None), (3, 20, None)], "id int, valid_at int, expired_at int")
    assert [r["id"] for r in graph.as_of(facts, 7).collect()] == [1, 2]
    assert [r["id"] for r in graph.as_of(facts, 7, strict_expired=True).collect()] == [1]


def test_transcripts(spark):
    txt = spark.createDataFrame([("a.txt", "Réunion\n\n[00:01:30] Alice Martin: bonjour\n[00:02] sans nom")], "file string, value string")
    rows = transcripts.from_text(txt).orderBy("seq").collect()
    assert [(r["ts"], r["speaker"], r["text"]) for r in rows] == [(None, None, "Réunion"), ("00:01:30", "Alice Martin", "bonjour"), ("00:02", None, "sans nom")]
    vtt = spark.createDataFrame([("a.vtt", "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nBob Roy: un\ndeux\n\nNOTE x\n\n2\n00:00:03.000 --> 00:00:04.000\ntrois")], "file string, value string")
    rows = transcripts.from_vtt(vtt).orderBy("seq").collect()
    assert [(r["ts"], r["speaker"], r["text"]) for r in rows] == [("00:00:01.000", "Bob Roy", "un deux"), ("00:00:03.000", None, "trois")]


def test_python_relations(spark):
    source = "class Meter:\n    bus: EventBus\n    def run(self):\n        self.bus.publish(ReadingCompletedEvent(1))\n        self.bus.subscribe(AlertEvent)\n@x\nclass Hidden:\n    pass\n"
    files = spark.createDataFrame([("src/meter.py", bytearray(source.encode())), ("bad.py", bytearray(b"def ("))], "path string, content binary")
    rel = code.relations(code.python_classes(files)).collect()
    assert sorted((r["source_component"], r["target"], r["kind"], r["confidence"]) for r in rel) == [
        ("Meter", "AlertEvent", "consomme", 0.7), ("Meter", "EventBus", "appelle", 0.5), ("Meter", "ReadingCompletedEvent", "publie", 0.7)]


def test_mermaid(spark):
    rel = spark.createDataFrame([("s", "A", "X Event", "publie", "f", 1), ("s", "A", "B", "appelle", "f", 2)], "system string, source_component string, target string, kind string, source_file string, line int")
    text = code.mermaid(rel).first()["diagram"]
    assert 'e_X_Event{{"X Event"}}' in text and "c_A -.->|appelle| c_B" in text and text.count('c_A["A"]') == 1


def test_answers(spark):
    raw = spark.createDataFrame([('```json\n{"resume": "r", "facts": ["f"], "sources": ["Doc — https://a.b/c."]}\n```',), ("{bad",), ('{"facts": []}',)], "raw string")
    rows = render.answers(raw).withColumn("md", render.answer_markdown(F.lit("q"), F.col("answer"))).collect()
    assert rows[1]["answer"] is None and rows[2]["answer"] is None
    assert rows[0]["md"] == "# q\n\n## Résumé\nr\n\n## Faits\n- f\n\n## Sources\n- [Doc](https://a.b/c)"
    bare = raw.limit(1).select(F.struct(F.lit("r").alias("resume"), *[F.expr("cast(array() as array<string>)").alias(c) for c in ("facts", "decisions", "actions", "risks", "sources")]).alias("a"))
    assert bare.select(render.answer_markdown(F.lit(" q\n"), F.col("a"))).first()[0] == "# q\n\n## Résumé\nr\n\n## Sources\n_Aucune source._"


def test_routing(spark):
    files = spark.createDataFrame([("a/B.DOCX",), ("c.vtt",), ("d.bin",), ("none",)], "path string")
    assert [r["reader"] for r in records.route(files).collect()] == ["docx", "meeting", None, None]


def test_cosine_search_matches_numpy(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 8)).astype("float32")
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    rows = retrieval.cosine_search(frame, frame.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    x = v / np.linalg.norm(v, axis=1)[:, None]
    for q in (0, 20, 40):
        near = [i for i in np.argsort(-(x @ x[q])) if i != q][:3]
        assert [r["vec_id"] for r in rows if r["query_id"] == q] == near


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("wide"), F.col("id").alias("valid_at"), F.lit(None).cast("long").alias("expired_at")).write.parquet(str(tmp_path / "t"))
    plan = graph.as_of(spark.read.parquet(str(tmp_path / "t")), 5).select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(valid_at), LessThanOrEqual(valid_at,5)" in plan and "wide" not in plan.rpartition("Physical Plan")[2]
