import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kairograph.operators import assistant, retrieval

GOOD = {"resume": "La réponse.", "facts": ["un fait"], "decisions": [], "actions": [], "risks": [], "sources": ["Page — https://x.example/1"]}


class Scripted:
    """A client that notes each call in a folder and answers by what a question says."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, system, text):
        asked = text.split("Question : ")[1].split("\n")[0]
        seen = len([x for x in os.listdir(self.folder) if x.startswith(f"{asked}-")])
        open(f"{self.folder}/{asked}-{seen}", "w").close()
        assert system == assistant.SYSTEM and "resume" in text and "facts" in text
        if asked == "down":
            raise ConnectionError("refused")
        if asked == "never" or (asked == "second" and not seen):
            return "ce n'est pas du JSON"
        if asked == "partial":
            return json.dumps({"facts": ["un fait"]})
        if asked == "fenced":
            return f"```json\n{json.dumps(GOOD)}\n```"
        return json.dumps(GOOD, ensure_ascii=False)


def told(spark, folder, kept, questions):
    asked = spark.createDataFrame([(q, "contexte important") for q in questions], "question string, context string")
    asked = asked.withColumn("message", assistant.message(F.col("question"), F.col("context")))
    return {r["question"]: (r["raw"], r["error"], r["calls"]) for r in assistant.ask(asked, Scripted(str(folder)), kept, tasks=2).collect()}


def test_answers_are_checked_retried_kept_and_failures_are_rows(spark, tmp_path):
    kept, notes = str(tmp_path / "kept"), tmp_path / "notes"
    notes.mkdir()
    names = ["first", "second", "never", "partial", "fenced", "down"]
    got = told(spark, notes, kept, names)
    assert {q: (e is None, n) for q, (_, e, n) in got.items()} == {"first": (True, 1), "second": (True, 2), "never": (False, 2), "partial": (False, 2), "fenced": (True, 1), "down": (False, 1)}
    assert "not parseable after 2" in got["never"][1] and "no resume" in got["partial"][1] and "refused" in got["down"][1]
    again = told(spark, notes, kept, names)
    assert {q: n for q, (_, _, n) in again.items()} == {"first": 0, "second": 0, "never": 2, "partial": 2, "fenced": 0, "down": 1}
    assert again["first"][0] == got["first"][0] and json.loads(got["first"][0]) == GOOD
    assert len([x for x in os.listdir(notes) if x.startswith("first-")]) == 1
    assert not [x for x in os.listdir(kept) if x.startswith(".")]


def test_calls_keep_to_the_rate(spark, tmp_path):
    import time

    notes = tmp_path / "notes"
    notes.mkdir()
    asked = spark.createDataFrame([(f"q{i}", "c") for i in range(8)], "question string, context string").withColumn("message", assistant.message(F.col("question"), F.col("context"))).coalesce(1)
    start = time.time()
    assert assistant.ask(asked, Scripted(str(notes)), str(tmp_path / "kept"), rate=4, tasks=1).where("calls = 1").count() == 8
    assert time.time() - start >= 7 / 4


@pytest.mark.parametrize("said", ["", "[]", '"x"', '{"resume": 1}', '{"resume": "r", "facts": "f"}', '{"resume": "r", "risks": [1]}', "```\n{}\n```", "{" * 5000])
def test_what_is_no_answer(said):
    with pytest.raises(ValueError):
        assistant.parsed(said)


def test_what_is_an_answer():
    assert assistant.parsed(' {"resume": "r"} ') == {"resume": "r"}
    assert assistant.parsed('```json\n{"resume": "r"}\n```\n')["resume"] == "r"


def facts(spark):
    rows = [
        (1, "le compteur est en production", "a_pour_fait", "2023-01-01", None, "n1"), (2, "décision de changer le compteur", "prend_la_décision", "2023-02-01", "2024-01-01", "n1"),
        (3, "risque sur le compteur", "RISQUE_de", "2024-02-01", None, "n2"), (4, "autre sujet", None, "2023-01-01", None, "n1"), (5, None, "action", None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, valid_at string, expired_at string, node string")


def test_contexts_at_a_date_by_class_and_of_nothing(spark):
    asked = spark.createDataFrame([(1, "compteur ?", "2023-06-01"), (2, "compteur ?", "2024-06-01"), (3, "compteur ?", None), (4, "inconnu zzz", "2001-01-01")], "item_id long, text string, as_of string")
    got = {r["item_id"]: r for r in assistant.contexts(facts(spark), asked).collect()}
    assert "## Décisions\n- décision de changer le compteur\n  _(date: 2023-02-01, source: graph:2)_" in got[1]["context"] and "risque" not in got[1]["context"]
    assert "## Risques\n- risque sur le compteur" in got[2]["context"] and "décision" not in got[2]["context"]
    assert all(x in got[3]["context"] for x in ("## Question\ncompteur ?", "## Faits", "## Décisions", "## Risques"))
    kept = {r["item_id"]: r for r in assistant.contexts(facts(spark), asked, classes=["risk"]).collect()}
    assert kept[1]["context"] == assistant.NOTHING and kept[1]["included"] == 0 and "## Faits" not in kept[3]["context"] and kept[3]["included"] == 1
    none = assistant.contexts(facts(spark).where("false"), asked).collect()
    assert {r["context"] for r in none} == {assistant.NOTHING} and len(none) == 4


def test_the_whole_chain(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    asked = spark.createDataFrame([(1, "fenced", None), (2, "never", None)], "item_id long, text string, as_of string")
    got = {r["item_id"]: r for r in assistant.answer(facts(spark), asked, Scripted(str(notes)), str(tmp_path / "kept"), tasks=2).collect()}
    assert got[1]["answer"]["resume"] == GOOD["resume"] and got[1]["markdown"].startswith("# fenced\n\n## Résumé\nLa réponse.") and got[1]["error"] is None
    assert got[2]["answer"] is None and got[2]["markdown"] is None and "not parseable" in got[2]["error"]


def test_a_model_is_loaded_once_a_worker_and_scores_like_single_pairs(spark, tmp_path):
    loads = tmp_path / "loads"
    loads.mkdir()
    folder = str(loads)

    def load():
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda pairs: [len(set(q) & set(t)) / (1 + len(t)) for q, t in pairs]

    draw = random.Random(1)
    rows = [(i, "".join(draw.choices("abcdef", k=4)), i, "".join(draw.choices("abcdefgh", k=draw.randrange(40))), 1) for i in range(300)]
    pairs = spark.createDataFrame(rows, "item_id long, question string, doc_id long, text string, rank int").repartition(8)
    scorer = assistant.cross_encoder(f"counted-{folder}", load, batch=7)
    got = {r["item_id"]: r["rerank_score"] for r in retrieval.rerank(pairs, scorer=scorer).collect()}
    assert got == {i: len(set(q) & set(t)) / (1 + len(t)) for i, q, _, t, _ in rows}
    retrieval.rerank(pairs, scorer=scorer).collect()
    workers = [x.split("-")[0] for x in os.listdir(folder)]
    assert workers and len(workers) == len(set(workers))  # 16 tasks, and as many batches of 7 pairs as it takes
    short = assistant.cross_encoder("short", lambda: lambda pairs: [0.0])
    with pytest.raises(Exception, match="scores for"):
        retrieval.rerank(pairs.coalesce(1), scorer=short).collect()
