"""Questions answered from the graph: context, calls of a model service from tasks, structured answers.

The context is a plan of joins and windows. A service is called by tasks, at a bounded rate in all of them
together. What it said is kept in a shared folder by the hash of the prompt, so that a task that
runs again, or another run, asks nothing twice; a call that failed is a row with its error.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.operators import context, render, retrieval

# What stands for a context without candidates, the keys of an answer, and the texts that a model is given.
NOTHING = "Aucun contexte disponible dans le graphe de connaissances."
KEYS = ("facts", "decisions", "actions", "risks", "sources")
SYSTEM = (
    "Tu es un assistant expert du projet. Réponds UNIQUEMENT à partir du contexte fourni ; si l'information est absente, dis-le explicitement. "
    "Réponds en JSON valide avec exactement les clés : resume, facts, decisions, actions, risks, sources. Ne génère aucun texte en dehors du JSON."
)
SCHEMA = """{
  "resume": "résumé de la réponse",
  "facts": ["fait 1", "fait 2"],
  "decisions": ["décision 1"],
  "actions": ["action 1"],
  "risks": ["risque 1"],
  "sources": ["source 1"]
}"""

#: A client takes a system text and a message, and returns what the model says; it raises where there is no answer.
Client = Callable[[str, str], str]


def contexts(facts: DataFrame, questions: DataFrame, *, classes: list[str] | None = None, budget: int = context.BUDGET, scorer: Callable[[Column, Column], Column] = retrieval.overlap, search: Callable[[DataFrame, DataFrame], DataFrame] = retrieval.hybrid) -> DataFrame:
    """``item_id, question, context, used, included`` for every question ``item_id, text, as_of``.

    Facts are ``doc_id, text, name, valid_at, expired_at, node``: the best of hybrid search at the question's date, reranked, in
    sections by ``name``. ``classes`` keeps facts of these classes only; ``search`` may be one over an index of them. A question that finds nothing has the text NOTHING.
    """
    kind = context.classify(F.coalesce("name", F.lit("")))
    own = facts.withColumn("class", kind)
    own = own.where(F.col("class").isin(classes)) if classes is not None else own
    found = search(own, questions).select("item_id", "doc_id", "rank")
    asked = questions.select("item_id", F.col("text").alias("question"))
    told = own.select("doc_id", "text", "class", F.date_format(F.col("valid_at").cast("timestamp"), "yyyy-MM-dd").alias("since"))
    best = retrieval.rerank(found.join(told, "doc_id").join(asked, "item_id"), scorer=scorer)
    entry = context.entry_text(F.col("text"), F.concat(F.lit("graph:"), F.col("doc_id").cast("string")), F.lit(None).cast("int"), F.col("since"))
    packed = context.pack(best.select("item_id", "question", "class", F.col("new_rank").alias("rank"), entry.alias("entry")), budget)
    whole = asked.join(packed, "item_id", "left")
    none = F.col("context").isNull()
    return whole.select("item_id", "question", F.coalesce("context", F.lit(NOTHING)).alias("context"), F.when(none, 0).otherwise(F.col("used")).alias("used"), F.when(none, 0).otherwise(F.col("included")).alias("included"))


def message(question: Column, context_: Column) -> Column:
    return F.concat(F.lit("Contexte :\n"), context_, F.lit("\n\nQuestion : "), question, F.lit(f"\n\nRéponds en JSON selon ce schéma :\n{SCHEMA}"))


def parsed(said: str, text: str = "resume", lists: tuple[str, ...] = KEYS) -> dict:
    """The answer in a model's text, bare or in a fenced block: an object with a ``text`` and ``lists`` of texts; ValueError where it isn't one."""
    body = said.strip()
    if body.startswith("```"):
        lines = body.splitlines()
        ends = [i for i, line in enumerate(lines) if i and line.strip() == "```"]
        body = "\n".join(lines[1 : ends[-1] if ends else len(lines) - 1])
    found = json.loads(body)
    if not isinstance(found, dict) or not isinstance(found.get(text), str):
        raise ValueError(f"no {text}")
    for key in lists:
        if not isinstance(found.get(key, []), list) or not all(isinstance(x, str) for x in found.get(key, [])):
            raise ValueError(f"{key} is no list of texts")
    return found


class Service:
    """A client of a chat service that speaks the usual protocol; the token comes from an environment variable of the executor."""

    def __init__(self, url: str, model: str, token_variable: str = "", timeout: float = 120.0):
        self.url, self.model, self.token_variable, self.timeout = f"{url.rstrip('/')}/chat/completions", model, token_variable, timeout

    def __call__(self, system: str, text: str) -> str:
        asked = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "temperature": 0.1, "response_format": {"type": "json_object"}}
        token = os.environ.get(self.token_variable, "") if self.token_variable else ""
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})}
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(asked).encode(), headers), timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]


class Kept:
    """Texts by the hash of a prompt, a file each in a folder that all executors share."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.files.create_dir(self.path, recursive=True)

    def get(self, name: str) -> str | None:
        try:
            with self.files.open_input_stream(f"{self.path}/{name}") as file:
                return file.read().decode()
        except FileNotFoundError:
            return None

    def put(self, name: str, text: str) -> None:
        """The file is whole or not there: it is moved into place."""
        part = f"{self.path}/.{name}-{os.getpid()}-{time.monotonic_ns()}"
        with self.files.open_output_stream(part) as file:
            file.write(text.encode())
        self.files.move(part, f"{self.path}/{name}")


def ask(prompts: DataFrame, client: Client, kept: str, *, rate: float | None = None, tasks: int = 8, column: str = "message", system: str = SYSTEM, check: Callable[[str], dict] = parsed) -> DataFrame:
    """All columns, and ``raw, error, calls``: what the model said to each prompt. ``check`` raises ValueError for what is no answer.

    An answer that doesn't parse is asked for once more; then, or if the client raises, ``error`` says why. Answers are kept below ``kept``; failures aren't, and are
    tried again by another run. ``rate`` bounds the calls a second of all ``tasks`` together. Equal prompts are asked once a task.
    """
    schema = ", ".join([*(f"`{c}` {t}" for c, t in prompts.dtypes), "raw string, error string, calls int"])

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, last = Kept(kept), [0.0]

        def call(text: str) -> str:
            if rate:
                time.sleep(max(0.0, last[0] + tasks / rate - time.monotonic()))
                last[0] = time.monotonic()
            return client(system, text)

        def answer(text: str) -> tuple[str | None, str | None, int]:
            name = hashlib.sha256(f"{system}\0{text}".encode()).hexdigest()
            if (said := store.get(name)) is not None:
                return said, None, 0
            for attempt in (1, 2):
                try:
                    said = call(text)
                except Exception as e:
                    return None, f"{type(e).__name__}: {e}", attempt
                try:
                    check(said)
                except (ValueError, RecursionError) as e:
                    problem = f"not parseable after {attempt} attempts: {e}"
                else:
                    store.put(name, said)
                    return said, None, attempt
            return said, problem, 2

        for batch in batches:
            told = [answer(x) for x in batch[column]]
            yield batch.assign(raw=pd.Series([t[0] for t in told], index=batch.index, dtype=object), error=pd.Series([t[1] for t in told], index=batch.index, dtype=object), calls=np.array([t[2] for t in told], dtype=np.int32))

    return prompts.repartition(tasks, column).mapInPandas(answers, schema)


def answer(facts: DataFrame, questions: DataFrame, client: Client, kept: str, *, rate: float | None = None, tasks: int = 8, **options) -> DataFrame:
    """``item_id, question, context, answer, markdown, error`` for every question: context, call, structured answer, page."""
    asked = contexts(facts, questions, **options)
    said = ask(asked.withColumn("message", message(F.col("question"), F.col("context"))), client, kept, rate=rate, tasks=tasks)
    told = render.answers(said).withColumn("answer", F.when(F.col("error").isNull(), F.col("answer")))
    page = F.when(F.col("answer").isNotNull(), render.answer_markdown(F.col("question"), F.col("answer")))
    return told.select("item_id", "question", "context", "answer", page.alias("markdown"), "error")


_MODELS: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]):
    """Loaded once in a worker, which serves many tasks."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def cross_encoder(name: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 64) -> Callable[[Column, Column], Column]:
    """A scorer for ``retrieval.rerank`` by a model over pairs of texts, which ``load`` gives; it is loaded once a worker under ``name``.

    Pairs go to the model in batches of like length, so that little is padded. A model that returns another number of scores than pairs is an error.
    """

    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for questions, texts in parts:
            pairs = [(q or "", t or "") for q, t in zip(questions, texts, strict=True)]
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
            out = np.zeros(len(pairs))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                scores = model([pairs[i] for i in own])
                if len(scores) != len(own):
                    raise ValueError(f"{len(scores)} scores for {len(own)} pairs")
                out[own] = scores
            yield pd.Series(out)

    def scorer(question: Column, text: Column) -> Column:
        return F.pandas_udf(score, "double")(question, text)

    score.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return scorer
