"""Tickets and wiki pages from paged web services, as Python data sources of JSON rows, for scans and for streams.

A page that a service refuses is asked for again after growing waits, and then is an error of the task, which
Spark tries again elsewhere: a scan has all rows, or fails. Ranges of rows are read by a task each; a page shorter than was asked
for only moves a range's place on, since services cap pages. A stream's offsets are
the times of the last change that was read: a run that stopped goes on from there.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kairograph.sources.records import ISSUE, PAGE

#: Rows of a page; of a range, where a service tells no total, and how many tasks take such ranges in turn.
PAGE_SIZE, STRIPE, TASKS = 50, 500, 8
#: Times that a page is asked for, and seconds to wait after the first failure, doubled after each.
TRIES, WAIT = 5, 0.5
#: Services compare times by the minute, in a zone of their own: so much more is asked for, and left out again by the rows' own times.
MARGIN = timedelta(days=1)
# The columns of a ticket that are asked for, and what of a page and of a comment.
FIELDS = "summary,description,status,assignee,reporter,created,updated,comment,issuelinks"
EXPANDED = "body.storage,version,history,space,metadata.labels"
COMMENT = "body.view,body.storage"


class ServiceError(RuntimeError):
    """A service that still refuses, or can't be reached, after all tries."""


def fetch(url: str, token: str | None, tries: int = TRIES, wait: float = WAIT) -> dict:
    """The JSON behind a URL. A refusal that is the asker's fault (4xx, but for too many requests and timeouts) is an error at once."""
    request = urllib.request.Request(url, headers={"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    for attempt in range(1, tries + 1):
        pause = wait * 2 ** (attempt - 1)
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                found = json.loads(answer.read())
            if not isinstance(found, dict):
                raise ValueError("no object")
            return found
        except urllib.error.HTTPError as e:
            problem = e
            if e.code < 500 and e.code not in (408, 425, 429):
                break
            if (asked := e.headers.get("Retry-After", "")).isdigit():
                pause = max(pause, float(asked))
        except (OSError, ValueError) as e:  # URLError and timeouts are OSErrors
            problem = e
        if attempt < tries:
            time.sleep(pause)
    raise ServiceError(f"{url}: {type(problem).__name__}: {problem}")


class _Service:
    """A paged service by its options."""

    def __init__(self, options):
        self.options = dict(options)
        self.most = int(self.options.get("limit", 0)) or None

    def ask(self, start: int, size: int, **more: str) -> dict:
        asked = {k: self.options[n] for k, n in (("jql", "query"), ("spaceKey", "space"), ("fields", "fields"), ("expand", "expand")) if self.options.get(n) and not (k == "jql" and "filtername" in self.options)}
        asked |= {**more, self.options["startname"]: start, self.options["sizename"]: size}
        wait = float(self.options.get("wait", WAIT))
        return fetch(f"{self.options['url']}?{urllib.parse.urlencode(asked)}", os.environ.get(self.options.get("tokenvariable", "")), wait=wait)

    def rows(self, at: int, end: int | None, **more: str) -> Iterator[dict]:
        """The rows from ``at`` to ``end``, or to the first page that is empty."""
        while end is None or at < end:
            size = PAGE_SIZE if end is None else min(PAGE_SIZE, end - at)
            found = (self.ask(at, size, **more).get(self.options["rows"]) or [])[:size]
            if not found:
                return
            yield from found
            at += len(found)


class _Pages(DataSourceReader, _Service):
    """Ranges of rows, a task each where the service tells the total; else each task takes every TASKS-th range until one is empty."""

    def __init__(self, options):
        _Service.__init__(self, options)

    def partitions(self) -> list[InputPartition]:
        total = self.ask(0, 1).get("total")
        if total is None:
            return [InputPartition((i, None)) for i in range(TASKS)]
        total = min(int(total), self.most or int(total))
        return [InputPartition((at, min(at + PAGE_SIZE, total))) for at in range(0, total, PAGE_SIZE)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, end = partition.value
        if end is not None:
            yield from ((json.dumps(row),) for row in self.rows(at, end))
            return
        stripe = at
        while self.most is None or stripe * STRIPE < self.most:
            low, high = stripe * STRIPE, min((stripe + 1) * STRIPE, self.most or (stripe + 1) * STRIPE)
            n = 0
            for row in self.rows(low, high):
                n += 1
                yield (json.dumps(row),)
            if not n:
                return
            stripe += TASKS


def _time(text: str) -> datetime:
    when = datetime.fromisoformat(text)
    return when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)


class _Changes(DataSourceStreamReader, _Service):
    """Rows by the time of their last change; ``filter`` has the service's own words for {start} and {end}, ``changed`` the path of the time."""

    def __init__(self, options):
        _Service.__init__(self, options)

    def _when(self, row: dict) -> datetime | None:
        for key in self.options["changed"].split("."):
            row = (row or {}).get(key)
        return _time(row) if row else None

    def _filter(self, start: str, end: str | None) -> dict[str, str]:
        minute = lambda x, by: (_time(x) + by).strftime("%Y-%m-%d %H:%M") if x else None
        bounds = [self.options[f"filter{n}"].format(x) for n, x in (("start", minute(start, -MARGIN)), ("end", minute(end, MARGIN))) if x]
        return {self.options["filtername"]: " AND ".join([f"({self.options['query']})", *bounds]) + (f" ORDER BY {self.options['order']}" if end else f" ORDER BY {self.options['newest']}")}

    def initialOffset(self) -> dict:
        return {"at": self.options.get("since", "")}

    def latestOffset(self) -> dict:
        newest = self.ask(0, 1, **self._filter("", None)).get(self.options["rows"]) or []
        when = self._when(newest[0]) if newest else None
        return {"at": when.isoformat()} if when else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["at"] == end["at"] or not end["at"]:
            return [InputPartition((start["at"], end["at"], 0, 0))]
        total = self.ask(0, 1, **self._filter(start["at"], end["at"])).get("total")
        ranges = [(0, None)] if total is None else [(at, min(at + PAGE_SIZE, int(total))) for at in range(0, int(total), PAGE_SIZE)]
        return [InputPartition((start["at"], end["at"], *r)) for r in ranges or [(0, 0)]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end, at, stop = partition.value
        for row in self.rows(at, stop, **self._filter(start, end)) if stop != 0 else ():
            when = self._when(row)
            if when is not None and when <= _time(end) and (not start or when > _time(start)):
                yield (json.dumps(row),)

    def commit(self, end: dict) -> None:
        """Nothing is kept at the service."""


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagedjson"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("value", schema).alias("x")).select("x.*")


def _ticket_options(url: str, query: str, token_variable: str) -> dict[str, str]:
    return {"url": f"{url.rstrip('/')}/rest/api/2/search", "query": query, "fields": FIELDS, "expand": "changelog", "startname": "startAt", "sizename": "maxResults", "rows": "issues", "tokenvariable": token_variable}


def tickets(spark: SparkSession, url: str, query: str, limit: int | None = None, token_variable: str = "", **more: str) -> DataFrame:
    """ISSUE rows that a query finds; ``token_variable`` names the environment variable that holds the token on the executors."""
    spark.dataSource.register(PagedJson)
    return _typed(spark.read.format("pagedjson").options(limit=str(limit or 0), **_ticket_options(url, query, token_variable), **more).load(), ISSUE)


def pages(spark: SparkSession, url: str, space: str, limit: int | None = None, token_variable: str = "", **more: str) -> DataFrame:
    """PAGE rows of a space."""
    spark.dataSource.register(PagedJson)
    options = {"url": f"{url.rstrip('/')}/rest/api/content", "space": space, "expand": EXPANDED, "startname": "start", "sizename": "limit", "rows": "results", "tokenvariable": token_variable}
    return _typed(spark.read.format("pagedjson").options(limit=str(limit or 0), **options, **more).load(), PAGE)


def changed_tickets(spark: SparkSession, url: str, query: str, since: str = "", token_variable: str = "", **more: str) -> DataFrame:
    """A stream of ISSUE rows that a query finds, as they were after their last change later than ``since``."""
    spark.dataSource.register(PagedJson)
    told = {"filtername": "jql", "filterstart": 'updated >= "{}"', "filterend": 'updated <= "{}"', "order": "key ASC", "newest": "updated DESC", "changed": "fields.updated", "since": since}
    return _typed(spark.readStream.format("pagedjson").options(**_ticket_options(url, query, token_variable), **told, **more).load(), ISSUE)


def changed_pages(spark: SparkSession, url: str, space: str, since: str = "", token_variable: str = "", **more: str) -> DataFrame:
    """A stream of PAGE rows of a space, as they were after their last change later than ``since``."""
    spark.dataSource.register(PagedJson)
    options = {"url": f"{url.rstrip('/')}/rest/api/content/search", "query": f'space = "{space}" AND type = page', "expand": EXPANDED, "startname": "start", "sizename": "limit", "rows": "results", "tokenvariable": token_variable}
    told = {"filtername": "cql", "filterstart": 'lastmodified >= "{}"', "filterend": 'lastmodified <= "{}"', "order": "created ASC", "newest": "lastmodified DESC", "changed": "version.when", "since": since}
    return _typed(spark.readStream.format("pagedjson").options(**options, **told, **more).load(), PAGE)


def comments(pages_: DataFrame, url: str, token_variable: str = "", wait: float = WAIT) -> DataFrame:
    """``id, seq, author, value`` of all comments of PAGE rows, asked for page by page in tasks; answers to comments too."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["id"]:
                options = {"url": f"{url.rstrip('/')}/rest/api/content/{urllib.parse.quote(str(page), safe='')}/child/comment", "expand": COMMENT, "startname": "start", "sizename": "limit", "rows": "results", "tokenvariable": token_variable, "wait": str(wait)}
                body = lambda c, form: ((c.get("body") or {}).get(form) or {}).get("value")
                found = [(page, i, (c.get("author") or ((c.get("history") or {}).get("createdBy")) or {}).get("displayName"), body(c, "view") or body(c, "storage") or "") for i, c in enumerate(_Service(options).rows(0, None, depth="all"))]
                if found:
                    yield pd.DataFrame(found, columns=["id", "seq", "author", "value"]).astype({"id": object, "author": object, "value": object})

    return pages_.select("id").mapInPandas(ask, "id string, seq long, author string, value string")
