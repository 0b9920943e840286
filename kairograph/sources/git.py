"""Commits, branches and tags of a Git repository as Python data sources: ``spark.read.format("gitlog").load(path)``."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kairograph.functions import text as T

LOG = "sha string, author string, mail string, committed_at string, message string, files array<string>"
REFS = "kind string, name string, sha string, subject string, message string, author string, made_at string"
_MARK = "\x1e"


class _Git(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def git(self, *args: str) -> str:
        """A path that is no repository says nothing."""
        if not shutil.which("git"):
            raise RuntimeError("git is not installed")
        done = subprocess.run(["git", "-C", self.path, *args], capture_output=True, text=True, errors="replace", check=False)
        return done.stdout if done.returncode == 0 else ""

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(())]


class _Log(_Git):
    def partitions(self) -> list[InputPartition]:
        """Lists of commits, so that no task walks the log before its own. The repository must be reachable by every executor."""
        shas = self.git("rev-list", "HEAD").split()
        return [InputPartition(tuple(shas[at : at + self.size])) for at in range(0, len(shas), self.size)] or [InputPartition(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for at in range(0, len(partition.value), 200):
            log = self.git("show", "-m", "--first-parent", "--name-only", f"--format={_MARK}%H%x1f%an%x1f%ae%x1f%aI%x1f%B%x1f", *partition.value[at : at + 200])
            for entry in log.split(_MARK)[1:]:
                sha, author, mail, when, message, files = entry.split("\x1f", 5)
                yield sha, author, mail, when, message.strip(), [f for f in files.split("\n") if f]


class _Refs(_Git):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Annotated tags have a tagger and a message of their own, others those of their commit."""
        for kind, where in (("branch", "refs/heads"), ("tag", "refs/tags")):
            form = "%(refname:strip=2)%1f%(objecttype)%1f%(objectname)%1f%(*objectname)%1f%(contents:subject)%1f%(contents)%1f%(taggername)%1f%(taggerdate:iso-strict)%1f%(authorname)%1f%(authordate:iso-strict)%1e"
            for entry in self.git("for-each-ref", f"--format={form}", where).split(_MARK)[:-1]:
                name, of, own, target, subject, message, tagger, tagged, author, authored = entry.strip("\n").split("\x1f")
                yield kind, name, target or own, subject, message if of == "tag" else message.strip(), (tagger if of == "tag" else author) or None, (tagged if of == "tag" else authored) or None


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        return _Log(self.options["path"], int(self.options.get("pagesize", "1000")))


class GitRefs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitrefs"

    def schema(self) -> str:
        return REFS

    def reader(self, schema) -> DataSourceReader:
        return _Refs(self.options["path"], 0)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitRefs)


_NO_FILES = "cast(array() as array<string>)"


def commit_documents(log: DataFrame, path: str) -> DataFrame:
    """Normalised documents of commits: message, author and files; the title is the first line, 200 characters at most."""
    who = F.concat(F.col("author"), F.lit(" <"), F.col("mail"), F.lit(">"))
    listed = F.array_join(F.transform("files", lambda f: F.concat(F.lit("  - "), f)), "\n")
    body = F.concat(F.lit("Message : "), F.col("message"), F.lit("\nAuteur : "), who, F.lit("\nFichiers modifiés ("), F.size("files"), F.lit(") :\n"), listed)
    meta = F.struct("sha", F.substring("sha", 1, 8).alias("short_sha"), F.size("files").alias("nb_fichiers"), F.slice("files", 1, 50).alias("fichiers"))
    at = T.parse_iso(F.col("committed_at"))
    return log.select(
        F.col("sha").alias("id_source"), F.lit("git").alias("source_type"), F.substring(F.substring_index("message", "\n", 1), 1, 200).alias("title"), body.alias("body"), who.alias("author"),
        at.alias("created_at"), at.alias("modified_at"), F.lit(path).alias("url"), F.to_json(meta).alias("meta"), F.expr(_NO_FILES).alias("attachments"),
    )


def ref_documents(refs: DataFrame, path: str) -> DataFrame:
    """Normalised documents of local branches and of tags."""
    branch, at = F.col("kind") == "branch", T.parse_iso(F.col("made_at"))
    word = F.when(branch, "Branche : ").otherwise("Tag : ")
    tip = F.concat(F.lit("\nDernier commit : "), F.substring("sha", 1, 8), F.lit(" — "), F.col("subject"), F.lit("\nAuteur : "), F.coalesce("author", F.lit("")))
    meta = F.when(branch, F.to_json(F.struct(F.col("name").alias("branch_name"), F.col("sha").alias("tip_sha")))).otherwise(F.to_json(F.struct(F.col("name").alias("tag_name"), F.col("sha").alias("commit_sha"))))
    return refs.select(
        F.concat("kind", F.lit(":"), "name").alias("id_source"), F.lit("git").alias("source_type"), F.concat(word, "name").alias("title"),
        F.concat(word, F.col("name"), F.when(branch, tip).otherwise(F.concat(F.lit("\nMessage : "), F.col("message")))).alias("body"), "author",
        F.when(~branch, at).alias("created_at"), F.when(branch, at).alias("modified_at"), F.lit(path).alias("url"), meta.alias("meta"), F.expr(_NO_FILES).alias("attachments"),
    )
