"""Row types and closed domains of the normalised data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The closed sets that other tools of this data model use.
SOURCE_TYPES = ("jira", "confluence", "git", "docx", "xlsx", "pdf", "meeting", "obsidian", "diagram")
ENTITY_TYPES = ("Person", "Application", "Component", "Document", "Ticket", "Meeting", "Decision", "Action", "BusinessRule")
RELATION_KINDS = ("publie", "consomme", "appelle")

DOCUMENT = (
    "id_source string, source_type string, title string, body string, author string, created_at timestamp, "
    "modified_at timestamp, url string, meta string, attachments array<string>"
)
ENTITY = "key string, type string, name string, summary string, attrs string"
RELATION = "source_key string, target_key string, name string, fact string, valid_at timestamp, invalid_at timestamp"
EXTRACTION = (
    "source_ref string, entities array<struct<key: string, type: string, name: string, summary: string, attrs: string>>, "
    "relations array<struct<source_key: string, target_key: string, name: string, fact: string, valid_at: timestamp, invalid_at: timestamp>>"
)
CANDIDATE = "source_component string, target string, kind string, source_file string, line int, confidence double"


def quarantine(df: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` is in the domain, and the others (null included)."""
    fine = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(fine), df.where(~fine)
