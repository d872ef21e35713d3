"""Requests and replies of model endpoints as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schemas

CHAT = "choices array<struct<message:struct<content:string>>>"
REPLY = "summary string, keywords array<string>, entities array<string>, classification string, _bad string"


def chat_content(body: Column) -> Column:
    """Content of the first choice; null if there is none."""
    return F.get(F.from_json(body, CHAT)["choices"], F.lit(0))["message"]["content"]


def reply(content: Column) -> Column:
    """The struct between the first ``{`` and the last ``}``; missing fields take defaults.

    Without braces, or with a field of a wrong type, the result is null.
    """
    cut = F.nullif(F.regexp_extract(content, r"(?s)\{.*\}", 0), F.lit(""))
    got = F.from_json(cut, REPLY, {"columnNameOfCorruptRecord": "_bad"})
    none = F.array().cast("array<string>")
    fields = F.struct(
        F.coalesce(got["summary"], F.lit("")).alias("summary"),
        F.coalesce(got["keywords"], none).alias("keywords"),
        F.coalesce(got["entities"], none).alias("entities"),
        F.coalesce(got["classification"], F.lit("")).alias("classification"),
    )
    return F.when(cut.isNotNull() & got["_bad"].isNull(), fields)


def first_vector(body: Column) -> Column:
    return F.get(F.from_json(body, "data array<struct<embedding:array<float>>>")["data"], F.lit(0))["embedding"]


def list_or_null(items: Column) -> Column:
    """The list as JSON text; an empty one is null."""
    return F.when(F.size(items) > 0, F.to_json(items))


def chat_request(model: str, system: str, text: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.substring(text, 1, schemas.MAX_BODY_CHARS)
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", body)).alias("messages"), F.lit(0.2).alias("temperature")))
