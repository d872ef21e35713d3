"""Model endpoints behind an injected client, and a client that needs no network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import json_text
from tidemark.functions.text import cap
from tidemark.sources.slices import row_by_row

#: A client takes request JSON and returns the response body; it raises on failure.
Client = Callable[[str], str]

_ANSWERS = pa.schema([("file_id", pa.int64()), ("body", pa.string()), ("error", pa.string())])


def call(requests: DataFrame, client: Client) -> DataFrame:
    """(file_id, body, error) of each (file_id, request); a failure fails its row only."""

    def answered(file_id: int, request: str) -> tuple:
        try:
            return file_id, client(request), None
        except Exception as e:  # noqa: BLE001
            return file_id, None, f"{type(e).__name__}: {e}"

    asked = requests.select(F.col("file_id").cast("long").alias("file_id"), "request")
    return asked.mapInArrow(row_by_row(answered, _ANSWERS), "file_id long, body string, error string")


def enrich(texts: DataFrame, client: Client, model: str, system: str) -> DataFrame:
    """Summary, keywords, entities (JSON text, null if empty) and classification of each (file_id, body_text)."""
    asked = texts.select("file_id", json_text.chat_request(model, system, F.col("body_text")).alias("request"))
    got = call(asked, client).withColumn("reply", json_text.reply(json_text.chat_content(F.col("body"))))
    wrong = F.when(F.col("error").isNull() & F.col("reply").isNull(), "no usable reply").otherwise(F.col("error"))
    lists = [json_text.list_or_null(F.col(f"reply.{c}")).alias(c) for c in ("keywords", "entities")]
    return got.select("file_id", F.col("reply.summary").alias("summary"), *lists, F.col("reply.classification").alias("classification"), wrong.alias("error"))


def embed(texts: DataFrame, client: Client, model: str, dimensions: int) -> DataFrame:
    """Embedding of each (file_id, body_text); a vector of another width is an error."""
    request = F.to_json(F.struct(F.lit(model).alias("model"), cap(F.col("body_text"), schemas.MAX_BODY_CHARS).alias("input")))
    got = call(texts.select("file_id", request.alias("request")), client).withColumn("vector", json_text.first_vector(F.col("body")))
    right = F.size("vector") == dimensions
    wrong = F.when(F.col("error").isNull() & ~F.coalesce(right, F.lit(False)), "vector of another width").otherwise(F.col("error"))
    return got.select("file_id", F.when(right, F.col("vector")).alias("embedding"), wrong.alias("error"))


def stub_chat(request: str) -> str:
    """A reply made from the words of the request alone."""
    text = json.loads(request)["messages"][-1]["content"]
    words = text.split()
    said = {"summary": " ".join(words[:8]), "keywords": sorted(set(w.lower() for w in words[:40] if len(w) > 6))[:5], "entities": [], "classification": "long" if len(words) > 300 else "short"}
    return json.dumps({"choices": [{"message": {"content": f"Here it is: {json.dumps(said)} Done."}}]})


def stub_embedding(request: str) -> str:
    """Eight numbers from a digest of the input."""
    digest = hashlib.sha256(json.loads(request)["input"].encode()).digest()
    return json.dumps({"data": [{"embedding": [b / 255 - 0.5 for b in digest[:8]]}]})
