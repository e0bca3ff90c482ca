"""Calls of a text model over prompts, and the parsing of its replies."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import json_value, strip_fence

Client = Callable[[Sequence[str]], Sequence[str]]


def rule_stub(prompts: Sequence[str]) -> list[str]:
    """A client without a model: a fenced JSON reply that depends on the prompt's length only."""
    return ["```json\n" + json.dumps({"risk_score": len(p) % 100 / 100, "justification": f"{len(p)} characters", "summary": p[:40], "priority": "HIGH" if len(p) % 2 else "LOW"}) + "\n```" for p in prompts]


def enrich_with_model(df: DataFrame, prompt_col: str, client: Client = rule_stub, *, out_col: str = "model_reply", batch_size: int = 64) -> DataFrame:
    """df with the client's reply to each prompt. Each distinct prompt is sent once, in batches; NULL prompts get NULL."""

    def ask(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in them:
            for lo in range(0, len(frame), batch_size):
                part = frame.iloc[lo : lo + batch_size]
                yield pd.DataFrame({"_prompt": part["_prompt"], out_col: list(client(part["_prompt"].tolist()))})

    asked = df.select(F.col(prompt_col).alias("_prompt")).where("_prompt IS NOT NULL").distinct()
    replies = asked.mapInPandas(ask, f"_prompt string, `{out_col}` string")
    return df.join(replies, df[prompt_col] == replies["_prompt"], "left").drop("_prompt")


def _asked(client: Client, prompts: list[str], retries: int) -> tuple[list[str | None], list[str | None]]:
    """Replies and errors of one batch; if the batch fails, each of its prompts is asked alone, up to `retries` times."""
    try:
        replies = list(client(prompts))
        if len(replies) == len(prompts):
            return replies, [None] * len(prompts)
        error = f"{len(replies)} replies to {len(prompts)} prompts"
    except Exception as e:  # noqa: BLE001  a client may fail in any way, and no row may be lost by it
        error = f"{type(e).__name__}: {e}"
    if len(prompts) > 1:
        alone = [_asked(client, [p], retries) for p in prompts]
        return [r for rs, _ in alone for r in rs], [e for _, es in alone for e in es]
    return _asked(client, prompts, retries - 1) if retries > 0 else ([None], [error])


def stored_replies(df: DataFrame, prompt_col: str, client: Client = rule_stub, *, store: str, out_col: str = "model_reply", error_col: str = "model_error", batch_size: int = 64, retries: int = 1) -> DataFrame:
    """df with the client's reply to each prompt, kept in a table of replies in the folder `store`.

    Only distinct prompts that the table has no reply to are sent; their replies are written before they are used, so that no later action, rerun or restarted stream (call it in
    foreachBatch) asks them again. A prompt whose call fails, alone too, has a NULL reply and its error in error_col, loses no row, and
    is asked again by the next call. NULL prompts get NULL. One writer at a time: two might both ask the same prompt (each prompt still has one reply here, the first in order).
    """
    spark = df.sparkSession
    schema = "prompt_hash string, prompt string, reply string, error string, run string"
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(store)  # the table is there from the first call on
    table = spark.read.schema(schema).parquet(store)

    def ask(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in them:
            for lo in range(0, len(frame), batch_size):
                part = frame.iloc[lo : lo + batch_size]
                replies, errors = _asked(client, part["prompt"].tolist(), retries)
                yield part.assign(reply=replies, error=errors)

    run, hashed = uuid.uuid4().hex, F.sha2(F.col("prompt"), 256).alias("prompt_hash")
    wanted = df.select(F.col(prompt_col).cast("string").alias("prompt")).where("prompt IS NOT NULL").distinct().select(hashed, "prompt")
    new = wanted.join(table.where("reply IS NOT NULL").select("prompt_hash"), "prompt_hash", "leftanti")
    new.mapInPandas(ask, "prompt_hash string, prompt string, reply string, error string").withColumn("run", F.lit(run)).write.mode("append").parquet(store)
    table = spark.read.schema(schema).parquet(store)
    known = table.where((F.col("run") == run) | F.col("reply").isNotNull()).groupBy(F.col("prompt_hash").alias("_prompt_hash")).agg(F.min("reply").alias(out_col), F.max("error").alias("_error"))
    out = df.join(known, F.sha2(F.col(prompt_col).cast("string"), 256) == F.col("_prompt_hash"), "left")
    return out.withColumn(error_col, F.when(F.col(out_col).isNull(), F.col("_error"))).drop("_prompt_hash", "_error")


def parse_model_reply(df: DataFrame, col: str, fields: Sequence[str]) -> DataFrame:
    """df with each field of the reply's JSON object as a string column; NULL if the reply isn't JSON."""
    body = strip_fence(F.col(col))
    return df.select("*", *[json_value(body, f"$.{name}").alias(name) for name in fields])
