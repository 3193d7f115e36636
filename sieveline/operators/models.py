"""Plug-ins for models: encoders and pair scorers over Arrow batches, and a chat client with batches and retries."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def encode(df: DataFrame, encoder: Callable[[list[str]], list[list[float]]], key: str = "doc_id") -> DataFrame:
    """key and vector; the encoder sees the texts of one batch."""

    def run(batches):
        for b in batches:
            v = encoder([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.list_(pa.float32()))], [key, "vector"])

    return df.select(key, "text").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, vector array<float>")


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """query_id, doc_id, rerank_score of pairs (query_id, doc_id, query, text)."""

    def run(batches):
        for b in batches:
            s = scorer([x or "" for x in b.column(2).to_pylist()], [x or "" for x in b.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["query_id", "doc_id", "rerank_score"])

    kinds = dict(pairs.dtypes)
    return pairs.select("query_id", "doc_id", "query", "text").mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rerank_score double")


def annotate(prompts: DataFrame, chat: Callable[[str], str], retries: int = 2, wait: float = 1.0) -> DataFrame:
    """query_id, batch, reply, error. A reply has to be JSON; after the retries the error stays with its row."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(retries + 1):
            try:
                reply = chat(prompt)
                json.loads(reply)
                return reply, None
            except Exception as x:  # noqa: BLE001  a failed call must not lose the other rows
                error = f"{type(x).__name__}: {x}"
                time.sleep(wait + attempt if attempt < retries else 0)
        return None, error

    def run(batches):
        for b in batches:
            rows = [one(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r for r, _ in rows], pa.string()), pa.array([e for _, e in rows], pa.string())], ["query_id", "batch", "reply", "error"])

    kinds = dict(prompts.dtypes)
    return prompts.select("query_id", "batch", "prompt").mapInArrow(run, f"query_id {kinds['query_id']}, batch {kinds['batch']}, reply string, error string")
