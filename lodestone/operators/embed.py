"""Embedding texts in batches: by an ONNX model where one is given, else by a vector made of the text's hash."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import MAX_TOKENS, TOKEN_IDS, VECTOR_DIM, embedding_input, placeholder_embedding

BATCH = 32


def model_file(folder: str | None) -> str | None:
    """The model in a folder, the quantised one first; None if there is none."""
    for name in ("model_quantized.onnx", "model_int8.onnx", "model.onnx"):
        if folder and os.path.isfile(os.path.join(folder, name)):
            return os.path.join(folder, name)
    return None


def naive_ids(text: str) -> list[int]:
    out = []
    for w in text.lower().split()[:MAX_TOKENS]:
        h = 0
        for c in w:
            h = (h * 31 + ord(c)) & 0xFFFF
        out.append(h % TOKEN_IDS)
    return out


def mean_pool(tokens: np.ndarray) -> np.ndarray:
    """The mean of a (tokens, dim) array, scaled to unit length."""
    v = tokens.mean(axis=0)
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def embedded(ids: list, run, size: int = BATCH) -> list:
    """run over batches of `size`; a batch that fails is tried again one by one, so that one text doesn't spoil the others."""
    out = []
    for a in range(0, len(ids), size):
        part = ids[a : a + size]
        try:
            out += run(part)
        except Exception:  # noqa: BLE001 - a model may fail on one text in many ways
            if len(part) == 1:
                raise
            for x in part:
                out += run([x])
    return out


def model_udf(folder: str):
    """An iterator UDF that loads the model once a worker and answers in batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        session = ort.InferenceSession(model_file(folder), options)
        names = {i.name for i in session.get_inputs()}

        def run(ids: list[list[int]]) -> list[np.ndarray]:
            """The vectors of some token lists at once; shorter ones are filled up and masked."""
            longest = max(map(len, ids))
            tokens = np.array([x + [0] * (longest - len(x)) for x in ids], dtype=np.int64)
            mask = np.array([[1] * len(x) + [0] * (longest - len(x)) for x in ids], dtype=np.int64)
            feed = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
            y = session.run(None, {k: v for k, v in feed.items() if k in names})[0]
            return [mean_pool(row[: len(x)]) for row, x in zip(y, ids)]

        for texts in batches:
            ids = [naive_ids(t or "") or [0] for t in texts]
            out = embedded(ids, run)
            yield pd.Series([v.astype(np.float32).tolist() for v in out])

    return embed


def embed_column(text: Column, folder: str | None = None, dim: int = VECTOR_DIM) -> Column:
    if model_file(folder):
        return model_udf(folder)(text)
    return placeholder_embedding(text, dim).cast("array<float>")


def embed_chunks(chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """chunks (with signature, content) and their `vector`."""
    return chunks.withColumn("vector", embed_column(embedding_input(F.coalesce("signature", F.lit("")), F.coalesce("content", F.lit(""))), folder))


def embed_text(spark, text: str, folder: str | None = None) -> list[float]:
    """One text's vector, for a query."""
    row = spark.range(1).select(embed_column(F.lit(text), folder).alias("v")).first()
    return list(row["v"])
