"""Text encoders: whatever turns a batch of texts into vectors plugs in here, once per worker."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType


class Encoder(Protocol):
    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """A row per text."""


def identity(make: Callable[[], Encoder] | None) -> str | None:
    """What tells an encoder from others, for an index that depends on it: its maker's ``identity``, such as a model's name and version, or else the maker's own name with its arguments."""
    if make is None or getattr(make, "identity", None):
        return make and str(make.identity)
    if isinstance(make, functools.partial):
        return f"{identity(make.func)}{make.args}{sorted(make.keywords.items())}"
    return f"{make.__module__}.{make.__qualname__}"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm == 0, 1, norm)).astype(np.float32)


def encode_single(encoder: Encoder, text: str) -> np.ndarray:
    return unit(np.asarray(encoder.encode([text])))[0]


def encode(rows: DataFrame, make: Callable[[], Encoder], text: str = "text", out: str = "vector", batch: int = 32) -> DataFrame:
    """Adds unit vectors of ``text``, ``batch`` texts at a time; null counts as empty. ``make`` is called in every task, so a model should be cached by it."""

    def run(batches: Iterable[pa.RecordBatch]):
        encoder = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(list(unit(np.asarray(encoder.encode(texts), np.float64))), pa.list_(pa.float32()))], names=[*part.schema.names, out])

    rows = rows.withColumn(text, F.col(text).cast("string"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(FloatType()))]))
