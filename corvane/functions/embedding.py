"""Feature-hash embeddings of texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+(?:[./-][a-z0-9]+)*")


def hash_embed(df: DataFrame, id_col: str, text_col: str = "text", dim: int = 768) -> DataFrame:
    """(id, embedding): unigrams and bigrams hashed by blake2b to signed coordinates, at unit length.

    Index: the first four bytes, little-endian, modulo ``dim``; sign: the low bit of the fifth. A text without
    tokens gives the zero vector. Each worker remembers the places of the features it has met, within a bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[int, float]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = np.zeros((part.num_rows, dim), np.float32)
                for row, text in enumerate(part.column(1).to_pylist()):
                    tokens = _TOKEN.findall((text or "").lower())
                    for feature in [*tokens, *map(" ".join, zip(tokens, tokens[1:]))]:
                        if feature not in places:
                            if len(places) > 500_000:
                                places.clear()
                            digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
                            places[feature] = (int.from_bytes(digest[:4], "little") % dim, 1.0 if digest[4] & 1 else -1.0)
                        at, sign = places[feature]
                        out[row, at] += sign
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "embedding"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, embedding array<float>").withColumnRenamed("id", id_col)
