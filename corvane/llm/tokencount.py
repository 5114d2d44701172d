"""Token counts from pre-token frequencies, without materialising ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.pretokens import BYTE_PATTERN, pretoken_table
from corvane.llm.runtime import utf8


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_bytes, n_tokens, over_limit), one row per row, of whole texts.

    Each text becomes the frequencies of its distinct pre-tokens. They are joined to the table of piece counts,
    made once per distinct pre-token that a worker meets, and a text's count is the sum of frequency times
    pieces; no ids are made. That join stays in the task: frequencies shuffled by pre-token would take several
    times the input on disk. Texts of any script and with a special token's string go this way. A null text counts
    as empty: no bytes, no tokens. An empty table gives an empty result; row order and other columns have no effect.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pretoken_table(vocabulary, BYTE_PATTERN, str, len)
        for batch in batches:
            n_bytes = np.diff(utf8(batch.column(1))[1])
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(1)):
                frequencies = Counter(pieces.split(text.as_py() or ""))
                n_tokens[row] = sum(n * pieces[pretoken] for pretoken, n in frequencies.items())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
