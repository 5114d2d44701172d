"""A hook for relevance models: a function over pairs of texts as a column, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[Column, Column], Column]


def pair_scorer(score: Callable[[Sequence[str], Sequence[str]], Sequence[float]], size: int = 64) -> Scorer:
    """``score(questions, texts)``, which takes ``size`` pairs at a time at most, as a function of two columns.

    Nulls are scored as empty texts. A batch whose scoring fails, or whose scores are too few or not finite, counts as
    zeros: a relevance model refines an order and must not stop it. The function is shipped to the tasks, so a model
    should be loaded there, once a worker. Where no scorer is given, operators use ``retrieval.lexical_score``.
    """

    @F.pandas_udf("double")
    def scored(questions: pd.Series, texts: pd.Series) -> pd.Series:
        q, t = questions.fillna("").tolist(), texts.fillna("").tolist()
        out: list[float] = []
        for i in range(0, len(q), size):
            try:
                got = [float(x) for x in score(q[i : i + size], t[i : i + size])]
            except Exception:
                got = []
            whole = len(got) == len(q[i : i + size])
            out += [x if x == x and abs(x) != float("inf") else 0.0 for x in got] if whole else [0.0] * len(q[i : i + size])
        return pd.Series(out, dtype="float64")

    return scored
