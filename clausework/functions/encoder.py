"""Text vectors from an injected model; the engine brings none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that the model sees at once.
BATCH = 8
Encoder = Callable[[list[str]], np.ndarray]


def with_embeddings(df: DataFrame, load: Callable[[], Encoder], text: str = "text", batch: int = BATCH) -> DataFrame:
    """df with `embedding`: vectors of unit length.

    load() is called once in each Python worker and returns the model; a model
    that can't be loaded there fails the job and isn't replaced by another.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                v = np.asarray(model(texts.iloc[at : at + batch].fillna("").tolist()), np.float32)
                out += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn("embedding", embed(F.col(text)))
