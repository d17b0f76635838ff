"""Extension point that needs Python workers: custom embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def batch_embedder(load: Callable[[], Callable[[list[str]], object]]):
    """Column function for a model that embeds a list of texts into a 2-D float array.

    `load` runs once per Python worker; batches arrive through Arrow.
    """
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return embed
