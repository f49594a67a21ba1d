"""Models and services behind the engine: language-model providers and text encoders, as callables given by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.cluster import ship
from folioforge.functions.vectors import l2_normalize

Provider = Callable[[str], str]
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def ask(requests: DataFrame, make: Callable[[], Provider], *, column: str = "request", retries: int = 2, parallel: int = 4) -> DataFrame:
    """`requests` with response and provider_error. `make` builds one client per task; at most `parallel` tasks call it.

    A call is tried 1 + retries times. A request that still fails keeps its row with the error's name: tasks do not
    fail by it. Errors named Auth... are not tried again. Turn speculative execution off where calls cost money.
    """
    ship(requests.sparkSession)
    names = requests.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            out = []
            for text in b[column]:
                answer, error = None, None
                for _ in range(1 + retries):
                    try:
                        answer, error = client(text), None
                        break
                    except Exception as e:
                        error = type(e).__name__
                        if error.startswith("Auth"):
                            break
                out.append((answer, error))
            yield b.assign(response=[a for a, _ in out], provider_error=[e for _, e in out])[[*names, "response", "provider_error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", response string, provider_error string"
    return requests.coalesce(parallel).mapInPandas(run, schema)


def embed(texts: DataFrame, make: Callable[[], Encoder], *, dimension: int, column: str = "text", batch: int = 64) -> DataFrame:
    """`texts` with vector (unit length) and embed_error: empty texts, wrong dimensions and vectors without direction."""
    ship(texts.sparkSession)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()  # once a task
        for b in batches:
            out: list = [None] * len(b)
            rows = [k for k, t in enumerate(b) if isinstance(t, str) and t.strip()]
            for s in range(0, len(rows), batch):
                some = rows[s : s + batch]
                for k, v in zip(some, encode([b.iloc[k] for k in some]), strict=True):
                    out[k] = [float(x) for x in v]
            yield pd.Series(out, index=b.index)

    raw = texts.withColumn("_raw", run(F.col(column)))
    unit = F.when(F.size("_raw") == dimension, l2_normalize(F.col("_raw")))
    error = F.when(F.col("_raw").isNull(), "EMPTY_TEXT").when(F.size("_raw") != dimension, "WRONG_DIMENSION").when(unit.isNull(), "NO_DIRECTION")
    return raw.withColumn("vector", unit).withColumn("embed_error", error).drop("_raw")
