"""Judgements by a callable (a model, a service, a person's rules), row by row or in batches.

The callable is injected; tests use a stub, and nothing here opens a network
connection. A judgement that fails is retried, and then the row is kept and
marked: screening never drops a record because a service was down.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def judge(rows: DataFrame, ask: Callable[[dict], str], columns: list[str], attempts: int = 3, wait: float = 3.0, parallel: int | None = None) -> DataFrame:
    """Rows with the answer and whether asking failed. parallel bounds how many tasks ask at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, failed = [], []
            for row in batch[columns].to_dict("records"):
                answer = None
                for attempt in range(attempts):
                    try:
                        answer = ask(row)
                        break
                    except Exception:  # noqa: BLE001 - any failure of the service counts
                        if attempt + 1 < attempts:
                            time.sleep(wait)
                answers.append(answer)
                failed.append(answer is None)
            yield batch.assign(answer=answers, failed=failed)

    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("failed", T.BooleanType())])
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, schema)


def batched(rows: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str, size: int = 30, parallel: int = 8, attempts: int = 2) -> DataFrame:
    """Rows handed to a worker in batches of at most `size`, `parallel` at once; a failed batch is tried again, then raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size].to_dict("records")
                for attempt in range(attempts):
                    try:
                        yield pd.DataFrame(work(part))
                        break
                    except Exception:
                        if attempt + 1 == attempts:
                            raise

    return rows.repartition(parallel).mapInPandas(run, schema)
