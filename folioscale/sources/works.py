"""Works of a bibliographic service, read page by page with a cursor.

The service is a callable, since the library opens no connection of its own:
fetch(params) takes a filter, a search text, a page size and a cursor, and
gives {"results": [...], "next_cursor": ... or None}.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Works on a page at most, and sources that one request names.
PAGE, SOURCES = 200, 50
WORK = "source_id string, work_id string, title string, published string, doi string"


def pages(fetch: Callable[[dict], dict], params: dict) -> Iterator[dict]:
    """All results of a request, following the cursor until there is none or a page is empty."""
    cursor: str | None = "*"
    while cursor:
        answer = fetch({**params, "cursor": cursor})
        yield from answer.get("results", [])
        cursor = answer.get("next_cursor") if answer.get("results") else None


def read_works(spark: SparkSession, fetch: Callable[[dict], dict], source_ids: list[str], from_date: str, search: str | None = None, page: int = PAGE, parallel: int = 4) -> DataFrame:
    """Works of the sources since a date, a request for up to SOURCES of them, `parallel` requests at once; a work found twice counts once."""
    if not 1 <= page <= PAGE:
        raise ValueError(f"a page has 1 to {PAGE} works")
    ids = sorted({source for source in source_ids if source})
    requests = [{"filter": f"primary_location.source.id:{'|'.join(ids[i : i + SOURCES])},from_publication_date:{from_date}", "search": search, "per-page": page} for i in range(0, len(ids), SOURCES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for request in batch["request"]:
                rows = [(work.get("source_id"), work.get("id"), work.get("title"), work.get("publication_date"), work.get("doi")) for work in pages(fetch, json.loads(request))]
                yield pd.DataFrame(rows, columns=[part.split()[0] for part in WORK.split(", ")])

    asked = spark.createDataFrame([(json.dumps(request),) for request in requests], "request string").repartition(max(1, parallel))
    return asked.mapInPandas(run, WORK).dropDuplicates(["work_id"])
