"""A stream of queries answered from a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexgrid.functions.analysis import analyze
from lexgrid.operators.index import Index
from lexgrid.operators.search import search


def answer_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Each micro-batch of queries (query_id, text, lang) is searched, and its results are written to path under its batch number.

    A batch that is run again replaces its own results, so each query is answered once.
    """

    def run(batch: DataFrame, number: int) -> None:
        search(index, analyze(batch), k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
