"""XPath over streams of documents: documents don't depend on each other, so nothing is kept
between batches. One expression is evaluated where each document lies; several, or any
operator over nodes, get each micro-batch shredded like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from xqengine.api import compile_xpath
from xqengine.operators.shred import shred
from xqengine.plans.interpret import per_document


def stream_values(docs: DataFrame, xpath: str, *, mode: str = "PERMISSIVE") -> DataFrame:
    """A streaming frame of an expression's rows; see ``per_document``."""
    return per_document(docs, xpath, mode=mode)


def stream_query(docs: DataFrame, xpath: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer for a streaming (doc_id, content) frame; ``sink`` gets each batch's string
    values. Start it with the trigger and checkpoint of your choice."""
    compiled = compile_xpath(xpath)  # a bad expression fails before the stream starts

    def each(batch: DataFrame, number: int) -> None:
        corpus = shred(batch).persist()
        try:
            if compiled.kind == "nodeset":
                sink(compiled.string_values(corpus), number)
            else:
                sink(compiled.evaluate(corpus), number)
        finally:
            corpus.unpersist()

    return docs.writeStream.foreachBatch(each)
