"""Tabulation of a stream of aligned sites: pattern sums are additive, so a streaming aggregate keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sitefold.functions.patterns import pattern_sums


def stream_patterns(sites: DataFrame, frequencies: list[str], name: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Keeps the memory table ``name`` of pattern sums (by key) up to date while sites arrive. The table is on the driver: it has a row
    for each pattern of a key, so keys have to be few; what the query aggregates, of however many sites, is on the executors."""
    sums = pattern_sums(sites, frequencies, singletons=True, by=by)
    return sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
