"""Every query of the library with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import boxes, corpus, files, records, reports, text, verify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**boxes.QUERIES, **text.QUERIES, **corpus.QUERIES, **reports.QUERIES, **verify.QUERIES, **files.QUERIES, **records.QUERIES}
ORACLES: dict[str, str] = {**boxes.ORACLES, **text.ORACLES, **corpus.ORACLES, **reports.ORACLES, **verify.ORACLES, **files.ORACLES, **records.ORACLES}
