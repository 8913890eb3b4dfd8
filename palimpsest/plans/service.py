"""The service surface as functions over tables of requests: health, engine info, and comparisons by each engine. No web server is part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..session import stored
from ..sources import readers as RD
from . import compare as C

NAME = "palimpsest"


def health() -> dict[str, str]:
    return {"status": "ok", "service": NAME, "version": __version__}


def engine_info(spark: SparkSession) -> dict[str, str]:
    return {"compare_engine": C.engine_version(spark)[0]}


def accepted(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (pair_id and both sides' contents, under either name) that are two PDF files, and the answers to all others (pair_id, status, reason)."""
    checked = stored(RD.validate_pairs(requests), "requests")
    return checked.filter("status = 200"), checked.filter("status <> 200").select("pair_id", "status", "reason")


def compare_documents(spark: SparkSession, pairs: DataFrame, units: DataFrame, words: DataFrame) -> dict[str, DataFrame]:
    """The session's engine: v1 over units, v2 over words."""
    engine = C.engine_version(spark)[0]
    return C.compare(spark, pairs, units if engine == "v1" else words, engine)


def compare_clauses(pairs: DataFrame, pages: DataFrame, debug: bool = False) -> dict[str, DataFrame]:
    """The v3 comparison; debug tables only where they are asked for."""
    out = C.compare_v3(pairs, pages)
    return out if debug else {k: v for k, v in out.items() if not k.startswith("debug")}


def answers(result: DataFrame) -> DataFrame:
    """A v1 result with the HTTP status of each pair."""
    return result.withColumn("http_status", C.http_status(F.col("status")))
