"""All queries of this folder and of the pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidepoint.llm import (  # noqa: F401
    centroids, decontaminate, exact_dedup, line_dedup, line_quality, mixing, near_dedup, passages, phrases, ring, secret_ledger, token_rollup,
    warc,
)
from tidepoint.llm.catalog import ORACLES, QUERIES


def all_queries() -> dict:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def all_oracles() -> dict:
    return {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
