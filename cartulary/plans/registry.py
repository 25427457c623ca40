"""Named queries and the DuckDB SQL that they must equal."""

from __future__ import annotations

from cartulary.plans import artifact_queries, batch_queries, graph_queries, ingest_queries, item_queries, note_queries, paged_queries, rank_queries, recall_queries, report_queries, service_queries, source_queries, state_queries, stream_queries, synthesis_queries, text_queries, topic_queries, turn_queries, vector_queries  # noqa: F401
from cartulary.plans.base import ORACLES, QUERIES

FLAGSHIP = "keyword_card_topk"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
