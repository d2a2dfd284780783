"""All named queries."""

from __future__ import annotations

from trackloom.plans import archive_queries, cloud_queries, contract_queries, header_queries, manifest_queries, mask_queries, metric_queries, sequence_queries, source_queries, track_queries  # noqa: F401
from trackloom.plans.spec import REGISTRY, Query


def catalogue() -> dict[str, Query]:
    return dict(REGISTRY)
