"""All registered queries of the behaviour-analytics operators."""

from loomwatch.plans import detection_queries, ingest_queries, lifecycle_queries, model_queries, report_queries, sink_queries, snapshot_queries, stream_queries, windows_queries  # noqa: F401
from loomwatch.plans.registry import ORACLES, QUERIES  # noqa: F401
