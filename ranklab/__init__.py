"""ranklab: event-results analytics on Spark.

Silver/gold feature tables, standings, head-to-head, forecasting, prediction
scoring and a prediction ledger, all expressed as DataFrame / Spark SQL /
Spark ML / Structured Streaming jobs that work on every event at once.
"""

from ranklab.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
