"""docweave: document retrieval and summary operators as Spark DataFrame jobs.

Every public operator takes and returns DataFrames (or Columns, in
``docweave.functions``).  Nothing is collected to the driver; per-document work
runs row-wise inside executors and cross-document work goes through Spark
joins, aggregations and windows so Catalyst and AQE can plan it.
"""

from docweave.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
