"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandlake", **conf) -> SparkSession:
    """A session with adaptive execution; settings given win, those of the cluster stay."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
