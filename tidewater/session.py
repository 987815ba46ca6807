"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC throughout; adaptive execution sizes shuffles and splits skewed joins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidewater", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments override (dots as double underscores)."""
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files: under ``spark.checkpoint.dir``, or a temporary one in local mode."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewater-scratch-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
