"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Everything here can be overridden by the cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "cellcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: str | int = 8, app: str = "cellcast-local", **conf: str) -> SparkSession:
    """Single-machine session for tests and ``bench.py``."""
    local = {
        "spark__driver__bindAddress": "127.0.0.1",
        "spark__driver__host": "127.0.0.1",
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__sql__shuffle__partitions": str(cores),
        "spark__driver__memory": "8g",
    }
    return session(app, f"local[{cores}]", **(local | conf))
