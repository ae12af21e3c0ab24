"""Session settings that the engine relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster: install it or pass --py-files)."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def build_session(name: str = "loamline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode and adaptive execution; other settings are the caller's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return with_package(builder.config(map=defaults | conf).getOrCreate())
