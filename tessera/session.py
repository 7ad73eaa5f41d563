"""Session builder used by tests and the bench; a cluster brings its own session."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def within(spark: SparkSession, seconds: float, work: Callable[[], Any]) -> Any:
    """What work gives; its jobs are cancelled when the time is over, which raises."""
    context, group, over = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "within a deadline", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as fault:
        if over.is_set():
            raise TimeoutError(f"not done within {seconds} seconds") from fault
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
