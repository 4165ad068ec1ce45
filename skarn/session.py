"""Sessions: the Spark session, the data folder and its lock, logging and memory settings."""

from __future__ import annotations

import json
import os
import shutil
import socket
from enum import Enum

from pyspark.sql import SparkSession


class LogLevel(Enum):
    DEBUG = "DEBUG"
    INFO = "INFO"
    WARN = "WARN"
    ERROR = "ERROR"
    OFF = "OFF"

    @classmethod
    def parse(cls, value: LogLevel | str) -> LogLevel:
        """A level, or its name in any case."""
        if isinstance(value, cls):
            return value
        name = str(value).upper()
        name = {"WARNING": "WARN"}.get(name, name)
        if name not in cls.__members__:
            raise ValueError(f"unknown log level: {value}")
        return cls[name]


def spark_session(cores: int | str = "*", shuffle_partitions: int | None = None, name: str = "skarn", **conf: str) -> SparkSession:
    """A local session with the settings that the engine wants; on a cluster, use the session given there."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


class Workspace:
    """An open data folder. One process holds it at a time; its lock file names the holder and its host. A lock of
    this host whose process has ended is taken over; one of another host is not.

    The folder may be on any file system that the driver can write to; tables in it are Parquet.
    """

    LOCK = "_lock.json"

    def __init__(self, spark: SparkSession, data_dir: str, cleanup_if_exist: bool = False) -> None:
        self.spark, self.data_dir = spark, os.path.abspath(data_dir)
        self._level = LogLevel.WARN
        os.makedirs(self.data_dir, exist_ok=True)
        self._take_lock()
        if cleanup_if_exist:
            for entry in os.listdir(self.data_dir):
                if entry != self.LOCK:
                    at = os.path.join(self.data_dir, entry)
                    shutil.rmtree(at) if os.path.isdir(at) else os.remove(at)
        self.is_open = True

    def _take_lock(self) -> None:
        at = os.path.join(self.data_dir, self.LOCK)
        while True:
            try:
                with open(at, "x") as f:
                    json.dump({"pid": os.getpid(), "host": socket.gethostname()}, f)
                return
            except FileExistsError:
                try:
                    with open(at) as f:
                        held = json.load(f)
                    pid, host = held["pid"], held.get("host")
                except (ValueError, KeyError, FileNotFoundError):
                    pid, host = None, None
                if host is not None and host != socket.gethostname():
                    raise RuntimeError(f"data folder is in use by process {pid} of {host}, which can't be checked from here; remove {at} if it has ended") from None
                if pid is not None and os.path.exists(f"/proc/{pid}"):
                    raise RuntimeError(f"data folder is in use by process {pid}: {self.data_dir}") from None
                try:
                    os.remove(at)  # its holder ended without closing
                except FileNotFoundError:
                    pass

    def path(self, *parts: str) -> str:
        return os.path.join(self.data_dir, *parts)

    def close(self) -> None:
        """Give the folder free. Every write is durable when its call returns, so nothing is left to flush."""
        if self.is_open:
            self.is_open = False
            os.remove(self.path(self.LOCK))

    def flush_storage(self) -> None:
        """A barrier only: Parquet commits are durable as they return."""
        self._check()

    def force_evict_buffer_portion(self, portion: float = 0.5) -> None:
        """Drop cached tables. Spark evicts blocks by itself, so any positive portion clears all."""
        if not 0 <= portion <= 1:
            raise ValueError("portion must lie between 0 and 1")
        if portion:
            self.spark.catalog.clearCache()

    def set_log_level(self, level: LogLevel | str) -> None:
        self._level = LogLevel.parse(level)
        self.spark.sparkContext.setLogLevel(self._level.value)

    def get_log_level(self) -> LogLevel:
        return self._level

    def _check(self) -> None:
        if not self.is_open:
            raise RuntimeError("the workspace is closed")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def buffer_config(size_gb: float, virtual_gb: float = 24) -> dict[str, str]:
    """The Spark settings for a pool of size_gb. They count when a session starts: give them to spark_session()."""
    if size_gb <= 0 or virtual_gb < size_gb:
        raise ValueError("sizes must be positive, and the virtual size the larger one")
    mb = int(size_gb * 1024)
    return {"spark.driver.memory": f"{mb}m", "spark.executor.memory": f"{mb}m", "spark.memory.fraction": "0.6"}
