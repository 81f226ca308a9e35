"""Monitors as streaming queries: checks run for every micro-batch, handlers get the
alerts, an emergency suspends, and an error makes the monitor wait longer.

A micro-batch that fails is run again with its number: its alerts take the place of those
that it wrote before, and a handler that has had them isn't called again."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import alerts
from ..sources import documents


class Monitor:
    """Checks values (alert_type, ts, value) of a stream against rules. `start` and `stop`
    may be called again and again; stored alerts are a table in `folder`, a part for each
    micro-batch (`batch`), beside marks of the handlers that are done with it."""

    def __init__(self, stream: DataFrame, rules: DataFrame, folder: str, seconds: int = 30):
        self.stream, self.rules, self.folder, self.seconds = stream, rules, folder.rstrip("/"), seconds
        self.handlers: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.suspension: Callable[[DataFrame], None] | None = None
        self.query, self.errors, self.suspended, self._stopped = None, 0, False, threading.Event()

    def handle(self, alert_type: str, handler: Callable[[DataFrame], None]) -> None:
        """Call the handler with a batch's alerts of a type."""
        self.handlers.setdefault(alert_type, []).append(handler)

    def _once(self, mark: str, act: Callable[[], None]) -> None:
        """Act, unless it was done for this batch before."""
        path = f"{self.folder}/handled/{mark}"
        if not documents.exists(self.stream.sparkSession, path):
            act()
            documents.touch(self.stream.sparkSession, path)

    def check(self, batch: DataFrame, number: int) -> None:
        spark, path = self.stream.sparkSession, f"{self.folder}/alerts/batch={number}"
        try:
            alerts.check(batch, self.rules).write.mode("overwrite").parquet(path)
            found = spark.read.schema(alerts.FOUND).parquet(path)
            for kind, handlers in self.handlers.items():
                own = found.filter(found["alert_type"] == kind)
                for i, handler in enumerate(handlers):
                    self._once(f"{number}-{kind}-{i}", lambda h=handler, o=own: h(o))
            urgent = found.filter("suspends")
            if not self.suspended and not urgent.isEmpty():
                if self.suspension:
                    self._once(f"{number}-suspension", lambda: self.suspension(urgent))
                self.suspended = True
            self.errors = 0
        except Exception:
            self.errors += 1
            if self.seconds:
                self._stopped.wait(min(self.seconds * 2**self.errors, 300))
            raise

    def start(self, once: bool = False):
        """Run until stopped, or over what is there."""
        if self.query is None or not self.query.isActive:
            self._stopped.clear()
            writer = self.stream.writeStream.foreachBatch(self.check).option("checkpointLocation", f"{self.folder}/checkpoint")
            writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{self.seconds} seconds")
            self.query = writer.start()
        return self.query

    def stop(self) -> None:
        self._stopped.set()  # no more waiting
        if self.query is not None and self.query.isActive:
            self.query.stop()


def console(found: DataFrame) -> None:
    """A handler that prints, at most a hundred alerts a batch."""
    for r in found.select("level", "alert_type", "value", "threshold").limit(100).collect():
        print(f"[{r['level']}] {r['alert_type']}: {r['value']} >= {r['threshold']}")
