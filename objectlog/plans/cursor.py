"""Results that stay on the server under a short name: lazy DataFrames, so that filters on filters become one plan."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame

from ..log import ObjectLog
from ..sources.staging import version


@dataclass
class Cursor:
    """A named result."""

    cursor_id: str
    tool_name: str
    rows: DataFrame
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    cached: bool = False


class Cursors:
    """A registry of results, safe to share between threads."""

    def __init__(self) -> None:
        self._lock, self._held = threading.Lock(), {}

    def put(self, tool_name: str, rows: DataFrame, cache: bool = False) -> str:
        """Keep a result; ``cache`` also keeps its rows on the executors."""
        cursor = Cursor(uuid.uuid4().hex[:12], tool_name, rows.cache() if cache else rows, cached=cache)
        with self._lock:
            self._held[cursor.cursor_id] = cursor
        return cursor.cursor_id

    def get(self, cursor_id: str) -> DataFrame:
        """The rows of a result; KeyError with the known names if there is none."""
        with self._lock:
            if cursor_id not in self._held:
                raise KeyError(f"no cursor {cursor_id!r}; there are {sorted(self._held)}")
            return self._held[cursor_id].rows

    def clear(self, cursor_id: str | None = None) -> None:
        """Forget one result or all."""
        with self._lock:
            for key in [cursor_id] if cursor_id else list(self._held):
                gone = self._held.pop(key, None)
                if gone and gone.cached:
                    gone.rows.unpersist()

    def __len__(self) -> int:
        return len(self._held)


class Models:
    """Discovered models by log and name, the ones used last; safe to share between threads.

    A log is told by its tables' versions, so the same files read again give the same model; another log, or the same one
    after an insert, does not.
    """

    def __init__(self, most: int = 32):
        self.most, self._lock, self._held = most, threading.Lock(), OrderedDict()

    def get(self, log: ObjectLog, name: str, make: Callable[[], Any]) -> Any:
        """The model, made if it isn't held."""
        key = (log.spark.sparkContext.applicationId, *map(version, (log.events, log.objects, log.e2o)), name)
        with self._lock:
            if key in self._held:
                self._held.move_to_end(key)
                return self._held[key]
        made = make()
        with self._lock:
            self._held[key] = made
            while len(self._held) > self.most:
                self._held.popitem(last=False)
        return made

    def __len__(self) -> int:
        return len(self._held)
