"""What an execution has finished, so that a resumed one need not do it again."""

from __future__ import annotations

import json
import threading
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import SparkSession

from tidegate import fs


@dataclass(frozen=True)
class StepCheckpoint:
    execution_id: str
    step_id: str
    completed_at: str
    output: str | None = None
    location: str | None = None
    rows: int | None = None
    schema_json: str | None = None


class CheckpointManager(Protocol):
    def save(self, checkpoint: StepCheckpoint) -> None: ...
    def find(self, execution_id: str, step_id: str) -> StepCheckpoint | None: ...
    def exists(self, execution_id: str, step_id: str) -> bool: ...
    def find_all(self, execution_id: str) -> list[StepCheckpoint]: ...
    def delete_all(self, execution_id: str) -> None: ...


class NoCheckpoints:
    """Remembers nothing."""

    def save(self, checkpoint: StepCheckpoint) -> None: ...

    def find(self, execution_id: str, step_id: str) -> None:
        return None

    def exists(self, execution_id: str, step_id: str) -> bool:
        return False

    def find_all(self, execution_id: str) -> list[StepCheckpoint]:
        return []

    def delete_all(self, execution_id: str) -> None: ...


class MemoryCheckpoints:
    """Kept in the driver; saving twice replaces."""

    def __init__(self):
        self._kept: dict[str, dict[str, StepCheckpoint]] = {}
        self._lock = threading.Lock()

    def save(self, checkpoint: StepCheckpoint) -> None:
        with self._lock:
            self._kept.setdefault(checkpoint.execution_id, {})[checkpoint.step_id] = checkpoint

    def find(self, execution_id: str, step_id: str) -> StepCheckpoint | None:
        return self._kept.get(execution_id, {}).get(step_id)

    def exists(self, execution_id: str, step_id: str) -> bool:
        return self.find(execution_id, step_id) is not None

    def find_all(self, execution_id: str) -> list[StepCheckpoint]:
        return sorted(self._kept.get(execution_id, {}).values(), key=lambda c: (c.completed_at, c.step_id))

    def delete_all(self, execution_id: str) -> None:
        with self._lock:
            self._kept.pop(execution_id, None)


class FileCheckpoints:
    """One JSON file per step in the cluster's file system, replaced by renaming."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, execution_id: str, step_id: str) -> str:
        return f"{self.path}/{execution_id}/{step_id}.json"

    def save(self, checkpoint: StepCheckpoint) -> None:
        fs.write_text(self.spark, self._at(checkpoint.execution_id, checkpoint.step_id), json.dumps(asdict(checkpoint)))

    def find(self, execution_id: str, step_id: str) -> StepCheckpoint | None:
        at = self._at(execution_id, step_id)
        return StepCheckpoint(**json.loads(fs.read_text(self.spark, at))) if fs.exists(self.spark, at) else None

    def exists(self, execution_id: str, step_id: str) -> bool:
        return fs.exists(self.spark, self._at(execution_id, step_id))

    def find_all(self, execution_id: str) -> list[StepCheckpoint]:
        names = [n for n in fs.children(self.spark, f"{self.path}/{execution_id}") if n.endswith(".json")]
        found = [self.find(execution_id, n.removesuffix(".json")) for n in names]
        return sorted((c for c in found if c), key=lambda c: (c.completed_at, c.step_id))

    def delete_all(self, execution_id: str) -> None:
        fs.delete(self.spark, f"{self.path}/{execution_id}")


