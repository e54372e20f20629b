"""The last schema of each source dataset, so that drift is seen from one execution to the next."""

from __future__ import annotations

import json
import threading
from urllib.parse import quote

from pyspark.sql import SparkSession

from tidegate import fs

Fields = list[tuple[str, str]]


class Schemas:
    """Kept by this process."""

    def __init__(self, known: dict[str, Fields] | None = None):
        self._known = dict(known or {})

    def get(self, dataset: str) -> Fields | None:
        return self._known.get(dataset)

    def put(self, dataset: str, fields: Fields) -> None:
        self._known[dataset] = fields


class StoredSchemas:
    """Kept in one small file per dataset, for every process that uses the storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path.rstrip("/"), threading.Lock()

    def _at(self, dataset: str) -> str:
        return f"{self.path}/{quote(dataset, safe='')}.json"

    def get(self, dataset: str) -> Fields | None:
        at = self._at(dataset)
        return [tuple(f) for f in json.loads(fs.read_text(self.spark, at))] if fs.exists(self.spark, at) else None

    def put(self, dataset: str, fields: Fields) -> None:
        with self._lock:
            if self.get(dataset) != [tuple(f) for f in fields]:
                fs.write_text(self.spark, self._at(dataset), json.dumps(fields))
