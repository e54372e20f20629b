"""What a connector is, and the registry that finds it."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from tidegate.errors import ConnectorError


class Config(dict):
    """A step's ``config`` with typed access."""

    def text(self, key: str, default: str | None = None) -> str | None:
        v = self.get(key)
        return default if v is None else str(v)

    def whole(self, key: str, default: int) -> int:
        v = self.get(key)
        try:
            return default if v is None else int(str(v).strip())
        except ValueError:
            raise ConnectorError(f"{key} is no whole number: {v}") from None

    def flag(self, key: str, default: bool) -> bool:
        v = self.get(key)
        return default if v is None else v if isinstance(v, bool) else str(v).strip().lower() == "true"

    def need(self, key: str) -> str:
        v = self.text(key)
        if v is None or not v.strip():
            raise ConnectorError(f"the setting '{key}' is missing")
        return v

    def names(self, key: str) -> list[str]:
        """A list, or a text of names with commas between."""
        v = self.get(key)
        if v is None:
            return []
        return [str(x) for x in v] if isinstance(v, (list, tuple)) else [x.strip() for x in str(v).split(",") if x.strip()]


@dataclass(frozen=True)
class Health:
    connector: str
    ok: bool
    latency_ms: float = -1
    reason: str = ""


@dataclass(frozen=True)
class WriteResult:
    written: int
    rejected: int
    destination: str
    duration_ms: float = 0.0

    @property
    def success(self) -> bool:
        return self.rejected == 0


@dataclass
class ReadContext:
    """What reading and writing may need besides the settings."""

    spark: SparkSession
    execution_id: str = "none"
    params: dict[str, Any] = field(default_factory=dict)


class Connector(Protocol):
    type: str

    def read(self, ctx: ReadContext, config: Config) -> DataFrame: ...
    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult: ...
    def health(self, ctx: ReadContext, config: Config) -> Health: ...


class BaseConnector:
    """Refuses what a connector does not offer."""

    type = "none"

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        raise ConnectorError(f"connector {self.type} does not read")

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        raise ConnectorError(f"connector {self.type} does not write")

    def health(self, ctx: ReadContext, config: Config) -> Health:
        return Health(self.type, True, 0.0)


class Registry:
    """Connectors by type, whatever its case; the last one registered counts."""

    def __init__(self, connectors: list[Connector] | None = None):
        self._by_type: dict[str, Connector] = {}
        for c in connectors or ():
            self.register(c)

    def register(self, connector: Connector) -> None:
        self._by_type[connector.type.lower()] = connector

    def get(self, kind: str | None) -> Connector | None:
        return self._by_type.get((kind or "").lower())

    def need(self, kind: str | None) -> Connector:
        found = self.get(kind)
        if found is None:
            raise ConnectorError(f"no connector '{kind}'; there are: {', '.join(sorted(self._by_type)) or 'none'}")
        return found

    def all(self) -> dict[str, Connector]:
        return dict(self._by_type)


def stem(path: str | None) -> str:
    return Path(path).stem if path else "unknown"


def counted(df: DataFrame, write) -> int:
    """Run ``write(df)`` and count the rows as they pass, without a second read."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])
