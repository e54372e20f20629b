"""Settings of the engine and values in settings of steps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime
from typing import Any

from tidegate.errors import DefinitionError


@dataclass(frozen=True)
class EngineConfig:
    """``checkpoint``: ``shared`` stores outputs that several steps read, ``all`` every output, ``none`` only those that ask for it."""

    max_concurrent_pipelines: int = 10
    max_concurrent_steps: int = 20
    step_timeout_seconds: float = 3600
    max_retries: int = 5
    retry_initial_seconds: float = 1.0
    retry_max_seconds: float = 30.0
    fail_on_quality: bool = False
    drift_mode: str = "PERMISSIVE"
    checkpoint: str = "shared"
    storage: str | None = None
    #: Modules that add transforms with ``transforms.register`` when they are imported.
    plugins: tuple[str, ...] = ()


def resolve(value: Any, params: dict[str, Any]) -> Any:
    """``${name}`` in texts, lists and maps; ``execution.date`` is the parameter ``date`` or today. Unknown names are errors."""
    if isinstance(value, dict):
        return {k: resolve(v, params) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [resolve(v, params) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        name = m.group(1).strip()
        if name == "execution.date":
            return str(params.get("date") or date.today())
        if name not in params:
            raise DefinitionError(f"nothing is known of ${{{name}}}")
        return str(params[name])

    return re.sub(r"\$\{([^}]*)\}", put, value)


def now() -> datetime:
    return datetime.now(UTC)
