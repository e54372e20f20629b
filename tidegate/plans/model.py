"""Pipeline documents: YAML to dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path
from typing import Any

import yaml

from tidegate.errors import DefinitionError


class StepType(Enum):
    SOURCE = "SOURCE"
    TRANSFORM = "TRANSFORM"
    SINK = "SINK"


@dataclass(frozen=True)
class QualityConfig:
    """Rules of a dataset. ``mode``: ``warn`` reports, ``fail`` stops the step."""

    rules: tuple[dict, ...] = ()
    threshold: float = 0.95
    mode: str = "warn"


@dataclass(frozen=True)
class StepDefinition:
    id: str
    type: StepType
    connector: str | None = None
    transform: str | None = None
    depends_on: tuple[str, ...] = ()
    config: dict[str, Any] = field(default_factory=dict)
    input: str | None = None
    output: str | None = None
    quality: QualityConfig | None = None
    checkpoint: bool | None = None

    @property
    def dataset(self) -> str:
        """The name of what the step produces."""
        return self.output or self.id.replace("-", "_")


@dataclass(frozen=True)
class PipelineDefinition:
    id: str
    steps: tuple[StepDefinition, ...] = ()
    name: str = ""
    version: str = "1.0.0"
    description: str = ""

    def step(self, step_id: str) -> StepDefinition:
        return next(s for s in self.steps if s.id == step_id)


class _Loader(yaml.SafeLoader):
    """YAML with true and false as its only booleans, so that ``on:`` stays a key named on."""


_Loader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in rules if tag != "tag:yaml.org,2002:bool"] for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def load_yaml(text: str) -> Any:
    return yaml.load(text, _Loader)  # noqa: S506 - a safe loader


def _known(what: str, given: dict, allowed: set[str]) -> None:
    if unknown := set(given) - allowed:
        raise DefinitionError(f"{what}: unknown keys {sorted(map(str, unknown))}")


def _quality(raw: dict | None) -> QualityConfig | None:
    if raw is None:
        return None
    _known("quality", raw, {"threshold", "rules", "mode"})
    mode = str(raw.get("mode", "warn")).lower()
    if mode not in ("warn", "fail"):
        raise DefinitionError(f"quality mode is warn or fail, not {mode}")
    return QualityConfig(tuple(raw.get("rules") or ()), float(raw.get("threshold", 0.95)), mode)


def _step(raw: dict) -> StepDefinition:
    _known(f"step {raw.get('id')}", raw, {"id", "type", "connector", "transform", "depends_on", "config", "input", "output", "quality", "checkpoint"})
    if not raw.get("id"):
        raise DefinitionError("a step has no id")
    try:
        kind = StepType(str(raw.get("type", "")).upper())
    except ValueError:
        raise DefinitionError(f"step {raw['id']}: the type is SOURCE, TRANSFORM or SINK, not {raw.get('type')}") from None
    needs = "transform" if kind is StepType.TRANSFORM else "connector"
    if not raw.get(needs):
        raise DefinitionError(f"step {raw['id']}: a {kind.value} needs a {needs}")
    depends = raw.get("depends_on") or []
    depends = [depends] if isinstance(depends, str) else depends
    return StepDefinition(
        str(raw["id"]), kind, raw.get("connector"), raw.get("transform"), tuple(map(str, depends)),
        dict(raw.get("config") or {}), raw.get("input"), raw.get("output"), _quality(raw.get("quality")), raw.get("checkpoint"),
    )


def parse_pipeline(text: str) -> PipelineDefinition:
    """A definition from a YAML document with the root key ``pipeline``."""
    raw = load_yaml(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("pipeline"), dict):
        raise DefinitionError("the document has no root key 'pipeline'")
    _known("document", raw, {"pipeline"})
    body = raw["pipeline"]
    _known("pipeline", body, {"id", "name", "version", "description", "steps"})
    if not body.get("id"):
        raise DefinitionError("the pipeline has no id")
    steps = tuple(_step(s) for s in body.get("steps") or ())
    return PipelineDefinition(str(body["id"]), steps, str(body.get("name") or body["id"]), str(body.get("version") or "1.0.0"), str(body.get("description") or ""))


def load_pipeline(path: str) -> PipelineDefinition:
    return parse_pipeline(Path(path).read_text(encoding="utf-8"))
