"""Errors that users of the engine may want to tell apart."""

from __future__ import annotations


class TidegateError(Exception):
    """Base of all errors raised by the engine."""


class DefinitionError(TidegateError):
    """A pipeline document is not valid."""


class UnknownDependencyError(DefinitionError):
    def __init__(self, step: str, missing: str):
        super().__init__(f"step '{step}' depends on '{missing}', which is no step of the pipeline")
        self.step, self.missing = step, missing


class CyclicDependencyError(DefinitionError):
    """``path`` holds the steps of one cycle, each once."""

    def __init__(self, path: list[str]):
        super().__init__("steps depend on each other in a cycle: " + " -> ".join([*path, path[0]]))
        self.path = path


class InvalidTransitionError(TidegateError):
    def __init__(self, now, to, valid):
        names = ", ".join(sorted(s.name for s in valid)) or "none"
        super().__init__(f"no transition from {now.name} to {to.name}; valid targets: {names}")


class ConnectorError(TidegateError):
    """A connector is missing, wrongly configured or cannot do what is asked."""


class QualityGateError(TidegateError):
    """A gate in mode ``fail`` did not pass; ``report`` says why."""

    def __init__(self, report):
        fields = ", ".join(f"{r.field}/{r.rule}" for r in report.failing)
        super().__init__(f"quality of '{report.dataset}' is below its threshold: {fields}")
        self.report = report


class SchemaDriftError(TidegateError):
    """The schema of a dataset changed and the drift mode is STRICT."""


class StepTimeoutError(TidegateError):
    """A step ran longer than the configured limit and its Spark jobs were cancelled."""
