"""States of pipelines and steps, and the transitions between them."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from enum import Enum

from tidegate.errors import InvalidTransitionError


class PipelineState(Enum):
    CREATED = "CREATED"
    VALIDATED = "VALIDATED"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"
    RESUMING = "RESUMING"


class StepState(Enum):
    PENDING = "PENDING"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"
    SKIPPED = "SKIPPED"

    @property
    def succeeded(self) -> bool:
        return self in (StepState.COMPLETED, StepState.SKIPPED)


_P, _S = PipelineState, StepState
#: Where each state may go. Errors before the start lead to FAILED too.
TRANSITIONS = {
    _P.CREATED: {_P.VALIDATED, _P.RESUMING, _P.FAILED},
    _P.VALIDATED: {_P.RUNNING, _P.FAILED},
    _P.RUNNING: {_P.COMPLETED, _P.FAILED},
    _P.FAILED: {_P.RESUMING},
    _P.RESUMING: {_P.RUNNING, _P.FAILED},
    _P.COMPLETED: set(),
    _S.PENDING: {_S.RUNNING, _S.SKIPPED},
    _S.RUNNING: {_S.COMPLETED, _S.FAILED},
    _S.COMPLETED: set(),
    _S.FAILED: set(),
    _S.SKIPPED: set(),
}


@dataclass(frozen=True)
class Transition:
    subject: str
    before: Enum | None
    after: Enum
    at: datetime


class StateMachine:
    """Holds a state, its history and those who listen; safe for several threads."""

    def __init__(self, subject: str, start: Enum, history: list[Transition] | None = None):
        self.subject, self._lock, self._listeners = subject, threading.RLock(), []
        self.history = history or [Transition(subject, None, start, datetime.now(UTC))]
        self.state = self.history[-1].after

    def listen(self, f: Callable[[Transition], None]) -> None:
        self._listeners.append(f)

    def can(self, to: Enum) -> bool:
        return to in TRANSITIONS[self.state]

    def go(self, to: Enum) -> None:
        with self._lock:
            if not self.can(to):
                raise InvalidTransitionError(self.state, to, TRANSITIONS[self.state])
            event = Transition(self.subject, self.state, to, datetime.now(UTC))
            self.state = to
            self.history.append(event)
            for f in list(self._listeners):
                f(event)
