"""Counters and histograms of what the engine does, as Prometheus text."""

from __future__ import annotations

import threading
from collections import defaultdict

#: Histogram bounds in seconds.
PIPELINE_BOUNDS = (1, 5, 30, 60, 300)
STEP_BOUNDS = (0.1, 0.5, 1, 5, 30)


class Metrics:
    """Safe for several threads; names carry the prefix ``tidegate_``."""

    def __init__(self):
        self._lock = threading.Lock()
        self.counters: dict[tuple, float] = defaultdict(float)
        self.gauges: dict[tuple, float] = {}
        self.histograms: dict[tuple, list] = {}

    def _count(self, name: str, n: float = 1, **labels: str) -> None:
        with self._lock:
            self.counters[name, tuple(sorted(labels.items()))] += n

    def _observe(self, name: str, bounds: tuple, seconds: float, **labels: str) -> None:
        with self._lock:
            h = self.histograms.setdefault((name, tuple(sorted(labels.items()))), [bounds, [0] * (len(bounds) + 1), 0.0, 0])
            for i, b in enumerate(bounds):
                h[1][i] += seconds <= b
            h[1][-1] += 1
            h[2] += seconds
            h[3] += 1

    def pipeline_started(self, pipeline: str) -> None:
        self._count("pipeline_started_total", pipeline=pipeline)

    def pipeline_finished(self, pipeline: str, state: str, seconds: float) -> None:
        self._count("pipeline_finished_total", pipeline=pipeline, state=state)
        self._observe("pipeline_duration_seconds", PIPELINE_BOUNDS, seconds, pipeline=pipeline)

    def step_finished(self, pipeline: str, step: str, state: str, seconds: float) -> None:
        self._count("step_finished_total", pipeline=pipeline, step=step, state=state)
        self._observe("step_duration_seconds", STEP_BOUNDS, seconds, pipeline=pipeline, step=step)

    def rows(self, pipeline: str, step: str, read: int, written: int, rejected: int) -> None:
        for name, n in (("read", read), ("written", written), ("rejected", rejected)):
            self._count(f"rows_{name}_total", n, pipeline=pipeline, step=step)

    def quality(self, dataset: str, field: str, rule: str, failure_rate: float) -> None:
        with self._lock:
            self.gauges["quality_failure_rate", (("dataset", dataset), ("field", field), ("rule", rule))] = failure_rate

    def checkpoint_saved(self, pipeline: str) -> None:
        self._count("checkpoints_total", pipeline=pipeline)

    def resumed(self, pipeline: str) -> None:
        self._count("resumptions_total", pipeline=pipeline)

    def connector_error(self, connector: str) -> None:
        self._count("connector_errors_total", connector=connector)

    def text(self) -> str:
        """Prometheus exposition format."""

        def labels(pairs: tuple, *more: tuple) -> str:
            inner = ",".join(f'{k}="{str(v).replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' for k, v in (*pairs, *more))
            return f"{{{inner}}}" if inner else ""

        out = []
        with self._lock:
            for (name, pairs), n in [*self.counters.items(), *self.gauges.items()]:
                out.append(f"tidegate_{name}{labels(pairs)} {n:g}")
            for (name, pairs), (bounds, counts, total, n) in self.histograms.items():
                for b, c in zip([*map(str, bounds), "+Inf"], counts):
                    out.append(f"tidegate_{name}_bucket{labels(pairs, ('le', b))} {c}")
                out += [f"tidegate_{name}_sum{labels(pairs)} {total:g}", f"tidegate_{name}_count{labels(pairs)} {n}"]
        return "\n".join(out) + "\n"
