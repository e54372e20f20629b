"""The graph of a pipeline's steps, its levels and its cycles."""

from __future__ import annotations

from dataclasses import dataclass

from tidegate.errors import CyclicDependencyError, DefinitionError, UnknownDependencyError
from tidegate.plans.model import PipelineDefinition


@dataclass(frozen=True)
class Dag:
    """Steps in order of declaration with what they need and what needs them."""

    needs: dict[str, tuple[str, ...]]
    feeds: dict[str, tuple[str, ...]]

    @property
    def roots(self) -> list[str]:
        return [n for n, before in self.needs.items() if not before]

    def levels(self) -> list[list[str]]:
        """Steps by the length of their longest chain of needs; a level's steps are independent."""
        open_needs = {n: len(before) for n, before in self.needs.items()}
        level, out = self.roots, []
        while level:
            out.append(level)
            ready = set()
            for n in level:
                for after in self.feeds[n]:
                    open_needs[after] -= 1
                    if open_needs[after] == 0:
                        ready.add(after)
            level = [n for n in self.needs if n in ready]
        if sum(map(len, out)) < len(self.needs):
            raise CyclicDependencyError(self.cycle())
        return out

    def order(self) -> list[str]:
        return [n for level in self.levels() for n in level]

    def cycle(self) -> list[str]:
        """The steps of one cycle in order, or an empty list."""
        done: set[str] = set()
        for begin in self.needs:
            path: list[str] = []
            at: dict[str, int] = {}
            stack = [(begin, iter(self.feeds[begin]))] if begin not in done else []
            if stack:
                at[begin] = 0
                path.append(begin)
            while stack:
                node, rest = stack[-1]
                nxt = next(rest, None)
                if nxt is None:
                    stack.pop()
                    path.pop()
                    del at[node]
                    done.add(node)
                elif nxt in at:
                    return path[at[nxt] :]
                elif nxt not in done:
                    at[nxt] = len(path)
                    path.append(nxt)
                    stack.append((nxt, iter(self.feeds[nxt])))
        return []


def build_dag(pipeline: PipelineDefinition) -> Dag:
    """The graph of a definition; repeated ids and unknown dependencies are errors."""
    needs: dict[str, tuple[str, ...]] = {}
    for s in pipeline.steps:
        if s.id in needs:
            raise DefinitionError(f"two steps are named '{s.id}'")
        needs[s.id] = tuple(dict.fromkeys(s.depends_on))
    feeds: dict[str, list[str]] = {n: [] for n in needs}
    for n, before in needs.items():
        for b in before:
            if b not in needs:
                raise UnknownDependencyError(n, b)
            feeds[b].append(n)
    return Dag(needs, {n: tuple(f) for n, f in feeds.items()})
