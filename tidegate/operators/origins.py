"""Where the columns of a frame come from, read off its analysed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _items(jvm, seq) -> list:
    return list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))


def origins_of(df: DataFrame, inputs: dict[str, DataFrame]) -> dict[str, list[tuple[str, str]]] | None:
    """For each column of ``df`` the (dataset, column) pairs that its value is made of; None if the plan cannot be read.

    Attributes are followed from the output through aliases, unions and common table expressions down to the
    datasets' own. What only filters, joins or sorts is no origin.
    """
    jvm = df.sparkSession.sparkContext._jvm
    try:
        known: dict[int, tuple[str, str]] = {}
        for name, frame in inputs.items():
            for a in _items(jvm, frame._jdf.queryExecution().analyzed().output()):
                known.setdefault(a.exprId().id(), (name, a.name()))
        made: dict[int, set[int]] = {}
        tables: dict[int, list] = {}

        def see(plan) -> None:
            kind = plan.getClass().getSimpleName()
            children = _items(jvm, plan.children())
            for c in children:
                see(c)
            for e in _items(jvm, plan.expressions()):
                follow(e)
            if kind in ("Union", "Intersect", "Except", "UnionLoop"):
                for c in children:
                    for mine, theirs in zip(_items(jvm, plan.output()), _items(jvm, c.output())):
                        made.setdefault(mine.exprId().id(), set()).add(theirs.exprId().id())
            elif kind == "View":  # a dataset that is named twice has other attributes the second time
                name = plan.desc().identifier().table()
                for a in _items(jvm, plan.output()) if name in inputs else ():
                    known.setdefault(a.exprId().id(), (name, a.name()))
            elif kind == "CTERelationDef":
                tables[plan.id()] = _items(jvm, plan.output())
            elif kind in ("CTERelationRef", "UnionLoopRef"):
                at = plan.cteId() if kind == "CTERelationRef" else plan.loopId()
                for mine, theirs in zip(_items(jvm, plan.output()), tables.get(at, [])):
                    made.setdefault(mine.exprId().id(), set()).add(theirs.exprId().id())

        def follow(e) -> None:
            if e.getClass().getSimpleName() == "Alias":
                made.setdefault(e.exprId().id(), set()).update(a.exprId().id() for a in _items(jvm, e.references().toSeq()))
            for c in _items(jvm, e.children()):
                follow(c)
            if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                see(e.plan())

        plan = df._jdf.queryExecution().analyzed()
        see(plan)
        out: dict[str, list[tuple[str, str]]] = {}
        for a in _items(jvm, plan.output()):
            seen, stack, found = set(), [a.exprId().id()], set()
            while stack:
                at = stack.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at in known:
                    found.add(known[at])
                else:
                    stack.extend(made.get(at, ()))
            out[a.name()] = sorted(found)
        return out
    except Exception:  # plans are Spark's own business and differ between its versions
        return None
