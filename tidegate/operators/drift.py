"""Schemas that change between files: versions, every change, and one consistent table.

The fields that one execution recorded for a dataset are a schema; its fingerprint is a hash of
the ordered names and types. The schemas of a dataset pass, in order of the executions' start,
through a small machine that keeps the schema before and the last known types. As long as the
fingerprint stays nothing happens; otherwise the explicit steps (rename, remove, add, change of
type) that lead to the new version are recorded. Records are routed through the chain of all
later steps in their order: renamed, ended where the field was removed, given a default for fields
that were added later, and cast to each new type and at last to the last one.

Defined results:
* names and types are compared trimmed and in lower case; a null type means the last known type
  of the field, and is unknown if there is none; an unknown type differs from a known one for a
  rename, but becoming known is not a change of type;
* a field recorded several times in an execution counts once, at its smallest id;
* rows with a null dataset, execution, field or id are ignored, as are executions without a start,
  since they have no place in the order; executions that start together are ordered by their id;
* fields of a record that no schema knows are kept in ``extra``, as are values of a field that was
  removed later, also if another field got that name; where several keys of a record lead
  to one field, a key that was renamed to it goes first, the others are kept in ``extra`` and the
  field is named in ``misfits``; a value that does not fit a type on its way is null, named in ``misfits`` and
  kept in ``extra`` as it was;
* ``status`` of a record is ``broken`` if its payload is no JSON object, ``no_run`` if its run has no start (it has no
  place in the order and is read by the last schema), else ``whole``;
* an empty table gives an empty result; extra columns are ignored.

A dataset with very many executions is cut into chunks by start. A first pass then finds how
each chunk ends, one row each, so that every chunk can begin from the state before it. Routes are
made by one more walk over the changes, backwards, whose state is the names that were ever changed;
they are as many as there are runs with records, and go to each group of records once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.chunks import TARGET_ROWS, chunk_of, hot_bounds, with_bounds
from tidegate.session import cut

CHANGES = "dataset_name string, execution_id string, started_us bigint, change string, field_before string, field_after string, place bigint, type_before string, type_after string, fingerprint_before bigint, fingerprint bigint"


def _clean(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(" \t\n\x0b\x0c\r")))


def schema_versions(nodes: DataFrame, executions: DataFrame) -> DataFrame:
    """(dataset_name, execution_id, started_us, fields array<struct<name, type>>, fingerprint), one row per recorded schema.

    ``dataset_name`` is the name trimmed and in lower case.
    """
    starts = executions.filter("id is not null and started_at is not null").groupBy(F.col("id").alias("execution_id")).agg(F.min(F.unix_micros(F.col("started_at").cast("timestamp"))).alias("started_us"))
    fields = (
        nodes.filter("dataset_name is not null and execution_id is not null and field_name is not null and id is not null")
        .groupBy(_clean(F.col("dataset_name")).alias("dataset_name"), "execution_id", _clean(F.col("field_name")).alias("name"))
        .agg(F.min("id").alias("id"), F.max(_clean(F.col("data_type"))).alias("type"))
    )
    schemas = fields.groupBy("dataset_name", "execution_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "type"))).alias("fields"))
    plain = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type")))
    return schemas.join(starts, "execution_id").select("dataset_name", "execution_id", "started_us", plain.alias("fields"), F.xxhash64(plain).alias("fingerprint"))


class SchemaMachine:
    """The schema before and the last known types of one dataset; yields the steps to the next schema."""

    def __init__(self, state: str | None = None):
        kept = json.loads(state) if state else {}
        self.before: list | None = kept.get("before")
        self.known: dict[str, str] = kept.get("known", {})
        self.fingerprint: int | None = kept.get("fingerprint")

    def state(self) -> str:
        return json.dumps({"before": self.before, "known": self.known, "fingerprint": self.fingerprint})

    def step(self, fields: list[tuple[str, str | None]], fingerprint: int) -> list[tuple]:
        """(change, before, after, place, type before, type after) from the schema before to this one."""
        if self.before is not None and fingerprint == self.fingerprint and all(t is not None for _, t in fields):
            return []
        now = [(n, t if t is not None else self.known.get(n)) for n, t in fields]
        self.known |= {n: t for n, t in now if t is not None}
        old, self.before, self.fingerprint = self.before, now, fingerprint
        if old is None:
            return []
        old_types, new_types = {n: t for n, t in old}, {n: t for n, t in now}
        gone = {n: i for i, (n, _) in enumerate(old) if n not in new_types}
        come = {i: n for i, (n, _) in enumerate(now) if n not in old_types}
        steps, renamed = [], set()
        for n, i in gone.items():
            new = come.get(i)
            if new is not None and new_types[new] is not None and new_types[new] == old_types[n]:
                steps.append(("renamed", n, new, i, old_types[n], new_types[new]))
                renamed.add(new)
            else:
                steps.append(("removed", n, "", i, old_types[n], None))
        steps += [("added", "", n, i, None, new_types[n]) for i, n in come.items() if n not in renamed]
        for i, (n, t) in enumerate(now):
            if n in old_types and t != old_types[n] and t is not None and old_types[n] is not None:
                steps.append(("type_changed", n, n, i, old_types[n], t))
        return steps


_CHANGES = pa.schema([("dataset_name", pa.string()), ("execution_id", pa.string()), ("started_us", pa.int64()), ("change", pa.string()), ("field_before", pa.string()), ("field_after", pa.string()), ("place", pa.int64()), ("type_before", pa.string()), ("type_after", pa.string()), ("fingerprint_before", pa.int64()), ("fingerprint", pa.int64())])


def _walk(only_state: bool):
    """Rows (dataset, chunk, state, started, execution, fields, fingerprint) in order -> changes, or how each chunk ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine = None, SchemaMachine()
        for batch in batches:
            rows = []
            for ds, chunk, state, started, ex, fields, print_ in zip(*(c.to_pylist() for c in batch.columns)):
                if (ds, chunk) != current:
                    if only_state and current is not None:
                        rows.append((*current, machine.state()))
                    current, machine = (ds, chunk), SchemaMachine(state)
                before = machine.fingerprint
                steps = machine.step([(f["name"], f["type"]) for f in fields], print_)
                if not only_state:
                    rows += [(ds, ex, started, *s, before, print_) for s in steps]
            if rows:
                yield _batch(rows, _STATES if only_state else _CHANGES)
        if only_state and current is not None:
            yield _batch([(*current, machine.state())], _STATES)

    return run


_STATES = pa.schema([("dataset_name", pa.string()), ("chunk", pa.int32()), ("state", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End states (dataset, chunk, state) in order -> the state each next chunk begins with."""
    current, carried = None, {}
    for batch in batches:
        rows = []
        for ds, chunk, state in zip(*(c.to_pylist() for c in batch.columns)):
            if ds != current:
                current, carried = ds, {}
            if carried:
                rows.append((ds, chunk, json.dumps(carried)))
            own = json.loads(state)
            carried = {"before": own["before"], "known": carried.get("known", {}) | own["known"], "fingerprint": own["fingerprint"]}
            # Types unknown at the end of the chunk may be known from before it.
            carried["before"] = [(n, t if t is not None else carried["known"].get(n)) for n, t in carried["before"]]
        if rows:
            yield _batch(rows, _STATES)


def schema_changes(nodes: DataFrame, executions: DataFrame, target_rows: int = TARGET_ROWS, versions: DataFrame | None = None) -> DataFrame:
    """Every change of every dataset, compared with the execution before it that recorded the dataset.

    ``versions`` are those of ``schema_versions``, if they are there already.
    """
    versions = schema_versions(nodes, executions) if versions is None else versions
    recorded = nodes.select(_clean(F.col("dataset_name")).alias("dataset_name"), F.lit(0).cast("bigint").alias("started_us"))
    if recorded.groupBy("dataset_name").count().filter(F.col("count") > target_rows).isEmpty():
        bounds = None
    else:
        bounds = hot_bounds(versions.select("dataset_name", "started_us"), "dataset_name", "started_us", target_rows)
    chunked = with_bounds(versions, "dataset_name", bounds).withColumn("chunk", chunk_of(F.col("started_us"), F.col("bounds")).cast("int"))
    order = ["dataset_name", "chunk", "started_us", "execution_id"]
    columns = ["dataset_name", "chunk", "state", "started_us", "execution_id", "fields", "fingerprint"]

    def walked(rows: DataFrame, only_state: bool, schema: str) -> DataFrame:
        # A version with the fingerprint of the one before and no type to fill in changes nothing and goes no further. The
        # window brings the rows of a chunk together and in order, as the walk needs them.
        before = F.lag("fingerprint").over(Window.partitionBy("dataset_name", "chunk").orderBy("started_us", "execution_id"))
        same = (before == F.col("fingerprint")) & ~F.exists("fields", lambda f: f["type"].isNull())
        news = rows.select(*columns).withColumn("same", F.coalesce(same, F.lit(False))).filter("not same").drop("same")
        return news.sortWithinPartitions(*order).mapInArrow(_walk(only_state), schema)

    no_state = F.lit(None).cast("string").alias("state")
    if bounds is None:
        return walked(chunked.withColumn("state", no_state), False, CHANGES)
    ends = walked(chunked.filter("bounds is not null").withColumn("state", no_state), True, "dataset_name string, chunk int, state string")
    begins = ends.repartition("dataset_name").sortWithinPartitions("dataset_name", "chunk").mapInArrow(_carry, "dataset_name string, chunk int, state string")
    return walked(chunked.join(begins, ["dataset_name", "chunk"], "left"), False, CHANGES)


def _value(kind: str | None, v) -> tuple[str | None, bool]:
    """The value as text of the type, and whether it fits."""
    if v is None:
        return None, True
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    bare = text.strip()
    try:
        if kind in ("integer", "long"):
            if isinstance(v, bool) or not re.fullmatch(r"[+-]?\d+(\.0*)?", bare):
                return None, False
            n = int(bare.split(".")[0])
            top = 2**31 if kind == "integer" else 2**63
            return (str(n), True) if -top <= n < top else (None, False)
        if kind in ("double", "decimal"):
            if isinstance(v, bool):
                return None, False
            d = Decimal(bare)
            return (str(float(d)) if kind == "double" else format(d, "f"), True) if d.is_finite() else (None, False)
        if kind == "boolean":
            return (bare.lower(), True) if bare.lower() in ("true", "false") else (None, False)
        if kind == "date":
            return datetime.fromisoformat(bare).date().isoformat(), True
        if kind == "timestamp":
            return datetime.fromisoformat(bare).isoformat(), True
    except (ValueError, InvalidOperation, OverflowError):
        return None, False
    return text, True


class Migration:
    """The way of each field from a version to the last schema, built from the last step backwards.

    ``ways`` holds the names that do not simply stay: name -> (last name or None if it was removed, types it is cast to
    on its way, the name under which it was removed). ``defaults`` are the fields that came later: last name -> (value, casts).
    """

    def __init__(self, defaults: dict[str, str] | None = None):
        self.given = defaults or {}
        self.ways: dict[str, tuple[str | None, list[str], str | None]] = {}
        self.defaults: dict[str, tuple[str | None, list[str]]] = {}

    def way(self, name: str) -> tuple[str | None, list[str], str | None]:
        return self.ways.get(name, (name, [], None))

    def before(self, steps: list[tuple[str, str, str, str | None]]) -> None:
        """Go back over the (change, before, after, type after) of one execution, which apply at once."""
        ways = dict(self.ways)
        for change, old, new, kind in steps:
            if change == "renamed":
                ways[old] = self.way(new)
            elif change == "removed":
                ways[old] = (None, [], old)
            elif change == "type_changed":
                to, casts, gone = self.way(old)
                ways[old] = (to, [kind, *casts], gone) if to is not None else (to, casts, gone)
            elif change == "added" and (to := self.way(new))[0] is not None:
                self.defaults[to[0]] = (self.given.get(new), to[1])
        self.ways = {n: w for n, w in ways.items() if w != (n, [], None)}

    def text(self, last: list) -> str:
        return json.dumps({"ways": self.ways, "defaults": self.defaults, "last": last})


_ROUTES = pa.schema([("dataset_name", pa.string()), ("at", pa.string()), ("route", pa.string())])
LAST = 2**63 - 1


def _routes(defaults: dict[str, dict[str, str]]):
    """Rows (dataset, started, execution, kind, change, before, after, type) of each dataset, the latest first -> (dataset, execution, route).

    A ``last`` row holds the last schema; an ``entry`` asks for the route from there on and comes before the changes of its execution.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain, last, waiting, at = object(), Migration(), [], [], None
        for batch in batches:
            rows = []
            for ds, started, ex, kind, change, old, new, type_ in zip(*(c.to_pylist() for c in batch.columns)):
                if ds != current:
                    current, chain, last, waiting = ds, Migration(defaults.get(ds)), [], []
                elif waiting and (started, ex) != at:
                    chain.before(waiting)
                    waiting = []
                at = started, ex
                if kind == "last":
                    last = json.loads(old)
                elif kind == "entry":
                    rows.append((ds, ex, chain.text(last)))
                else:
                    waiting.append((change, old, new, type_))
            if rows:
                yield _batch(rows, _ROUTES)

    return run


_UNIFIED = pa.schema([("dataset_name", pa.string()), ("record_id", pa.int64()), ("execution_id", pa.string()), ("status", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("extra", pa.map_(pa.string(), pa.string())), ("misfits", pa.string())])


def _cast(v, casts: list[str | None]) -> tuple[str | None, bool]:
    """The value after each cast in turn, and whether it fitted all of them."""
    for kind in casts:
        v, fits = _value(kind, v)
        if not fits:
            return None, False
    return v, True


def unify(record: dict, route: dict) -> tuple[dict[str, str | None], dict[str, str | None], list[str]]:
    """(fields, extra, misfits) of one record under its route."""
    ways, types = route["ways"], dict(route["last"])
    fields: dict[str, str | None] = dict.fromkeys(types)
    extra: dict[str, str | None] = {}
    taken: set[str] = set()
    misfits: set[str] = set()
    led = [(k, v, *ways.get(k, (k, [], None))) for k, v in record.items()]
    for k, v, name, casts, gone in sorted(led, key=lambda x: (x[2] == x[0], x[0])):  # renamed keys first
        fits = True
        if name in types and name not in taken:
            taken.add(name)
            fields[name], fits = _cast(v, [*casts, types[name]])
            if fits:
                continue
        if name in taken:
            misfits.add(name)
        kept = gone if name is None else k
        kept = k if kept in record or kept in extra else kept
        extra[kept] = v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)
    for name, (value, casts) in route["defaults"].items():
        if name in types and name not in taken:
            fields[name], fits = _cast(value, [*casts, types[name]])
            if not fits:
                misfits.add(name)
    return fields, extra, sorted(misfits)


def _unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dataset, at, salt, record id, execution, payload, route), each group's route first -> records."""
    route: dict = {}
    for batch in batches:
        rows = []
        for ds, at, _, rid, ex, payload, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text is not None:
                route = json.loads(text)
                continue
            try:
                record = json.loads(payload) if payload is not None else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                rows.append((ds, rid, ex, "broken", [], [], ""))
                continue
            fields, extra, misfits = unify({k.strip().lower(): v for k, v in record.items()}, route)
            rows.append((ds, rid, ex, "whole" if at else "no_run", list(fields.items()), list(extra.items()), ",".join(misfits)))
        yield _batch(rows, _UNIFIED) if rows else pa.RecordBatch.from_pylist([], _UNIFIED)


#: Groups that the records of one run and dataset are dealt out to.
SALTS = 4


def unified_records(records: DataFrame, nodes: DataFrame, executions: DataFrame, defaults: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(dataset_name, record_id, execution_id, status, fields, extra, misfits): records in the last schema of their dataset.

    ``defaults`` has values, as text, by dataset and field for records that are older than the field; else these are null.
    """
    versions = cut(schema_versions(nodes, executions))
    changes = schema_changes(nodes, executions, versions=versions)
    # The last schema, its types filled from the last known ones.
    last = versions.groupBy("dataset_name").agg(F.max(F.struct("started_us", "execution_id", "fields")).alias("v")).select("dataset_name", F.col("v.fields").alias("last"))
    known = (
        versions.select("dataset_name", "started_us", "execution_id", F.inline("fields"))
        .filter("type is not null").groupBy("dataset_name", "name").agg(F.max(F.struct("started_us", "execution_id", "type")).alias("k"))
        .groupBy("dataset_name").agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("k.type")))).alias("known"))
    )
    fill = lambda f: F.array(f["name"], F.coalesce(f["type"], F.try_element_at("known", f["name"])))
    target = last.join(known, "dataset_name", "left").select("dataset_name", F.to_json(F.transform("last", fill)).alias("last"))
    starts = executions.filter("started_at is not null").groupBy(F.col("id").alias("execution_id")).agg(F.min(F.unix_micros(F.col("started_at").cast("timestamp"))).alias("started_us"))
    rows = records.select(_clean(F.col("dataset_name")).alias("dataset_name"), "execution_id", "record_id", "payload").join(starts, "execution_id", "left")
    rows = cut(rows.select("dataset_name", F.when(F.col("started_us").isNotNull(), F.col("execution_id")).otherwise("").alias("at"), F.coalesce("started_us", F.lit(LAST - 1)).alias("started_us"), "execution_id", "record_id", "payload"))

    no = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    entries = rows.select("dataset_name", "started_us", "at").distinct().select("dataset_name", "started_us", "at", F.lit("entry").alias("kind"), *no("change", "field_before", "field_after", "type_after"))
    lasts = target.select("dataset_name", F.lit(LAST).alias("started_us"), F.lit("").alias("at"), F.lit("last").alias("kind"), *no("change"), F.col("last").alias("field_before"), *no("field_after", "type_after"))
    steps = changes.select("dataset_name", "started_us", F.col("execution_id").alias("at"), F.lit("step").alias("kind"), "change", "field_before", "field_after", "type_after")
    routes = (
        lasts.unionByName(entries).unionByName(steps).repartition("dataset_name")
        .sortWithinPartitions("dataset_name", F.desc("started_us"), F.desc("at"), "kind").mapInArrow(_routes(defaults or {}), "dataset_name string, at string, route string")
    )
    text = F.lit(None).cast("string")
    sent = routes.select("dataset_name", "at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("bigint").alias("record_id"), text.alias("execution_id"), text.alias("payload"), "route")
    asked = rows.select("dataset_name", "at", F.pmod(F.xxhash64("record_id", "payload"), F.lit(SALTS)).cast("int").alias("salt"), "record_id", "execution_id", "payload", text.alias("route"))
    return sent.unionByName(asked).repartition("dataset_name", "at", "salt").sortWithinPartitions("dataset_name", "at", "salt", F.col("route").isNull()).mapInArrow(
        _unify, "dataset_name string, record_id bigint, execution_id string, status string, fields map<string,string>, extra map<string,string>, misfits string"
    )


SPARK_TYPES = {"integer": "int", "long": "bigint", "double": "double", "decimal": "decimal(38,9)", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def dataset_table(unified: DataFrame, fields: list[tuple[str, str | None]], dataset: str) -> DataFrame:
    """One dataset as a typed table with the columns of its last schema, as ``schema_versions`` gives them."""
    columns = [F.try_element_at("fields", F.lit(n)).try_cast(SPARK_TYPES.get(t or "", "string")).alias(n) for n, t in fields]
    return unified.filter((F.col("dataset_name") == dataset) & F.col("status").isin("whole", "no_run")).select("record_id", "execution_id", *columns)
