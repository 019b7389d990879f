"""Deeply nested records to flat rows with links to their parents.

Nested Arrow arrays are flattened from their buffers: a list array's offsets say which stretch of the child array
belongs to which parent, ``list_parent_indices`` turns them into one parent index per child, positions are the
distance to the parent's offset, and keys travel down by one vectorised ``take`` per level. No row is visited.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import plain

BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class Level:
    """One nested list: the struct field that holds it, the kind of its members, and the lists inside them."""

    name: str
    kind: str
    inner: tuple[Level, ...] = ()
    fields: tuple[str, ...] = field(default=("label",))


def children(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Members of a list array, the index of each one's parent, and its position in it. Null members stay."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parent = pc.list_parent_indices(lists)
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    starts = pc.subtract(pc.cumulative_sum(pc.cast(sizes, pa.int64())), sizes)
    return pc.list_flatten(lists), parent, pc.subtract(pa.array(np.arange(len(parent))), starts.take(parent))


def flatten(keys: pa.Table, record: pa.StructArray, levels: Sequence[Level]) -> pa.Table:
    """Rows (keys, kind, node_path, parent_path, label): one for each non-null member of each nested list.

    ``record`` has a struct for each row of ``keys``. A null member keeps its position and gives no row.
    """
    out: list[pa.Table] = []

    def down(owner: pa.Array, path: pa.Array, holder: pa.StructArray, level: Level) -> None:
        member, parent, pos = children(pc.struct_field(holder, level.name))
        if not len(member):
            return
        live = pc.is_valid(member)
        member, parent, pos = member.filter(live), parent.filter(live), pos.filter(live)
        above = path.take(parent)
        step = pc.binary_join_element_wise(level.name + "[", pc.cast(pos, pa.string()), "]", "")
        here = pc.binary_join_element_wise(pc.if_else(pc.equal(above, ""), "", pc.binary_join_element_wise(above, "", ".")), step, "")
        own = owner.take(parent)
        flat = keys.take(own)
        n = len(member)
        for name, col in (("kind", pa.array([level.kind]).take(pa.array([0] * n, pa.int8()))), ("node_path", here), ("parent_path", above), ("label", pc.struct_field(member, "label"))):
            flat = flat.append_column(name, col)
        out.append(flat)
        for x in level.inner:
            down(own, here, member, x)

    n = len(record)
    for level in levels:
        down(pa.array(np.arange(n)), pa.array([""] * n, pa.string()), record, level)
    if out:
        return pa.concat_tables(out)
    schema = keys.schema
    for name in ("kind", "node_path", "parent_path", "label"):
        schema = schema.append(pa.field(name, pa.string()))
    return schema.empty_table()


def arrow_type(levels: Sequence[Level]) -> pa.DataType:
    fields = [pa.field(x.name, pa.list_(arrow_type(x.inner))) for x in levels]
    return pa.struct([pa.field("label", pa.string()), *fields])


def flatten_json(df: DataFrame, keys: Sequence[str], payload: str, shape: Callable[[str], dict | None], levels: Sequence[Level]) -> DataFrame:
    """Flat rows (keys, kind, node_path, parent_path, label) of the nested records in a text column.

    ``shape`` reads one text into plain dicts and lists in the form of ``levels`` (see ``arrow_type``) and returns
    None for what can't be read, which gives no rows, as null and empty texts do. Everything after it works on Arrow
    buffers. Batches are cut at 4 MB of text, so a task's memory follows its longest text, not its partition.
    Repeated rows give repeated rows; other columns are ignored.
    """
    kind = arrow_type(levels)
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(len(names)), 0
            ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())).to_pylist()
            while at < len(ends):
                base, to = (ends[at - 1] if at else 0), at + 1
                while to < len(ends) and ends[to] - base <= BATCH_BYTES:
                    to += 1
                shaped = [None if t is None else shape(t) for t in texts.slice(at, to - at).to_pylist()]
                held = pa.Table.from_batches([batch.select(names)]).slice(at, to - at)
                at = to
                live = pa.array([s is not None for s in shaped])
                record = pa.array([s for s in shaped if s is not None], kind)
                yield from flatten(held.filter(live), record, levels).combine_chunks().to_batches(max_chunksize=50_000)

    cols = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    src = df.filter(F.col(f"`{payload}`").isNotNull()).select(*cols, F.col(f"`{payload}`").alias("payload"))
    schema = ", ".join(f"{n} {t}" for n, t in src.dtypes if n != "payload") + ", kind string, node_path string, parent_path string, label string"
    return src.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys)))


def child_rows(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Rows (keys, pos_0, pos_1, ..., the scalar fields) of the members of a typed nested list such as ``a.b.c``.

    ``a`` is an array of structs with an array ``b`` of structs, and so on. A null member gives no row; its position is
    counted. The last level's fields that are no arrays come out under their names, with ``_`` appended on a clash.
    """
    steps = path.split(".")
    src = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{steps[0]}`").alias("nested"))
    t = src.schema["nested"].dataType.elementType
    for s in steps[1:]:
        t = t[s].dataType.elementType
    leaf = [f for f in t.fields if f.dataType.typeName() != "array"]
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, lists, places = pa.Table.from_batches([batch.select(names)]), batch.column(len(names)), []
            for i, s in enumerate(steps):
                member, parent, pos = children(lists if i == 0 else pc.struct_field(member, s))  # noqa: F821
                live = pc.is_valid(member)
                member, parent, pos = member.filter(live), parent.filter(live), pos.filter(live)
                held, places = held.take(parent), [p.take(parent) for p in places] + [pos]
            for i, p in enumerate(places):
                held = held.append_column(f"pos_{i}", p)
            for i, f in enumerate(leaf):
                held = held.append_column(f"f{i}", pc.struct_field(member, f.name))
            yield from held.combine_chunks().to_batches()

    from pyspark.sql import types as T

    schema = T.StructType([src.schema[n] for n in names] + [T.StructField(f"pos_{i}", T.LongType()) for i in range(len(steps))] + [T.StructField(f"f{i}", f.dataType) for i, f in enumerate(leaf)])
    out, final = src.mapInArrow(run, schema), []
    for wanted in [*keys, *[f"pos_{i}" for i in range(len(steps))], *[f.name for f in leaf]]:
        while wanted.lower() in [x.lower() for x in final]:
            wanted += "_"
        final.append(wanted)
    return out.toDF(*final)


REPORT = (
    Level("chapters", "chapter", (Level("sections", "section", (Level("blocks", "block", (Level("items", "item"),)),)),)),
    Level("tables", "table", (Level("rows", "row", (Level("cells", "cell"),)),)),
)

_OWN = {
    "chapters": {"number", "title", "sections", "summary", "artifact"},
    "sections": {"title", "blocks", "body", "id", "tableRefs", "figureRefs", "claimRefs"},
    "blocks": {"type", "body", "title", "claimRefs", "tableRef", "figureRef", "calloutType"},
    "items": {"label", "detail", "value", "text", "title"},
    "tables": {"columns", "rows", "title", "id", "notes"},
    "rows": {"cells"},
}


def members(value, name: str) -> list:
    """The members of a container of whatever shape: a list, a list under ``items``, a map, or one lone object."""
    if value is None:
        return []
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        if _OWN[name] & value.keys():
            return [value]
        if "items" in value and isinstance(value["items"], (list, dict)):
            return members(value["items"], name)
        return list(value.values())
    return [value]


def _label(v, *names) -> str | None:
    if isinstance(v, dict):
        v = next((v[n] for n in names if v.get(n) is not None), None)
    return None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)


def reports_in(payload) -> list[dict]:
    """The reports of a payload, a JSON text or its value: the objects with chapters or tables, in order, under whatever lists, objects and JSON texts; what ``report`` holds, where that has any, comes alone."""
    found, todo = [], [payload]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if v.lstrip()[:1] not in ("{", "[", '"'):
                continue
            try:
                v = json.loads(v)
            except (ValueError, RecursionError):
                continue
            todo.append(v)
        elif isinstance(v, list):
            todo += reversed([x for x in v if isinstance(x, (dict, list, str))])
        elif isinstance(v, dict):
            if "chapters" in v or "tables" in v:
                found.append(v)
            elif "report" in v and (inner := reports_in(v["report"])):
                found += inner
            else:
                todo += reversed([x for k, x in v.items() if k != "report" and isinstance(x, (dict, list, str))])
    return found


def shape_report(text: str) -> dict | None:
    """The reports of a payload, however they are wrapped, in the form of ``REPORT``; None if there is none.

    Of several reports in one payload the chapters and tables follow one another, so each node has a path of its own.
    """
    try:
        found = reports_in(text)
    except RecursionError:
        return None
    if not found:
        return None
    get = lambda x, k: members(x.get(k), k) if isinstance(x, dict) else []
    item = lambda x: None if x is None else {"label": _label(x, "label", "text", "title", "value")}
    block = lambda x: None if x is None else {"label": _label(x, "type", "title"), "items": [item(y) for y in get(x, "items")]}
    section = lambda x: None if x is None else {"label": _label(x, "title", "id"), "blocks": [block(y) for y in get(x, "blocks")]}
    chapter = lambda x: None if x is None else {"label": _label(x, "title", "number"), "sections": [section(y) for y in get(x, "sections")]}

    def row(x, columns):
        if x is None:
            return None
        cells = x.get("cells", x) if isinstance(x, dict) else x
        if isinstance(cells, dict):
            spots = {c: i for i, c in reversed(list(enumerate(columns)))}
            for c in cells:
                spots.setdefault(c, len(spots))
            placed = [None] * (max((spots[c] for c in cells), default=-1) + 1)
            for c, y in cells.items():
                placed[spots[c]] = {"label": _label(y)}
            return {"label": None, "cells": placed}
        if isinstance(cells, list):
            return {"label": None, "cells": [{"label": _label(y)} for y in cells]}
        return {"label": _label(cells), "cells": []}

    def table(x):
        if x is None:
            return None
        if not isinstance(x, dict):
            return {"label": _label(x), "rows": []}
        columns = [_label(c, "name", "label", "title", "id") for c in members(x.get("columns"), "items")]
        rows = x.get("rows")
        return {"label": _label(x, "title", "id"), "rows": [row(y, columns) for y in (rows if isinstance(rows, list) else members(rows, "rows"))]}

    return {"label": None, "chapters": [chapter(x) for v in found for x in get(v, "chapters")], "tables": [table(x) for v in found for x in get(v, "tables")]}


def unwrapped(text: str):
    """The value of a JSON text without its wrappings (JSON text in a string, {report: ...}, a list of one); a text that is no JSON is itself."""
    v = text
    while True:
        if isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, (dict, list, str)):
                return w
            v = w
        elif isinstance(v, dict) and list(v) == ["report"]:
            v = v["report"]
        elif isinstance(v, list) and sum(x is not None for x in v) == 1:
            v = next(x for x in v if x is not None)
        else:
            return v


def plain_members(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows (key, path, text): B7's plain text of a whole payload, at path $, and of each of its members on every level down to the values.

    B7 lets an object's label or title stand for it, so the texts below one are only in the members' rows. A payload
    nested too deeply to be parsed is its own text.
    """

    def texts(text):
        if text is None:
            return [("$", "")]
        try:
            out, todo = [], [("$", unwrapped(text))]
            while todo:
                path, v = todo.pop()
                out.append((path, plain(v)))
                inside = [(f"{path}.{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"{path}[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else []
                todo += reversed(inside)
            return out
        except RecursionError:
            return [("$", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(b, rows):
            at, path, text = zip(*rows)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(path, pa.string()), pa.array(text, pa.string())], names=[key, "path", "text"])

        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1)):
                rows += [(i, *m) for m in texts(t.as_py())]
                if len(rows) > 20_000:
                    yield emit(b, rows)
                    rows = []
            if rows:
                yield emit(b, rows)

    kind = df.schema[key].dataType
    return df.select(key, payload).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]))
