"""Deeply nested records into related flat tables, by shared inlining.

`schema_graph` finds the paths of all records, which of them repeat and what lies below them. From it a plan is made: each repeated
or recursive path is a relation of its own; singleton descendants (objects and values that occur once per parent) are inlined as columns of
the nearest relation above. Relations of one element name are one table if they are the same kind of element: where an element lies below
itself (recursion), or where the names below one are all below the other (sharing). Rows point to their parent by
record id, parent relation and parent path.

Paths are names joined by `.`; a `.`, a `\\`, the name `[]` and the empty name (`\\e`) are escaped by `\\`, so no two paths are written alike. `[]` stands for the
elements of a list that is itself an element of a list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.arrow import slices
from skarv.functions.jsonio import as_list, parse

#: Records that are Python objects at a time in a worker.
ROWS = 200
#: The segment of a list in a list.
INNER = "[]"
_SEGMENT = re.compile(r"((?:\\.|[^.\\])*)(?:\.|$)", re.S)


def segment(name: str) -> str:
    """A name as a segment of a path."""
    return {INNER: "\\[]", "": "\\e"}.get(name) or name.replace("\\", "\\\\").replace(".", "\\.")


def segments(path: str) -> list[str]:
    """The segments of a path, still escaped."""
    found, at = [], 0
    while at <= len(path):
        m = _SEGMENT.match(path, at)
        found.append(m[1])
        at = m.end() if m.end() < len(path) or path[m.end() - 1 :] == "." and m[0].endswith(".") else len(path) + 1
    return found


def name_of(seg: str) -> str:
    """The name that a segment stands for."""
    return {"\\[]": INNER, "\\e": ""}[seg] if seg in ("\\[]", "\\e") else re.sub(r"\\(.)", r"\1", seg, flags=re.S)


def _under(path: str, seg: str) -> str:
    return f"{path}.{seg}" if path else seg


def schema_graph(df: DataFrame, column: str) -> DataFrame:
    """path, repeated, objects, values, nulls of every path in the JSON texts of `column`; one row per path.

    Elements of a list have its path; those of a list within a list have the path with `[]`. repeated: a list was seen there at least once.
    Each task gives its own counts first, so the shuffle grows with tasks and paths, not with records.
    """

    def walk(value: object, path: str, seen: dict[str, list[int]]) -> None:
        if path:
            s = seen.setdefault(path, [0, 0, 0, 0])
            s[0] += isinstance(value, list)
            s[1] += isinstance(value, dict)
            s[2] += not isinstance(value, (list, dict)) and value is not None
            s[3] += value is None
        if isinstance(value, list):
            for x in value:
                if isinstance(x, list):
                    walk(x, _under(path, INNER), seen)
                elif isinstance(x, dict):
                    if path:
                        seen[path][1] += 1
                    for k, v in x.items():
                        walk(v, _under(path, segment(k)), seen)
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(v, _under(path, segment(k)), seen)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in slices(batches, ROWS):
            for text in batch.column(0).to_pylist():
                walk(parse(text), "", seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([s[i] for s in seen.values()], pa.int64()) for i in range(4)]], ["path", "lists", "objects", "vals", "nulls"])

    found = df.select(F.col(column).cast("string").alias("j")).mapInArrow(per_task, "path string, lists long, objects long, vals long, nulls long")
    return found.groupBy("path").agg((F.sum("lists") > 0).alias("repeated"), F.sum("objects").alias("objects"), F.sum("vals").alias("values"), F.sum("nulls").alias("nulls"))


def _above(path: str) -> list[str]:
    """The paths above a path, longest first."""
    parts = segments(path)
    return [".".join(parts[:n]) for n in range(len(parts) - 1, 0, -1)]


def relations(paths: Iterable[str], repeated: Iterable[str]) -> list[str]:
    """The paths that need a relation: repeated ones, and those of elements that lie below themselves."""
    every, many = set(paths), set(repeated)
    below = {p for p in every if any(segments(q)[-1] == segments(p)[-1] != INNER for q in _above(p))}
    return sorted(many | below | {q for p in below for q in _above(p) if segments(q)[-1] == segments(p)[-1] and q in every})


def tables(paths: Iterable[str], rels: Iterable[str]) -> dict[str, str]:
    """By relation the table it belongs to, named after its shortest relation."""
    children: dict[str, set[str]] = {}
    for p in paths:
        up = _above(p)
        if up:
            children.setdefault(up[0], set()).add(segments(p)[-1])
    of: dict[str, str] = {}
    for r in sorted(rels, key=lambda r: (len(segments(r)), r)):
        name, own = segments(r)[-1], children.get(r, set())
        again = next((q for q in _above(r) if q in of and segments(q)[-1] == name), None)
        same = (q for q in of if segments(q)[-1] == name and own and children.get(q) and (own <= children[q] or children[q] <= own))
        of[r] = of[again] if again else of[other] if (other := next(same, None)) else r
    return of


class _Node:
    """A name on the way to a relation: the relation's code, if it is one, what lies below, and the lists in its list."""

    __slots__ = ("code", "below", "inner")

    def __init__(self) -> None:
        self.code: int | None = None
        self.below: dict[str, _Node] = {}
        self.inner: _Node | None = None

    def at(self, seg: str) -> _Node:
        if seg == INNER:
            self.inner = self.inner or _Node()
            return self.inner
        return self.below.setdefault(name_of(seg), _Node())


class Plan:
    """The relations to make: for each JSON column its prefix and the paths of its relations; optionally the tables they belong to.

    A relation's name starts with the prefix of its column if that column has one. The tree of path segments is walked in each record,
    so the work is one visit per element.
    """

    def __init__(self, columns: dict[str, str], relations: list[str], roots: dict[str, str] | None = None, tables: dict[str, str] | None = None):
        """roots: by column the name of a relation for the records themselves, with path ""."""
        self.columns, self.relations, self.roots = columns, [*relations, *(roots or {}).values()], roots or {}
        self.tables = {r: (tables or {}).get(r, r) for r in self.relations}
        self.code: dict[str, int] = {r: i for i, r in enumerate(self.relations)}
        self.trees: dict[str, _Node] = {}
        self.parents = {r: "" for r in self.relations}
        prefixes = [p for p in columns.values() if p]
        for column, prefix in columns.items():
            tree = _Node()
            for r in relations:
                own = next((p for p in prefixes if r.startswith(p + ".")), "")
                if own != prefix:
                    continue
                at = tree
                for part in segments(r[len(prefix) + 1 :] if prefix else r):
                    at = at.at(part)
                at.code = self.code[r]
                self.parents[r] = next((q for q in _above(r) if q in self.code and q not in self.roots.values()), self.roots.get(column, ""))
            self.trees[column] = tree

    @staticmethod
    def infer(graphs: dict[str, tuple[Iterable[str], Iterable[str]]], columns: dict[str, str], roots: dict[str, str] | None = None) -> Plan:
        """A plan from collected schema graphs (their size is that of the schema): by column all paths and the repeated ones."""
        paths, rels = [], []
        for column, prefix in columns.items():
            every, many = graphs.get(column, ((), ()))
            paths += [_under(prefix, p) for p in every]
            rels += [_under(prefix, p) for p in relations(every, many)]
        return Plan(columns, rels, roots, tables(paths, rels))


def _walk(obj: object, node: _Node, path: str, emit: list[tuple[int, str, object]]) -> None:
    if not isinstance(obj, dict):
        return
    for name, sub in node.below.items():
        value = obj.get(name)
        if value is None:
            continue
        if sub.code is None:
            for part in value if isinstance(value, list) else (value,):
                _walk(part, sub, path, emit)
        else:
            _elements(as_list(value), sub, path, emit)


def _elements(items: list, node: _Node, path: str, emit: list[tuple[int, str, object]]) -> None:
    for i, x in enumerate(items):
        if x is None:
            continue
        p = f"{path}/{i}" if path else str(i)
        emit.append((node.code, p, x))
        if isinstance(x, list):
            if node.inner is not None and node.inner.code is not None:
                _elements(x, node.inner, p, emit)
        elif node.below:
            _walk(x, node, p, emit)


def _inline(x: object, node: _Node | None) -> str:
    """An element's singleton descendants as one flat JSON object by path; what has relations of its own is left out."""
    flat: dict[str, object] = {}

    def put(v: object, name: str, at: _Node | None) -> None:
        if isinstance(v, dict):
            for k, w in v.items():
                below = at.below.get(k) if at else None
                if below is None or below.code is None:
                    put(w, _under(name, segment(k)), below)
        else:
            flat[name or "value"] = v

    if not (isinstance(x, list) and node is not None and node.inner is not None):
        put(x, "", node)
    return json.dumps(flat, ensure_ascii=False, sort_keys=True)


def shred(df: DataFrame, key: str, plan: Plan, by: str | None = None, with_values: bool = False) -> DataFrame:
    """Rows of all relations: `key`, rel, elem_path, parent_rel, parent_path and, if asked for, table_name and value (flat JSON).

    elem_path: positions from the outermost list inwards, from 0, joined by `/`; the parent's path is its prefix ("" for
    the record itself). An object or value in place of a list is a list of one; null elements give no row but keep their
    position; absent or null lists and unparsable JSON give none. by: of several deliveries of a key the one with the latest
    `by` counts – they are compared after extraction, so the JSON texts are never shuffled. Null keys are left out.
    """
    columns = list(plan.columns)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, _Node] = {}

        def index(node: _Node) -> None:
            if node.code is not None:
                nodes[node.code] = node
            for sub in (*node.below.values(), *([node.inner] if node.inner else [])):
                index(sub)

        for tree in plan.trees.values():
            index(tree)
        roots = {c: plan.code[r] for c, r in plan.roots.items()}
        nodes |= {code: plan.trees[c] for c, code in roots.items()}
        for batch in slices(batches, ROWS):
            offsets, codes, paths, values = [0], [], [], []
            cols = [(batch.column(c).to_pylist(), plan.trees[c], roots.get(c)) for c in columns]
            for i in range(batch.num_rows):
                for texts, tree, root in cols:
                    if texts[i] is None:
                        continue
                    found: list[tuple[int, str, object]] = []
                    record = parse(texts[i])
                    if root is not None and record is not None:
                        found.append((root, "", record))
                    _walk(record, tree, "", found)
                    for code, p, x in found:
                        codes.append(code)
                        paths.append(p)
                        if with_values:
                            values.append(_inline(x, nodes[code]))
                offsets.append(len(codes))
            fields = [pa.array(codes, pa.int32()), pa.array(paths, pa.string())] + ([pa.array(values, pa.string())] if with_values else [])
            names = ["c", "p"] + ["v"] * with_values
            elems = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names))
            out = [batch.column(key), *([batch.column(by)] if by else []), elems]
            yield pa.RecordBatch.from_arrays(out, [key, *([by] if by else []), "e"])

    src = df.filter(F.col(key).isNotNull()).select(key, *([by] if by else []), *[F.col(c).cast("string").alias(c) for c in columns])
    head = [f"`{c}` {src.schema[c].dataType.simpleString()}" for c in ([key, by] if by else [key])]
    elems = src.mapInArrow(extract, ", ".join([*head, "e array<struct<c:int,p:string" + (",v:string" if with_values else "") + ">>"]))
    if by:
        packed = elems.select(key, F.struct(F.struct(F.col(by).isNotNull().alias("known"), F.col(by).alias("at")).alias("o"), "e").alias("x"))
        elems = packed.groupBy(key).agg(F.max("x").alias("x")).select(key, F.col("x.e").alias("e"))
    rows = elems.select(key, F.inline("e"))
    if not plan.relations:
        rows = rows.filter(F.lit(False))
    named = lambda names: F.element_at(F.array(*[F.lit(n) for n in names or [""]]), F.col("c") + 1)
    path = F.when(F.col("p").contains("/"), F.regexp_replace("p", "/[^/]*$", "")).otherwise("")
    more = [named([plan.tables[r] for r in plan.relations]).alias("table_name"), F.col("v").alias("value")] if with_values else []
    return rows.select(key, named(plan.relations).alias("rel"), F.col("p").alias("elem_path"), named([plan.parents[r] for r in plan.relations]).alias("parent_rel"), path.alias("parent_path"), *more)


def relation(shredded: DataFrame, key: str, table: str, columns: dict[str, str]) -> DataFrame:
    """One flat table: `key`, rel, elem_path, parent_rel, parent_path and the inlined columns (path: type) of the table `table`.

    A shared table has the rows of all its relations, whatever their parents.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in columns.items())
    rows = shredded.filter(F.col("table_name") == table).withColumn("_v", F.from_json("value", schema))
    return rows.select(key, "rel", "elem_path", "parent_rel", "parent_path", *[F.col(f"_v.`{n}`").alias(n) for n in columns])
