"""Deeply nested records as flat tables (problem 4).

Dewey labelling: every node of a JSON document gets the ordinal path of its position
(``0.2.1``: second child of the third child of the first), so its parent is the label
without the last step and no identifiers are stored while walking. Nodes of the same
schema path (positions left out) form one table.

Spark has no operator of unbounded depth over JSON, so the walk is an Arrow batch
function: one pass with an explicit stack, no recursion, batches bounded by rows and by
characters. Paths and labels are put together only for the nodes that leave the walk. It
needs no shuffle.

Defined results: null and unreadable JSON (``NaN`` included) has no nodes; JSON held inside
a JSON string is read as the inner document where ``unwrap`` is set; documents of any depth
and numbers of any length are read, numbers keeping their digits as written; empty arrays
and objects are nodes without children; of a repeated field the last one counts; field
names stand in paths as written, in schema paths and column names those with a dot, bracket
or quote are quoted (``["a.b"]``), so that no two fields share one.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import arrow_safe, table

NODE_SCHEMA = "tbl string, row_id bigint, path string, schema_path string, label string, kind string, in_array boolean, value string"
ROWS, CHARACTERS = 50_000, 16_000_000


class Number(str):
    """A number as it is written."""

    __slots__ = ()


def _not_json(word: str):
    raise ValueError(word)


_WORDS = {"true": True, "false": False, "null": None}
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:"])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


def read_deep(text: str):
    """JSON of any depth, read without recursion; ``ValueError`` if it is none."""
    root: list = []
    open_, names, wanted, at = [root], [None], "value", 0
    while not (wanted == "after" and len(open_) == 1):
        token = _TOKEN.match(text, at)
        if token is None:
            raise ValueError(at)
        at, (mark, number, word), inside = token.end(), token.groups(), open_[-1]
        if wanted == "colon":
            if mark != ":":
                raise ValueError(at)
            wanted = "value"
            continue
        if wanted in ("name", "first name"):
            if mark == '"':
                names[-1], at = scanstring(text, at)
                wanted = "colon"
                continue
            if mark != "}" or wanted == "name":
                raise ValueError(at)
        elif wanted == "after":
            if mark == ",":
                wanted = "name" if type(inside) is dict else "value"
                continue
            if mark != ("}" if type(inside) is dict else "]"):
                raise ValueError(at)
        elif mark != "]" or wanted != "first value":
            if mark == '"':
                value, at = scanstring(text, at)
            elif mark in ("[", "{"):
                value = [] if mark == "[" else {}
            elif mark:
                raise ValueError(at)
            else:
                value = _WORDS[word] if word else Number(number)
            if type(inside) is dict:
                inside[names[-1]] = value
            else:
                inside.append(value)
            wanted = "after"
            if mark in ("[", "{"):
                open_.append(value)
                names.append(None)
                wanted = "first value" if mark == "[" else "first name"
            continue
        open_.pop()
        names.pop()
        wanted = "after"
    if text[at:].strip(" \t\n\r"):
        raise ValueError(at)
    return root[0]


_loads = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_not_json).decode


def _read(text: str, unwrap: bool):
    """The document, or None if it is unreadable."""
    try:
        for _ in range(1 + unwrap):
            try:
                found = _loads(text)
            except RecursionError:
                found = read_deep(text)
            if type(found) is not str:
                break
            text = found
        return found
    except ValueError:
        return None


_SPECIAL = re.compile(r'[.\[\]"]')


def schema_step(name: str) -> str:
    """A field's step in a schema path."""
    return "[" + json.dumps(name, ensure_ascii=False) + "]" if not name or _SPECIAL.search(name) else "." + name


_DICT, _LIST = dict, list


def _children(value):
    if type(value) is _DICT:
        return ((i, "." + k, k, v) for i, (k, v) in enumerate(value.items()))
    return ((i, f"[{i}]", None, v) for i, v in enumerate(value))


def walk(document, root: str, containers_only: bool = False):
    """``(path, schema, label, value, in_array)`` of every node in document order, the first three as lists of steps that live on."""
    path, schema, label = [root], [root], ["0"]
    yield path, schema, label, document, False
    if type(document) is not _DICT and type(document) is not _LIST:
        return
    steps: dict[str, str] = {}
    stack = [_children(document)]
    while stack:
        for i, step, name, value in stack[-1]:
            inner = type(value) is _DICT or type(value) is _LIST
            if containers_only and not inner:
                continue
            path.append(step)
            label.append(str(i))
            if name is None:
                schema.append("[]")
            else:
                if name not in steps:
                    steps[name] = schema_step(name)
                schema.append(steps[name])
            yield path, schema, label, value, name is None
            if inner and value:
                stack.append(_children(value))
                break
            path.pop(), schema.pop(), label.pop()
        else:
            stack.pop()
            path.pop(), schema.pop(), label.pop()


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", Number: "number", type(None): "null"}


def _shown(value, kind: str):
    return None if kind in ("object", "array", "null") else ("true" if value else "false") if kind == "boolean" else value


def _documents(df: DataFrame) -> DataFrame:
    return df.select("tbl", "row_id", "root", "unwrap", "json").where("json is not null")


def _batches(batches: Iterator[pa.RecordBatch], names: list[str], types: list, rows_of) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows ``rows_of(tbl, row_id, root, document)`` gives with their size in characters."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        rows, size = [], 0
        for tbl, row_id, root, unwrap, text in zip(*(c.to_pylist() for c in batch.columns)):
            document = _read(text, unwrap)
            if document is None:
                continue
            # only an escape can stand for half of a surrogate pair
            safe = arrow_safe if "\\u" in text else str
            for row, characters in rows_of(tbl, row_id, root, document, safe):
                rows.append(row)
                size += characters
                if len(rows) >= ROWS or size >= CHARACTERS:
                    yield batch_of(rows)
                    rows, size = [], 0
        yield batch_of(rows)


def dewey_nodes(df: DataFrame, array_objects_only: bool = False) -> DataFrame:
    """All nodes of ``tbl, row_id, root, unwrap, json``: path, label, kind, scalar value.

    With ``array_objects_only`` the walk and its labels are the same, but only objects directly in arrays leave it.
    """

    def rows_of(tbl, row_id, root, document, safe):
        for path, schema, label, value, in_array in walk(document, root, array_objects_only):
            if array_objects_only and not (in_array and type(value) is dict):
                continue
            kind = _KINDS[type(value)]
            shown = _shown(value, kind)
            at = "".join(path)
            yield (tbl, row_id, safe(at), safe("".join(schema)), ".".join(label), kind, in_array, shown and safe(shown)), 3 * len(at) + len(shown or "")

    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    return _documents(df).mapInArrow(lambda batches: _batches(batches, names, types, rows_of), NODE_SCHEMA)


def array_objects(df: DataFrame) -> DataFrame:
    """Only the objects directly in arrays, as ``tbl, row_id, path``: what child tables are made of."""
    return dewey_nodes(df, array_objects_only=True).where("kind = 'object' and in_array").select("tbl", "row_id", "path")


def parent_of(label):
    """Label of the parent: the label without its last step; null for a root."""
    return F.nullif(F.regexp_replace(label, r"(^|\.)[^.]*$", ""), F.lit(""))


def child_table(nodes: DataFrame, schema_path: str) -> DataFrame:
    """Objects of one schema path as a flat table: label, label of the parent object, scalar fields as a map."""
    objects = nodes.where((F.col("schema_path") == schema_path) & (F.col("kind") == "object"))
    rest = F.col("schema_path").substr(F.lit(len(schema_path) + 1), F.length("schema_path"))
    own = F.col("schema_path").startswith(schema_path) & rest.rlike(r'^(?:\.[^.\[\]"]+|\["(?:[^"\\]|\\.)*"\])$')
    scalars = nodes.where(own & ~F.col("kind").isin("object", "array"))
    fields = scalars.groupBy("tbl", "row_id", parent_of(F.col("label")).alias("label")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.ltrim(rest, F.lit(".")), "value")))).alias("fields"))
    return objects.join(fields, ["tbl", "row_id", "label"], "left").select("tbl", "row_id", "label", parent_of(parent_of(F.col("label"))).alias("parent_label"), "path", "fields")


TABLES_SCHEMA = "tbl string, row_id bigint, schema_path string, label string, parent_label string, path string, fields array<struct<label:string,name:string,kind:string,value:string>>"


def table_rows(document, root: str):
    """``(schema path, label, parent label, path, fields)``: the document and every object in an array, each with its scalars.

    A scalar belongs to the nearest row above it, so those of nested objects and of arrays of scalars
    do too; its name is its path from there, and its label tells two of the same name apart. The label of
    the parent is the row's own label cut to the depth of the row above.
    """
    open_: list[tuple[int, tuple]] = []  # rows above the node, each with its depth
    for path, schema, label, value, in_array in walk(document, root):
        depth = len(label)
        while open_ and open_[-1][0] >= depth:
            yield open_.pop()[1]
        if type(value) is dict or type(value) is list:
            if not open_ or (in_array and type(value) is dict):
                above = ".".join(label[: open_[-1][0]]) if open_ else None
                open_.append((depth, ("".join(schema), ".".join(label), above, "".join(path), [])))
        elif open_:
            top, row = open_[-1]
            kind = _KINDS[type(value)]
            name = "".join(p if p[0] == "[" else s for p, s in zip(path[top:], schema[top:]))
            row[4].append((".".join(label), name[1:] if name[0] == "." else name, kind, _shown(value, kind)))
    while open_:
        yield open_.pop()[1]


def array_tables(df: DataFrame) -> DataFrame:
    """Child tables of all schema paths as one: a row per object in an array, and one per document as the parent of the outermost."""

    def rows_of(tbl, row_id, root, document, safe):
        for schema, label, parent, path, fields in table_rows(document, root):
            held = [{"label": at, "name": safe(name), "kind": kind, "value": shown and safe(shown)} for at, name, kind, shown in fields]
            yield (tbl, row_id, safe(schema), label, parent, safe(path), held), 3 * len(path) + sum(len(f[0]) + len(f[1]) + len(f[3] or "") for f in fields)

    names = ["tbl", "row_id", "schema_path", "label", "parent_label", "path", "fields"]
    field = pa.struct([(n, pa.string()) for n in ("label", "name", "kind", "value")])
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(field)]
    return _documents(df).mapInArrow(lambda batches: _batches(batches, names, types, rows_of), TABLES_SCHEMA)


def schema_paths(df: DataFrame) -> DataFrame:
    """``tbl, schema_path, kind, nodes, rows``: nodes and rows per schema path, counted in each batch before the shuffle.

    A document lies in one batch, so the rows of batches add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rows = Counter(), Counter()
            for tbl, _, root, unwrap, text in zip(*(c.to_pylist() for c in batch.columns)):
                document = _read(text, unwrap)
                if document is not None:
                    own = Counter((tbl, arrow_safe("".join(schema)), _KINDS[type(value)]) for _, schema, _, value, _ in walk(document, root))
                    nodes.update(own)
                    rows.update(own.keys())
            columns = list(zip(*((*k, n, rows[k]) for k, n in nodes.items()))) or [()] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tbl", "schema_path", "kind", "nodes", "rows"])

    counted = _documents(df).mapInArrow(run, "tbl string, schema_path string, kind string, nodes bigint, rows bigint")
    return counted.groupBy("tbl", "schema_path", "kind").agg(F.sum("nodes").alias("nodes"), F.sum("rows").alias("rows"))


def columns_of(tables: DataFrame, names: list[str]) -> DataFrame:
    """A child table with one column per named scalar field; a field of another name stays in ``more``, as JSON."""
    value = lambda n: F.get(F.filter("fields", lambda f: f["name"] == n), F.lit(0))["value"].alias(n)
    more = F.filter("fields", lambda f: ~f["name"].isin(names) & f["value"].isNotNull())
    packed = F.to_json(F.map_from_entries(F.transform(more, lambda f: F.struct(f["name"], f["value"]))))
    return tables.select("row_id", "label", "parent_label", "path", *map(value, names), F.when(F.size(more) > 0, packed).alias("more"))


def nested_documents(spark, sf_dir: str) -> DataFrame:
    """The three nested columns as ``tbl, row_id, root, unwrap, json``."""

    def of(name: str, column: str, root: str, unwrap: bool) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), "row_id", F.lit(root).alias("root"), F.lit(unwrap).alias("unwrap"), F.col(column).alias("json"))

    return of("session_one", "message.content", "content", False).unionByName(of("oc_part", "data", "data", True)).unionByName(of("oc_message", "data", "data", True))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Every object that stands directly in an array: ``tbl, row_id, path``."""
    return array_objects(nested_documents(spark, sf_dir))


def p4_schema_paths(spark, sf_dir: str) -> DataFrame:
    """The tables that the nested columns fall into: nodes and rows per schema path and kind."""
    return schema_paths(nested_documents(spark, sf_dir))


def p4_tables(spark, sf_dir: str) -> DataFrame:
    """The child tables of all three columns, one below the other."""
    return array_tables(nested_documents(spark, sf_dir))


def p4_fields(spark, sf_dir: str) -> DataFrame:
    """Every scalar of the child tables, with the row it belongs to: ``tbl, row_id, schema_path, label, parent_label, at, name, kind, value``."""
    rows = p4_tables(spark, sf_dir)
    return rows.select("tbl", "row_id", "schema_path", "label", "parent_label", F.explode("fields").alias("f")).select("tbl", "row_id", "schema_path", "label", "parent_label", F.col("f.label").alias("at"), "f.name", "f.kind", "f.value")


def p4_blocks(spark, sf_dir: str) -> DataFrame:
    """Child table of the blocks in ``session_one.message.content``."""
    tables = array_tables(nested_documents(spark, sf_dir).where("tbl = 'session_one'"))
    return columns_of(tables.where("schema_path = 'content[]'"), ["type", "text", "id", "name", "tool_use_id", "content"]).drop("more")


def p4_hunks(spark, sf_dir: str) -> DataFrame:
    """Child table of the hunks in a tool part's metadata, linked to their files."""
    tables = array_tables(nested_documents(spark, sf_dir).where("tbl = 'oc_part'"))
    return columns_of(tables.where("schema_path = 'data.state.metadata.files[].hunks[]'"), ["start"]).drop("more")
