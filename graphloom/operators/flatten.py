"""Nested records as flat node tables with interval labels.

Every value of a record is a node. A depth-first walk numbers the nodes on entry (``pre``)
and on leaving (``post``, the largest ``pre`` below); a node lies below another of the same
record if its ``pre`` falls into the other's interval. A record is one row of the input and
is walked where it is read: no shuffle of bodies, and a node leaves as soon as the walk leaves it, in
batches, so of a very long array only the parsed value stands in memory.

Children meet their parents by containment, in one pass over the nodes of a record in the order of ``pre``:
nodes of one type never lie in each other, so the nearest one that contains a child is the last that
began before it.

Shapes: where a list is declared, an object counts as the list of that object and a text that
spells a JSON list counts as that list; any other value there is a leaf without children.
Elsewhere only JSON arrays have elements. Elements keep their places, nulls included.
A text that is no valid JSON has no nodes, nor has a null; depth is bounded by memory alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "rec_table string, rec_key string, rec_no long, pre long, post long, parent_pre long, depth int, node_type string, path string, pos int, name string, kind string, value string"
BATCH_NODES = 20_000
NAMES = [c.split()[0] for c in NODE.split(", ")]
KINDS = {dict: "object", list: "list", str: "text", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(text: str | None):
    """(value, True), or (None, False) for a null and for what is no valid JSON."""
    if text is None:
        return None, False
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_integer), True
    except RecursionError:
        return _parsed_deep(text)
    except ValueError:
        return None, False


def _integer(digits: str):
    return int(digits) if len(digits) <= 4000 else float(digits)


_SCALAR = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer)
_BLANK = " \t\r\n"


def _parsed_deep(text: str):
    """The same for records that nest deeper than the library recurses, with a stack of its own."""
    at, end = 0, len(text)
    holders: list = [[]]  # the value itself ends up in the first
    names: list = [None]

    def skip(n: int) -> int:
        while n < end and text[n] in _BLANK:
            n += 1
        return n

    def put(value) -> None:
        if isinstance(holders[-1], dict):
            holders[-1][names[-1]] = value
        else:
            holders[-1].append(value)

    try:
        expects = True
        while True:
            at = skip(at)
            if expects:
                if text[at] in "{[":
                    made: list | dict = {} if text[at] == "{" else []
                    put(made)
                    holders.append(made)
                    names.append(None)
                    at = skip(at + 1)
                    if text[at] == ("}" if isinstance(made, dict) else "]"):
                        expects = False
                        continue
                else:
                    value, at = _SCALAR.raw_decode(text, at)
                    put(value)
                    expects = False
                    continue
            elif len(holders) == 1:
                return (holders[0][0], True) if at == end else (None, False)
            else:
                is_object = isinstance(holders[-1], dict)
                if text[at] == ("}" if is_object else "]"):
                    holders.pop()
                    names.pop()
                    at += 1
                    continue
                if text[at] != ",":
                    return None, False
                at = skip(at + 1)
            if isinstance(holders[-1], dict):
                names[-1], at = _SCALAR.raw_decode(text, at)
                at = skip(at)
                if not isinstance(names[-1], str) or text[at] != ":":
                    return None, False
                at += 1
            expects = True
    except (ValueError, IndexError):
        return None, False


def _as_list(value):
    """The list that stands in a place declared as a list, or None."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return [value]
    if isinstance(value, str) and (spelled := parsed(value))[1] and isinstance(spelled[0], list):
        return spelled[0]
    return None


def label(root, lists: frozenset[str], maps: frozenset[str] = frozenset()) -> Iterator[list]:
    """Nodes of one record as [pre, post, parent_pre, depth, node_type, path, pos, name, value], in the
    order in which the walk leaves them. The walk keeps its own stack."""
    count, stack = 0, []
    entry = (root, -1, 0, "", "", None, None)
    while True:
        if entry is not None:
            value, parent, depth, kind_path, path, pos, name = entry
            if kind_path in lists:
                value = items if (items := _as_list(value)) is not None else value
                inner = enumerate(value) if isinstance(value, list) else None
            else:
                inner = enumerate(value) if isinstance(value, list) else iter(value.items()) if isinstance(value, dict) else None
            node = [count, count, parent, depth, kind_path, path, pos, name, value]
            count += 1
            stack.append((node, inner or iter(()), kind_path in maps))
        node, inner, named_freely = stack[-1]
        if (step := next(inner, None)) is None:
            stack.pop()
            node[1] = count - 1
            yield node
            if not stack:
                return
            entry = None
            continue
        at, child = step
        listed = isinstance(node[8], list)
        entry = (child, node[0], node[3] + 1, _join(node[4], "*" if listed or named_freely else at), _join(node[5], str(at)), at if listed else None, None if listed else at)


def _join(path: str, name: str) -> str:
    return f"{path}/{name}" if path else name


def _clean(text):
    """Half of a surrogate pair, which JSON can spell, cannot leave as UTF-8."""
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) else text


def _walker(lists: frozenset[str], maps: frozenset[str], types: frozenset[str] | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in NAMES]

        def done() -> pa.RecordBatch:
            try:
                made = pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(NAMES, out, ARROW)})
            except UnicodeEncodeError:
                made = pa.RecordBatch.from_pydict({n: pa.array(map(_clean, c), t) for n, c, t in zip(NAMES, out, ARROW)})
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for rec_table, key, no, text in zip(*(batch.column(c).to_pylist() for c in ("rec_table", "rec_key", "rec_no", "body"))):
                root, fine = parsed(text)
                if not fine:
                    continue
                for pre, post, parent, depth, kind_path, path, pos, name, value in label(root, lists, maps):
                    if types is not None and kind_path not in types:
                        continue
                    leaf = value if isinstance(value, str) else None if isinstance(value, (dict, list)) or value is None else json.dumps(value)
                    for c, v in zip(out, (rec_table, key, no, pre, post, parent, depth, kind_path, path, pos, name, KINDS[type(value)], leaf)):
                        c.append(v)
                    if len(out[0]) >= BATCH_NODES:
                        yield done()
        if out[0]:
            yield done()

    return run


ARROW = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3]


def node_table(
    records: DataFrame, rec_table: str, key: Column, body: Column, lists: Iterable[str] = (), maps: Iterable[str] = (), types: Iterable[str] | None = None
) -> DataFrame:
    """The labelled nodes of every record as delivered; ``rec_no`` tells deliveries of one key with other bodies apart.

    ``body`` is JSON text, or an expression such as ``to_json`` of nested columns. ``lists`` names
    the node types that hold lists, ``maps`` those whose keys are data and no type names. ``types``
    limits which types come out, never what is numbered. An identical delivery repeats its nodes, which
    what reads them counts once: bodies are not shuffled for it. Other columns are ignored, whatever their names.
    """
    rows = records.select(F.lit(rec_table).alias("rec_table"), key.cast("string").alias("rec_key"), body.alias("body"))
    rows = rows.withColumn("rec_no", F.xxhash64("body"))
    return rows.mapInArrow(_walker(frozenset(lists), frozenset(maps), None if types is None else frozenset(types)), NODE)


def linked(nodes: DataFrame, parents: dict[str, str]) -> DataFrame:
    """Nodes of the child types, each once, with ``parent_path, parent_pos, place`` of the nearest node of its
    parent type that contains it. ``parents`` names the parent type of each child type; '' is the record itself.

    ``place`` is the way from the parent: the rest of the type with the child's position or name.
    """
    key = ["rec_table", "rec_key", "rec_no"]
    before = Window.partitionBy(*key).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    seen = nodes.where(F.col("node_type").isin([*parents, *parents.values()]))
    label_ = F.struct("path", "pos", "pre", "post")
    # Identical deliveries share their labels, so any of them stands for all.
    last = {t: F.last(F.when(F.col("node_type") == t, label_), ignorenulls=True).over(before) for t in dict.fromkeys(parents.values())}
    seen = seen.select("*", *[c.alias(f"_p{n}") for n, c in enumerate(last.values())])
    number = {t: n for n, t in enumerate(last)}
    nearest = F.coalesce(*[F.when(F.col("node_type") == child, F.col(f"_p{number[parent]}")) for child, parent in parents.items()])
    rest = F.coalesce(*[F.when(F.col("node_type") == child, F.lit(child[len(parent) + 1 if parent else 0 :].removesuffix("*"))) for child, parent in parents.items()])
    rows = seen.where(F.col("node_type").isin(list(parents))).withColumn("_p", nearest).where((F.col("_p.pre") < F.col("pre")) & (F.col("pre") <= F.col("_p.post")))
    place = F.concat(rest, F.when(F.col("node_type").endswith("*"), F.coalesce(F.col("pos").cast("string"), "name")).otherwise(""))
    out = rows.select(*[c for c in nodes.columns], F.col("_p.path").alias("parent_path"), F.col("_p.pos").alias("parent_pos"), place.alias("place"))
    return out.dropDuplicates([*key, "pre"])


PHASE2_LISTS = ("triples_evidence", "triples_evidence/*/candidate_evidences", "triples_evidence/*/kg_triples")
PHASE2_PARENT, PHASE2_CHILD = "triples_evidence/*", "triples_evidence/*/candidate_evidences/*"
BRANCH_MAPS = ("bindings",)


def evidence_nodes(phase2: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    return node_table(phase2, "phase2_records", F.col("id"), F.col("phase2_json"), lists=PHASE2_LISTS, types=types)


def branch_nodes(branches: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    key = F.concat_ws("/", "question_id", "branch_id")
    body = F.to_json(F.struct("accepted_evidence", "bindings"), {"ignoreNullFields": "false"})
    return node_table(branches, "branch_states", key, body, maps=BRANCH_MAPS, types=types)


def child_objects(phase2: DataFrame, branches: DataFrame) -> DataFrame:
    """One row per child object: its record and its way there, the parent's and its place in the parent."""
    evidence = {PHASE2_CHILD: PHASE2_PARENT}
    told = {"accepted_evidence/*": "", "accepted_evidence/*/source": "accepted_evidence/*", "bindings/*": ""}
    rows = linked(evidence_nodes(phase2, [*evidence, PHASE2_PARENT]), evidence).unionByName(linked(branch_nodes(branches, ["", *told]), told))
    way = F.concat_ws("/", F.nullif("parent_path", F.lit("")), "place")
    return rows.where(F.col("kind") == "object").select("rec_table", "rec_key", way.alias("child_path")).distinct()
