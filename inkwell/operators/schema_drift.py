"""Schemas that drift between files (problem 4).

Each file of JSON lines has a schema tree: its fields, nested ones below them, each with the set of
JSON types its non-null values have. Between the trees of a file and the file before it, a tree edit
distance is taken in which a field may be kept, retyped (1), renamed to a name of the same meaning
(1), moved below another parent (1), or removed or added with all below it (1 for each field). Names of
different meaning are never matched, so the distance falls apart by meaning: at each level, fields of
one meaning are assigned to each other at least cost, and their subtrees recursively; moves are taken on
top. This script is the list of changes. The scripts of a feed, from the targets to its first file and on from
file to file, are also compiled into one projection per file, which leads each target column to the
paths that the file has for it: renamed, moved below other fields, or both in turn. The projections are
applied to every line; an object is led to its main part and a list to one text (see ``led``).

Schemas are gathered where the lines are: a batch of lines becomes one row for each file, path and
type set, so only schemas are shuffled. A file's schema and a feed's list of files are small; lines
of one feed or file, however many, never meet in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType, StructField, StructType

#: The families of names that mean the same.
FAMILIES = (
    ("pmcid", "PMCID", "pmcid_upper", "pmcid_lower"),
    ("title", "article_title", "full_title", "title_full"),
    ("journal", "journal_title", "journalTitle", "journal_name"),
    ("year", "pubYear", "publication_year", "pub_year", "publicationYear"),
    ("abstractText", "abstract", "abstract_text"),
    ("keywords", "keyword"),
)
FAMILY = {name: f"family {i}" for i, names in enumerate(FAMILIES) for name in names}
TYPES = {str: 1, int: 2, float: 2, bool: 4, list: 8, dict: 16}
TARGETS = {
    "id": "string", "source": "string", "pmid": "string", "pmcid": "string", "doi": "string", "title": "string",
    "abstract": "string", "journal": "string", "pub_year": "string", "author_string": "string", "is_open_access": "boolean",
    "pub_type": "string", "is_preprint": "boolean", "europe_pmc_url": "string", "has_full_text": "boolean", "xml_path": "string", "text_path": "string",
}


#: The parts of an object that hold its value, in order, unless a part is named as the target.
MAIN = ("value", "text", "title", "y")
#: Lists become one text in these targets; the others take the first element.
JOINED = {"abstract": ". ", "author_string": ", "}


def meaning(name: str) -> str:
    return FAMILY.get(name) or "name " + name.lower().replace("_", "")


def parse_object(raw: str | None) -> dict | None:
    """The object that a line holds, out of its wrapper if it is one; None for any other line."""

    def refuse(constant: str) -> None:
        raise ValueError(constant)

    try:
        found = json.loads(raw, parse_constant=refuse) if raw else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    if len(found) == 1 and isinstance(inner := next(iter(found.values())), dict):
        return inner
    return found


@dataclass
class Node:
    types: int = 0
    below: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(n.size() for n in self.below.values())


@dataclass(frozen=True)
class Change:
    kind: str  # renamed, retyped, added, removed, moved
    before: tuple[str, ...]
    after: tuple[str, ...]


def retyped(a: Node, b: Node) -> bool:
    return bool(a.types and b.types and a.types != b.types)


def assigned(cost: list[list[int]]) -> list[tuple[int, int]]:
    """Each row a column of its own, or each column a row, at least total cost: rows join one by one along a cheapest path of exchanges."""
    if not cost or not cost[0]:
        return []
    if len(cost) > len(cost[0]):
        return sorted((i, j) for j, i in assigned([list(c) for c in zip(*cost)]))
    wide = len(cost[0])
    give, take = [0] * len(cost), [0] * wide  # potentials: no cost less give and take is negative
    holder: list[int | None] = [None] * wide
    for row in range(len(cost)):
        best, via, seen = [float("inf")] * wide, [-1] * wide, set()
        at, i = -1, row
        while True:
            for j in range(wide):
                if j not in seen and (c := cost[i][j] - give[i] - take[j]) < best[j]:
                    best[j], via[j] = c, at
            at = min((j for j in range(wide) if j not in seen), key=lambda j: best[j])
            step = best[at]
            give[row] += step
            for j in seen:
                give[holder[j]] += step
                take[j] -= step
            best = [x if j in seen else x - step for j, x in enumerate(best)]
            seen.add(at)
            if holder[at] is None:
                break
            i = holder[at]
        while at >= 0:
            holder[at] = row if via[at] < 0 else holder[via[at]]
            at = via[at]
    return sorted((i, j) for j, i in enumerate(holder) if i is not None)


def script(a: Node, b: Node, before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> tuple[int, list[Change]]:
    """Cost and changes that lead from the fields below ``a`` to those below ``b``."""
    cost, changes = 0, []

    def pair(x: str, y: str) -> tuple[int, list[Change]]:
        own, more = script(a.below[x], b.below[y], (*before, x), (*after, y))
        head = [Change("renamed", (*before, x), (*after, y))] if x != y else []
        if retyped(a.below[x], b.below[y]):
            head.append(Change("retyped", (*before, x), (*after, y)))
        return own + len(head), head + more

    gone, new = {}, {}
    for name in sorted(a.below):
        if name in b.below:
            own, more = pair(name, name)
            cost, changes = cost + own, changes + more
        else:
            gone.setdefault(meaning(name), []).append(name)
    for name in sorted(b.below):
        if name not in a.below:
            new.setdefault(meaning(name), []).append(name)
    for sense in sorted({*gone, *new}):
        xs, ys = gone.get(sense, []), new.get(sense, [])
        paired = {(x, y): pair(x, y) for x in xs for y in ys}
        # what a pair costs beyond removing the one and adding the other
        extra = [[paired[x, y][0] - a.below[x].size() - b.below[y].size() for y in ys] for x in xs]
        chosen = [(xs[i], ys[j]) for i, j in assigned(extra)]
        for x, y in chosen:
            own, more = paired[x, y]
            cost, changes = cost + own, changes + more
        for x in sorted({*xs} - {x for x, _ in chosen}):
            cost, changes = cost + a.below[x].size(), [*changes, Change("removed", (*before, x), ())]
        for y in sorted({*ys} - {y for _, y in chosen}):
            cost, changes = cost + b.below[y].size(), [*changes, Change("added", (), (*after, y))]
    return (cost, changes) if before or after else with_moves(cost, changes, a, b)


def at(root: Node, path: tuple[str, ...]) -> Node:
    for name in path:
        root = root.below[name]
    return root


def paths(root: Node, start: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """All paths below a node, parents before what is below them."""
    for name, node in sorted(root.below.items()):
        yield (*start, name)
        yield from paths(node, (*start, name))


def nested(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return a == b[: len(a)] or b == a[: len(b)]


def with_moves(cost: int, changes: list[Change], a: Node, b: Node) -> tuple[int, list[Change]]:
    """A field removed here and added with the same name and types below another parent is moved.

    Either may be below a field that is removed or added as a whole. With moves, no least script is known to
    be found in reasonable time; they are taken on top of the least script without moves, shallow fields first.
    """
    removed = {p: c for c in changes if c.kind == "removed" for p in (c.before, *paths(at(a, c.before), c.before))}
    added = [(q, c) for c in changes if c.kind == "added" for q in (c.after, *paths(at(b, c.after), c.after))]
    taken: list[tuple[str, ...]] = []
    for q, c in sorted(added, key=lambda x: (x[0] != x[1].after, len(x[0]))):
        if any(nested(q, t) for t in taken):
            continue
        source = next((p for p in sorted(removed) if p[-1] == q[-1] and p[:-1] != q[:-1] and at(a, p).types == at(b, q).types), None)
        if source:
            gone = [x for x, p in ((removed[source], source), (c, q)) if p in (x.before, x.after)]
            removed = {p: x for p, x in removed.items() if not nested(p, source)}
            taken.append(q)
            saved = at(a, source).size() + at(b, q).size()
            own, more = script(at(a, source), at(b, q), source, q)
            changes = [x for x in changes if x not in gone] + [Change("moved", source, q), *more]
            cost += 1 + own - saved
    return cost, changes


def schemas(lines: DataFrame, feed: str, seq: str, raw: str) -> DataFrame:
    """(feed, file_seq, tree): each file with its fields, as (path, types), ``types`` a set of bits."""

    def walk(into: dict, node: dict, path: tuple[str, ...]) -> None:
        for name, value in node.items():
            at = (*path, name)
            into[at] = into.get(at, 0) | TYPES.get(type(value), 0)
            if isinstance(value, dict):
                walk(into, value, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            for f, s, line in zip(*(c.to_pylist() for c in batch.columns)):
                into = found.setdefault((f, s), {(): 0})
                if record := parse_object(line):
                    walk(into, record, ())
            rows = [(f, s, list(p), t) for (f, s), paths in found.items() for p, t in paths.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32()))], names=["feed", "file_seq", "path", "types"])

    own = lines.select(lines[feed].cast("string"), lines[seq].cast("int"), lines[raw].cast("string")).where(lines[feed].isNotNull() & lines[seq].isNotNull())
    seen = own.mapInArrow(run, "feed string, file_seq int, path array<string>, types int")
    fields = seen.groupBy("feed", "file_seq", "path").agg(F.bit_or("types").alias("types"))
    return fields.groupBy("feed", "file_seq").agg(F.sort_array(F.collect_list(F.struct("path", "types"))).alias("tree"))


def tree_of(rows: list[dict]) -> Node:
    root = Node()
    for row in sorted(rows, key=lambda r: len(r["path"])):
        node = root
        for name in row["path"]:
            node = node.below.setdefault(name, Node())
        node.types = row["types"]
    return root


def changes(files: DataFrame) -> DataFrame:
    """(feed, file_seq, change, path_before, path_after, cost): the script from each file's predecessor to it.

    ``files`` is the result of ``schemas``. The first file of a feed has no rows; a file without any
    object has no fields. ``cost`` is that of the whole script. Null feeds and file numbers are left out.
    """
    order = Window.partitionBy("feed").orderBy("file_seq")
    both = files.withColumn("old", F.lag("tree").over(order)).where("old is not null").where(~F.col("old").eqNullSafe(F.col("tree")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f, s, new, old in zip(*(c.to_pylist() for c in batch.columns)):
                cost, found = script(tree_of(old), tree_of(new))
                rows += [(f, s, c.kind, list(c.before), list(c.after), cost) for c in found]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["feed", "file_seq", "change", "path_before", "path_after", "cost"])

    return both.select("feed", "file_seq", "tree", "old").mapInArrow(run, "feed string, file_seq int, change string, path_before array<string>, path_after array<string>, cost int")


def top_level(found: DataFrame) -> DataFrame:
    """The changes of top-level fields: (feed, file_seq, field_before, field_after, change).

    A field that moves below another is gone from the top; one that moves up is new there.
    """
    before, after = F.col("path_before"), F.col("path_after")
    up, down = F.size(before) == 1, F.size(after) == 1
    moved = F.col("change") == "moved"
    rows = found.withColumn("change", F.when(moved & up, "removed").when(moved & down, "added").otherwise(F.col("change")))
    rows = rows.withColumn("path_before", F.when(moved & ~up, F.array().cast("array<string>")).otherwise(before)).withColumn("path_after", F.when(moved & ~down, F.array().cast("array<string>")).otherwise(after))
    rows = rows.where((F.size("path_before") <= 1) & (F.size("path_after") <= 1) & (F.size("path_before") + F.size("path_after") > 0))
    name = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    return rows.select("feed", "file_seq", name(F.col("path_before")).alias("field_before"), name(F.col("path_after")).alias("field_after"), "change")


def sources(trees: list[Node], targets: dict[str, str] = TARGETS) -> list[dict[str, list[tuple[str, ...]]]]:
    """For each file of a feed, in order: the paths that lead to each target, the target's own name first.

    At the top, every name that means a target leads to it. Below, a path does if the scripts so far
    moved or renamed a leading path to it; what stands below a field that means another target is that field's.
    """
    senses = {meaning(t): t for t in targets}
    leads = {(t,): t for t in targets}
    last = Node(16, {t: Node(TYPES[bool] if kind == "boolean" else TYPES[str]) for t, kind in targets.items()})
    out = []
    for tree in trees:
        if tree.below:
            for c in script(last, tree)[1]:
                if c.kind in ("renamed", "moved"):
                    for path, target in [*leads.items()]:
                        now = (*c.after, *path[len(c.before) :])
                        if path[: len(c.before)] == c.before and not any(meaning(n) in senses for n in now[:-1]):
                            leads.setdefault(now, target)
            last = tree
        found: dict[str, list] = {}
        for path in paths(tree):
            if target := senses.get(meaning(path[0])) if len(path) == 1 else leads.get(path):
                found.setdefault(target, []).append(path)
        out.append({t: sorted(p, key=lambda x: (len(x), x[-1] != t, x)) for t, p in sorted(found.items())})
    return out


def projections(files: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """(feed, file_seq, sources): for each file, what ``sources`` gives, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for feed, own in zip(*(c.to_pylist() for c in batch.columns)):
                out = [json.dumps(x) for x in sources([tree_of(f["tree"]) for f in own], targets)]
                yield pa.record_batch([pa.array([feed] * len(own), pa.string()), pa.array([f["file_seq"] for f in own], pa.int32()), pa.array(out, pa.string())], names=["feed", "file_seq", "sources"])

    feeds = files.groupBy("feed").agg(F.sort_array(F.collect_list(F.struct("file_seq", "tree"))).alias("own"))
    return feeds.mapInArrow(run, "feed string, file_seq int, sources string")


def text_of(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value and value.encode("utf-8", "replace").decode()
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace").decode()


def led(target: str, value: object) -> tuple[str | None, object]:
    """The text that a value gives a target, and what is left of the value (None: nothing).

    An object gives its part of the target's meaning, else the first of ``MAIN``, else its JSON text. A
    list gives its elements joined or the first that is not null. A number gives a pmcid with its prefix.
    """
    if isinstance(value, dict):
        part = next((n for n in value if meaning(n) == meaning(target)), None) or next((n for n in MAIN if n in value), None)
        if part is None:
            return text_of(value), None
        text, left = led(target, value[part])
        return text, {n: v for n, v in value.items() if n != part} | ({} if left is None else {part: left}) or None
    if isinstance(value, list):
        given = [v for v in value if v is not None]
        if target not in JOINED:
            text, left = led(target, given[0]) if given else (None, None)
            return text, [*([] if left is None else [left]), *given[1:]] or None
        both = [led(target, v) for v in given]
        texts = [t for t, _ in both if t]
        sep = JOINED[target]
        return "".join(t + (sep[-1] if t.endswith(sep.strip()) else sep) for t in texts[:-1]) + texts[-1] if texts else None, [x for _, x in both if x is not None] or None
    if target == "pmcid" and type(value) is int:
        return f"PMC{value}", None
    return text_of(value), None


def flag(text: str | None) -> bool | None:
    said = (text or "").strip(" ").lower()
    return True if said in ("true", "y", "yes", "1") else False if said in ("false", "n", "no", "0") else None


def take(record: dict, path: list[str], target: str) -> str | None:
    """Lead the value at a path to the target; the record keeps what is left."""
    for name in path[:-1]:
        record = record.get(name)
        if not isinstance(record, dict):
            return None
    if path[-1] not in record:
        return None
    text, left = led(target, record.pop(path[-1]))
    if left is not None:
        record[path[-1]] = left
    return text


def unified(lines: DataFrame, compiled: DataFrame, *, keep: list[str], feed: str = "feed", seq: str = "file_seq", raw: str = "raw", targets: dict[str, str] = TARGETS) -> DataFrame:
    """Every object line in the shape of ``targets``, with the columns ``keep`` and the fields left over.

    Each target takes the first non-null value among the paths its file has for it. Values that a boolean
    column cannot hold become null. What an object or a list has besides the value led to a target stays
    in ``rest``, under the name of its top-level field. Lines that hold no object are left out.
    """
    both = lines.join(compiled.select(F.col("feed").alias("__f"), F.col("file_seq").alias("__s"), F.col("sources").alias("__p")), (F.col(feed) == F.col("__f")) & (F.col(seq) == F.col("__s")))
    both = both.select(*keep, F.col(raw).cast("string").alias("__raw"), "__p")
    kinds = StructType([*both.select(*keep).schema, *(StructField(t, BooleanType() if kind == "boolean" else StringType()) for t, kind in targets.items()), StructField("rest", MapType(StringType(), StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = lru_cache(1024)(json.loads)
        for batch in batches:
            at, rows, rest = [], {t: [] for t in targets}, []
            for i, (line, compiled) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())):
                if (record := parse_object(line)) is None:
                    continue
                at.append(i)
                own = plan(compiled)
                for t, kind in targets.items():
                    text = next((x for x in [take(record, p, t) for p in own.get(t, ())] if x is not None), None)
                    rows[t].append(flag(text) if kind == "boolean" else text)
                rest.append([(text_of(n), text_of(v)) for n, v in record.items()])
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            values = [pa.array(rows[t], pa.bool_() if kind == "boolean" else pa.string()) for t, kind in targets.items()]
            yield pa.record_batch([*kept, *values, pa.array(rest, pa.map_(pa.string(), pa.string()))], names=[*keep, *targets, "rest"])

    return both.mapInArrow(run, kinds)
