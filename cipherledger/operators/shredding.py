"""Deeply nested records to flat tables, by columnar shredding.

Every document is cut into its leaves; a leaf carries the path, its order in the document, a
repetition level (the depth of the repeated ancestor that this leaf starts a new element of; 0
starts the document) and a definition level (how many repeated ancestors are present). The flat
tables are rebuilt from these levels alone: running counts over a path's level sequence, taken while
the document is at hand, give the element numbers, and leaves of different paths meet on the element
numbers of shared ancestors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shape: a name maps to None (leaf), to a dict (object), to [shape] (repeated) or to {"*": shape} (map, repeated).
Shape = Mapping[str, object]

LEAVES = "key string, path string, rep int, def int, map_key string, value string"


def _entry(name: str, value: object, shape: object, path: str, rep: int, depth: int) -> Iterator[tuple]:
    """Leaves of one named part; `depth` repeated ancestors are present, `rep` is this occurrence's level."""
    if isinstance(shape, list) or (isinstance(shape, dict) and "*" in shape):
        inner = shape[0] if isinstance(shape, list) else shape["*"]
        if isinstance(value, str) and value[:1] in "[{":  # an array kept as JSON text
            try:
                value = json.loads(value)
            except ValueError:
                pass
        if isinstance(shape, dict) and isinstance(value, dict):
            elements = [(k, v) for k, v in value.items()]
        elif isinstance(value, list):
            elements = [(None, v) for v in value]
        elif value is None:
            elements = []
        else:
            elements = [(None, value)]  # a single element outside an array
        if not elements:
            yield from _absent(inner, path, rep, depth)
        for i, (k, v) in enumerate(elements):
            for leaf in _body(v, inner, path, rep if i == 0 else depth + 1, depth + 1):
                yield (*leaf[:3], k, leaf[4])
    else:
        yield from _body(value, shape, path, rep, depth)


def _body(value: object, shape: object, path: str, rep: int, depth: int) -> Iterator[tuple]:
    if shape is None:
        if isinstance(value, (dict, list)):
            value = json.dumps(value)
        elif isinstance(value, bool):
            value = str(value).lower()
        yield path, rep, depth, None, None if value is None else str(value)
        return
    for name, part in shape.items():
        if name == ".":  # the element itself, where it is a plain value
            plain = None if isinstance(value, (dict, list)) or value is None else str(value)
            yield f"{path}.", rep, depth, None, plain
        else:
            inner = value.get(name) if isinstance(value, dict) else None
            yield from _entry(name, inner, part, f"{path}.{name}" if path else name, rep, depth)


def _absent(shape: object, path: str, rep: int, depth: int) -> Iterator[tuple]:
    """Below an absent or empty repeated part each leaf path has one entry, at the depth reached."""
    if isinstance(shape, list):
        yield from _absent(shape[0], path, rep, depth)
    elif isinstance(shape, dict) and "*" in shape:
        yield from _absent(shape["*"], path, rep, depth)
    elif shape is None:
        yield path, rep, depth, None, None
    else:
        for name, part in shape.items():
            yield from _absent(part, f"{path}." if name == "." else f"{path}.{name}", rep, depth)


def element_numbers(counters: dict[str, list[int]], path: str, rep: int, depth: int, levels: int) -> list[int | None]:
    """e1 .. e<levels>: the number, from 0, of a leaf's element at each repeated ancestor, from the level sequence of its path.

    counters holds the running counts of each path of one document. A leaf that starts a new element of level rep counts
    that level on and starts the inner ones anew; a level beyond the leaf's definition level has no number.
    """
    at = counters.setdefault(path, [0] * levels)
    if rep:
        at[rep - 1] += 1
        at[rep:] = [0] * (levels - rep)
    return [n if k < depth else None for k, n in enumerate(at)]


def shred(documents: DataFrame, key: str, document: str, shape: Shape, levels: int, wrapper: str | None = None) -> DataFrame:
    """key, path, rep, def, map_key, value, e1 .. e<levels>: the leaves of each document named in `shape`, in one pass.

    A document is JSON text; its content may be wrapped in an object under `wrapper`. Text that
    isn't JSON of an object, and null, yield no leaves. Parts that the shape doesn't name are skipped.
    Leaves without a value outside every repeated part are left out once they are counted.
    """
    names = ["key", "path", "rep", "def", "map_key", "value", *[f"e{k + 1}" for k in range(levels)]]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(batch["key"], batch["document"]):
                try:
                    root = json.loads(text)
                except (TypeError, ValueError):
                    continue
                if wrapper and isinstance(root, dict) and isinstance(root.get(wrapper), dict):
                    root = root[wrapper]
                if not isinstance(root, dict):
                    continue
                counters: dict[str, list[int]] = {}
                for path, rep, depth, map_key, value in _body(root, shape, "", 0, 0):
                    numbers = element_numbers(counters, path, rep, depth, levels)
                    if depth or value is not None:
                        rows.append((k, path, rep, depth, map_key, value, *numbers))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join([LEAVES, *[f"e{k + 1} int" for k in range(levels)]])
    return documents.select(F.col(key).alias("key"), F.col(document).alias("document")).mapInPandas(leaves, schema)


def owned(leaves: DataFrame, owners: dict[str, str], paths: list[str], level: int = 1) -> DataFrame:
    """The leaves of `paths` with `owner`: what the owning leaf of their outermost element is called, null where it has no name.

    owners: outermost part to the path of its naming leaf; a map's key names an element before that leaf does. Leaves and
    their owner meet in one shuffle by document, part and element, which never hold more than one document did.
    """
    part = F.substring_index("path", ".", 1)
    named = F.lit(False)
    for prefix, path in owners.items():
        named = named | (F.col("path") == path)
    wanted = leaves.filter((F.col("path").isin(paths) | named) & (F.col("def") >= level)).withColumn("part", part)
    same = Window.partitionBy("key", "part", "e1")
    owner = F.max(F.when(named, F.coalesce("map_key", "value"))).over(same)
    return wanted.withColumn("owner", owner).filter(F.col("path").isin(paths))


def last_readable(documents: DataFrame, key: str, received: str, document: str) -> DataFrame:
    """key and document of the last received text that is JSON of an object; keys without one are left out.

    Redeliveries at the same moment: the one with the larger hash holds, so the result doesn't
    depend on the order of rows. Rows with a null key are left out.
    """
    text = F.col(document)
    readable = F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(F.translate(text, "\t\r\n", "   ")), F.lit("{"))
    never = F.lit("0001-01-01").cast(documents.schema[received].dataType)
    moment = F.struct(F.coalesce(F.col(received), never).alias("at"), F.xxhash64(text).alias("hash"))
    good = documents.filter(F.col(key).isNotNull() & F.coalesce(readable, F.lit(False)))
    return good.groupBy(key).agg(F.max_by(text, moment).alias(document))
