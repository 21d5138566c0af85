"""Files whose fields drift: one typed table per entity, and a report of each change of form.

Records are loaded as maps from path to value with raw JSON kinds; paths and kinds are counted by file,
with a small signature of their values; these statistics give each file's form, consecutive files of a
feed are compared, renames are told from names, kinds and values, and typed columns are projected with
the casts that failed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, previous_in_series, salted_join

# The reference's fields of each entity that exports carry, with the type of the
# uniform table, and other names under which exports carry them.
FIELDS: Mapping[str, Mapping[str, str]] = {
    "MoscaRiskAssessment": {
        "artefact_id": "string",
        "shelf_life_x": "double",
        "migration_time_y": "double",
        "threat_timeline_z": "double",
        "risk_category": "string",
        "is_overdue": "boolean",
        "binding_model": "string",
        "must_start_by": "date",
        "must_complete_by": "date",
    },
    "ScanPathRequest": {
        "target_name": "string",
        "target_type": "string",
        "path": "string",
        "mosca_z": "double",
        "sensitivity_profile": "string",
        "retention_override_years": "double",
    },
}
OTHER_NAMES: Mapping[str, Mapping[str, Sequence[str]]] = {
    "MoscaRiskAssessment": {
        "shelf_life_x": ["x_years", "shelf_life", "shelf_life_years"],
        "migration_time_y": ["y_years", "migration_time", "migration_years"],
        "threat_timeline_z": ["z_years", "threat_timeline"],
        "risk_category": ["band", "risk_band", "risk"],
        "is_overdue": ["overdue"],
        "binding_model": ["bound_by", "governing_model"],
        "must_start_by": ["latest_start", "must_start", "start_deadline", "start_by"],
        "must_complete_by": ["finish_by", "must_complete", "complete_by", "must_finish_by"],
    },
    "ScanPathRequest": {
        "target_type": ["type"],
        "path": ["scan_path"],
        "mosca_z": ["z_years", "threat_timeline_z"],
        "sensitivity_profile": ["data_profile", "data_sensitivity", "profile", "sensitivity"],
        "retention_override_years": ["retention_years", "retention_override"],
    },
}
MODELS = ["mosca", "probabilistic", "regulatory", "hndl"]


def _plain(name: Column) -> Column:
    """A field name without case and separators."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def canonical_field(entity: Column, name: Column) -> Column:
    """The reference's field name for a file's own name; the own name where the reference lacks the field."""
    out = F.when(F.lit(False), name)
    for e, fields in FIELDS.items():
        for field in fields:
            known = [x.replace("_", "") for x in [field, *OTHER_NAMES[e].get(field, [])]]
            out = out.when((entity == e) & _plain(name).isin(known), F.lit(field))
    return out.otherwise(name)


def entries(records: DataFrame) -> DataFrame:
    """feed_name, file_name, entity, exported_at, line_no, name, field, kind, value of each entry of each readable record.

    Exact copies of a record (a file delivered twice) count once. Payloads that aren't JSON of an
    object (null, truncated) are not readable; a readable record without entries has one row
    with a null name. kind is text, number, boolean, object, list or null; value is JSON text.
    """
    once = _once(records)
    parsed = once.withColumn("_v", F.try_parse_json("payload")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    spark = records.sparkSession
    opened = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
    value = F.to_json("value")
    first = F.substring(value, 1, 1)
    kind = F.when(first == '"', "text").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first == "{", "object").when(first == "[", "list").when(value.isNotNull(), "number")
    name = F.col("key")
    return opened.select("feed_name", "file_name", "entity", "exported_at", "line_no", name.alias("name"), canonical_field(F.col("entity"), name).alias("field"), kind.alias("kind"), value.alias("value"))


#: Lines of a file that stay together when exact copies are removed, so that their statistics are added up where they are.
BLOCK_LINES = 5000


def _once(records: DataFrame) -> DataFrame:
    """The records without exact copies, by file and block of lines; lines without a number are spread by their payload."""
    line = F.coalesce(F.col("line_no").cast("long"), F.pmod(F.xxhash64("payload"), F.lit(2**20)))
    placed = records.select("feed_name", "file_name", "entity", "exported_at", "line_no", "payload", F.floor(line / BLOCK_LINES).alias("_block"))
    return placed.repartition("file_name", "_block").dropDuplicates().drop("_block")


#: Cells of a value signature: each keeps the smallest hash of the distinct values that fall into it.
CELLS = 16
_FILE = ["feed_name", "file_name", "entity", "exported_at"]
_CELLS = [f"c{i}" for i in range(CELLS)]


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {str: "text", dict: "object", list: "list"}.get(type(value), "number")


def _refuse(text: str) -> None:
    raise ValueError(text)


def path_values(record: dict) -> dict[tuple[str, str], tuple[str | None, object]]:
    """(path, kind) to (top-level name, a value of that kind) of every part of a record; [] stands for a list's elements."""
    out: dict[tuple[str, str], tuple[str | None, object]] = {}
    todo = [(k, k, v) for k, v in record.items()]
    while todo:
        name, path, value = todo.pop()
        out.setdefault((path, _kind(value)), (name, value))
        if isinstance(value, dict):
            todo += [(None, f"{path}.{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(None, f"{path}[]", v) for v in value]
    return out


def path_statistics(records: DataFrame) -> DataFrame:
    """Per file, path and kind: name (of top-level paths), n records that carry it, least and most of numbers, signature of values.

    Exact copies of a record (a file delivered twice) count once. Payloads that aren't JSON of an object (null, truncated)
    are not readable; the row with a null path counts the readable records. Statistics are added up in each Arrow
    batch first, so what is shuffled grows with files and paths, not with records. Rows without a file_name are left out.
    """
    columns = [*_FILE, "path", "name", "kind", "n", "least", "most", *_CELLS]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[tuple, list] = {}
            for *file, payload in batch[[*_FILE, "payload"]].itertuples(index=False, name=None):
                try:
                    record = json.loads(payload, parse_constant=_refuse)
                except (TypeError, ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                file = tuple(None if pd.isna(x) else x for x in file)
                held.setdefault((*file, None, None, None), [0, None, None, {}])[0] += 1
                for (path, kind), (name, value) in path_values(record).items():
                    stat = held.setdefault((*file, path, name, kind), [0, None, None, {}])
                    stat[0] += 1
                    if kind == "number":
                        stat[1] = value if stat[1] is None else min(stat[1], value)
                        stat[2] = value if stat[2] is None else max(stat[2], value)
                    if name is not None and kind in ("text", "number"):
                        h = zlib.crc32(str(value).encode("utf-8", "surrogatepass"))
                        stat[3][h % CELLS] = min(h, stat[3].get(h % CELLS, h))
            rows = [(*key, n, None if lo is None else float(lo), None if hi is None else float(hi), *[cells.get(i) for i in range(CELLS)]) for key, (n, lo, hi, cells) in held.items()]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int64" for c in _CELLS})

    of = records.schema["exported_at"].dataType.simpleString()
    schema = f"feed_name string, file_name string, entity string, exported_at {of}, path string, name string, kind string, n long, least double, most double, " + ", ".join(f"{c} long" for c in _CELLS)
    parts = _once(records.filter("file_name is not null")).mapInPandas(count, schema)
    return parts.groupBy(*_FILE, "path", "name", "kind").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.min(c).alias(c) for c in _CELLS])


def file_forms(stats: DataFrame, part: str) -> DataFrame:
    """file_name, `part`, name, kind: the parts (fields, paths) that belong to each file, from its statistics.

    A part belongs to a file if half or more of its readable records carry it. name and kind are
    the most frequent ones (ties: the smaller text); kind is null where every value is null.
    """
    # a part has few names and six kinds, so these aggregates run over a table of the size of all files' forms
    readable = stats.filter("path is null").groupBy("file_name").agg(F.sum("n").alias("n_records"))
    counted = stats.filter("path is not null").groupBy("file_name", part, "name", "kind").agg(F.sum("n").alias("n"))
    by_name = counted.groupBy("file_name", part, "name").agg(F.sum("n").alias("n")).groupBy("file_name", part).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("_"), "name")).alias("_name"))
    by_kind = counted.filter("kind <> 'null'").groupBy("file_name", part, "kind").agg(F.sum("n").alias("kn")).groupBy("file_name", part).agg(F.min(F.struct((-F.col("kn")).alias("_"), "kind")).alias("_kind"))
    joined = by_name.join(by_kind, ["file_name", part], "left").join(readable, "file_name")
    return joined.filter("2 * n >= n_records").select("file_name", part, F.col("_name.name").alias("name"), F.col("_kind.kind").alias("kind"))


def _steps(stats: DataFrame) -> DataFrame:
    """file_name, feed_name, entity, prev_file_name: each file and its feed's file before it; a feed's first file has none.

    Files of a feed follow each other by exported_at, then name; files without a readable record have no form.
    """
    files = stats.filter("path is null").groupBy("file_name").agg(F.min(F.struct("exported_at", "feed_name", "entity")).alias("f")).select("file_name", "f.*")
    return previous_in_series(files, ["feed_name"], F.col("exported_at"), "file_name", ["file_name"]).filter("prev_file_name is not null").select("file_name", "feed_name", "entity", "prev_file_name")


def _compared(forms: DataFrame, steps: DataFrame, part: str) -> DataFrame:
    """file_name, `part`, now, then: the forms of a file beside those of the file before it."""
    form = F.struct("name", "kind")
    now = salted_join(forms, steps.select("file_name"), ["file_name"], [part]).select("file_name", part, form.alias("now"))
    then = salted_join(forms.withColumnRenamed("file_name", "prev_file_name"), steps.select("file_name", "prev_file_name"), ["prev_file_name"], [part]).select("file_name", part, form.alias("then"))
    return now.join(then, ["file_name", part], "full")


#: What a field that leaves and one that enters must reach together to be one field under a new name: half for names, half for values.
ALIKE = 0.45


def _tokens(name: Column) -> Column:
    """The parts of a name, cut at separators and capitals, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda t: t != ""))


def proposed_renames(stats: DataFrame, steps: DataFrame, compared: DataFrame) -> DataFrame:
    """file_name, old, new, old_name, new_name: fields that left a file's form as others entered it, and are alike.

    Alike are fields of one kind whose names (shared parts, edits) and values (equal cells of their signatures, common range of
    numbers) score ALIKE or more; each must be the other's best. Pairs meet only on a shared part of the name, a
    shared cell or numbers of like size, so fields without anything in common are never put beside each other.
    """
    values = stats.filter("name is not null and kind <> 'null'").groupBy("file_name", "name", "kind").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.array(*[F.min(c) for c in _CELLS]).alias("cells"))
    gone = compared.filter("now is null").select("file_name", F.col("field").alias("old"), "then.*").join(steps.select("file_name", "prev_file_name"), "file_name")
    gone = gone.join(values.withColumnRenamed("file_name", "prev_file_name"), ["prev_file_name", "name", "kind"])
    come = compared.filter("then is null").select("file_name", F.col("field").alias("new"), "now.*").join(values, ["file_name", "name", "kind"])

    def marked(df: DataFrame, side: str, field: str) -> DataFrame:
        cells = F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: c.cast("string"))
        scale = F.floor(F.log2(1 + F.abs("most")))  # numbers meet where their sizes are within a factor of four
        sizes = F.array(F.concat(F.lit("#"), scale.cast("string")), F.concat(F.lit("#"), (scale + 1).cast("string")))
        marks = F.explode(F.array_union(_tokens(F.col("name")), F.when(F.col("kind") == "text", cells).when(F.col("kind") == "number", sizes).otherwise(F.array().cast("array<string>"))))
        return df.select("file_name", "kind", field, F.struct("name", "least", "most", "cells").alias(side), marks.alias("mark"))

    pairs = marked(gone, "a", "old").join(marked(come, "b", "new"), ["file_name", "kind", "mark"]).drop("mark").groupBy("file_name", "kind", "old", "new").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    x, y = _tokens(F.col("a.name")), _tokens(F.col("b.name"))
    shared = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    edits = 1 - F.levenshtein(F.lower("a.name"), F.lower("b.name")) / F.greatest(F.length("a.name"), F.length("b.name"))
    filled = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    equal = F.size(F.filter(F.zip_with("a.cells", "b.cells", lambda p, q: p == q), lambda same: same))
    overlap = equal / F.greatest(filled("a.cells"), filled("b.cells"), F.lit(1))
    span = F.greatest("a.most", "b.most") - F.least("a.least", "b.least")
    common = F.when(span > 0, F.greatest(F.lit(0.0), F.least("a.most", "b.most") - F.greatest("a.least", "b.least")) / span).otherwise(F.lit(0.0))
    score = 0.5 * F.greatest(shared, edits) + 0.5 * F.when(F.col("kind") == "number", F.coalesce(common, F.lit(0.0))).otherwise(overlap)
    scored = pairs.withColumn("score", score).filter(F.col("score") >= ALIKE)
    best = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "old", "new"))
    mutual = scored.withColumn("i", best("file_name", "old")).withColumn("j", best("file_name", "new")).filter("i = 1 and j = 1")
    return mutual.select("file_name", "old", "new", F.col("a.name").alias("old_name"), F.col("b.name").alias("new_name"))


def _known(entity: Column, field: Column) -> Column:
    out = F.lit(False)
    for e, fields in FIELDS.items():
        out = out | (entity == e) & field.isin(list(fields))
    return out


def _statistics_of(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics with canonical fields, steps, compared forms); the statistics are small and cut off from the records once."""
    stats = cut_lineage(path_statistics(records).withColumn("field", F.when(F.col("name").isNotNull(), canonical_field(F.col("entity"), F.col("name")))))
    steps = _steps(stats)
    forms = file_forms(stats.filter("path is null or name is not null"), "field")
    return stats, steps, cut_lineage(_compared(forms, steps, "field"))


def drift(records: DataFrame) -> DataFrame:
    """file_name, field_name, change_kind: where a file's form differs from the feed's file before it.

    records: feed_name, file_name, entity, exported_at, line_no, payload; other columns are not
    read. Files of a feed follow each other by exported_at, then name; files without a readable
    record are left out, as they have no form. change_kind is added, removed, renamed, retyped;
    the last two may both hold. A name is another name of a field if OTHER_NAMES says so, or if it
    enters as the field leaves and both are alike (proposed_renames); the change then bears the
    reference's name of either, else the file's own. Rows with a null file_name are left out. No
    records, no changes.
    """
    stats, steps, compared = _statistics_of(records)
    renames = cut_lineage(proposed_renames(stats, steps, compared))
    old, new = renames.select("file_name", F.col("old").alias("field"), F.lit(1).alias("gone")), renames.select("file_name", F.col("new").alias("field"), F.lit(1).alias("come"))
    plain = compared.join(old, ["file_name", "field"], "left").join(new, ["file_name", "field"], "left").filter("not (gone = 1 and now is null) or gone is null").filter("not (come = 1 and then is null) or come is null")
    kinds = F.array(
        F.when(F.col("then").isNull(), "added"),
        F.when(F.col("now").isNull(), "removed"),
        F.when(F.col("now.name") != F.col("then.name"), "renamed"),
        F.when(F.col("now.kind") != F.col("then.kind"), "retyped"),
    )
    told = renames.join(steps.select("file_name", "entity"), "file_name")
    e = F.col("entity")
    field = F.when(_known(e, F.col("old")), F.col("old")).otherwise(F.col("new"))
    return plain.select("file_name", F.col("field").alias("field_name"), F.explode(F.array_compact(kinds)).alias("change_kind")).unionByName(told.select("file_name", field.alias("field_name"), F.lit("renamed").alias("change_kind")))


def path_drift(records: DataFrame) -> DataFrame:
    """file_name, path, change_kind: added, removed and retyped paths at any depth since the feed's file before; [] is a list's element.

    A path belongs to a file if half or more of its readable records carry it. Names count as they are, so a rename is a
    removed and an added path.
    """
    stats = cut_lineage(path_statistics(records))
    both = _compared(file_forms(stats.withColumn("name", F.col("path")), "path"), _steps(stats), "path")
    kinds = F.array(F.when(F.col("then").isNull(), "added"), F.when(F.col("now").isNull(), "removed"), F.when(F.col("now.kind") != F.col("then.kind"), "retyped"))
    return both.select("file_name", "path", F.explode(F.array_compact(kinds)).alias("change_kind"))


def learned_names(records: DataFrame) -> DataFrame:
    """feed_name, name, learned: names that proposed_renames tells to be another name of one of the reference's fields."""
    stats, steps, compared = _statistics_of(records)
    told = proposed_renames(stats, steps, compared).join(steps, "file_name")
    e = F.col("entity")
    old = told.filter(_known(e, F.col("old"))).select("feed_name", F.col("new_name").alias("name"), F.col("old").alias("learned"))
    new = told.filter(_known(e, F.col("new"))).select("feed_name", F.col("old_name").alias("name"), F.col("new").alias("learned"))
    return old.union(new).groupBy("feed_name", "name").agg(F.min("learned").alias("learned"))


def _text(value: Column, kind: Column) -> Column:
    """The plain text of a JSON value: a text itself, a list's first element, an object's name; none of JSON's null."""
    inner = F.when(kind == "list", F.get_json_object(value, "$[0]")).when(kind == "object", F.coalesce(F.get_json_object(value, "$.model"), F.get_json_object(value, "$.name")))
    return F.when(kind == "text", F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).when(kind.isin("list", "object"), inner).when(kind != "null", value)


def _date(value: Column, kind: Column) -> Column:
    """Dates given as ISO text, `9 Oct 2032`, `09.10.2032`, 20321009, days since 1970 or {year, month, day}."""
    text = _text(value, kind)
    parts = F.make_date(*[F.get_json_object(value, f"$.{p}").try_cast("int") for p in ("year", "month", "day")])
    return (
        F.when(kind == "object", parts)
        .when((kind == "number") & text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(kind == "number", F.date_add(F.lit("1970-01-01").cast("date"), text.try_cast("int")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
        .when(text.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"), F.try_to_date(text, "d MMM yyyy"))
        .when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(text, "d.M.yyyy"))
    )


def _typed(field: str, kind_wanted: str, value: Column, kind: Column) -> Column:
    text = _text(value, kind)
    if kind_wanted == "date":
        return _date(value, kind)
    if kind_wanted == "boolean":
        return F.when(F.lower(text).isin("true", "yes", "1", "y"), True).when(F.lower(text).isin("false", "no", "0", "n"), False)
    if kind_wanted == "double":
        return text.try_cast("double")
    if field == "binding_model":  # a number is the model's place in the reference's order
        return F.when(kind == "number", F.get(F.array(*map(F.lit, MODELS)), text.try_cast("int"))).otherwise(F.lower(text))
    if field == "sensitivity_profile":  # a number is the profile's years, which name no single profile
        return F.when(kind != "number", F.lower(F.translate(text, " -", "__")))
    return F.when(kind.isin("text", "number", "boolean"), text)


def typed_table(records: DataFrame, entity: str) -> DataFrame:
    """One row per readable record of the entity: file_name, line_no, its fields in uniform types, failed_casts.

    failed_casts lists, in order, the fields whose non-null value could not be brought to the
    type. Of a field that one record carries under two names, the smaller name's value counts.
    Names that the drift between files tells to be another name of a field (learned_names) count as it.
    """
    own = records.filter((F.col("entity") == entity) & F.col("file_name").isNotNull())
    rows = salted_join(entries(own), learned_names(own), ["feed_name", "name"], ["line_no"], "left").withColumn("field", F.coalesce("learned", "field"))
    fields = FIELDS[entity]
    wide = rows.groupBy("file_name", "line_no").agg(*[F.min(F.when(F.col("field") == f, F.struct("name", "kind", "value"))).alias(f) for f in fields])
    cols, failed = [], []
    for f, wanted in fields.items():
        typed = _typed(f, wanted, F.col(f"{f}.value"), F.col(f"{f}.kind"))
        cols.append(typed.alias(f))
        failed.append(F.when((F.col(f"{f}.kind") != "null") & typed.isNull(), F.lit(f)))
    return wide.select("file_name", "line_no", *cols, F.array_compact(F.array(*failed)).alias("failed_casts"))
