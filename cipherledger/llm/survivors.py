"""One surviving value per field for each group of reports of the same finding.

Currency reasoning: timestamped reports show which values of a field follow which others. The
majority of the observed transitions gives a precedence graph over values; its levels embed each
group's partial order. Where reports lack a timestamp, the topologically latest value is the most
current one; where all have one, the timestamps themselves are the order and nothing is learned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, salted_join
from cipherledger.functions.text import plain_path, trimmed

#: Texts that stand for no value (fixed values).
NO_VALUE = ["", "unknown", "n/a", "-"]
FIELDS = ("detected_name", "key_length", "curve_name", "version_or_mode")
GROUP = ("scan_id", "line_number", "raw_type", "path")


def field_value(df: DataFrame, name: str) -> Column:
    """The value of a field as text without outer blanks; null where it stands for no value."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double"):
        return F.when(c >= 1, c.cast("string"))
    text = trimmed(c)
    return F.when(~F.lower(text).isin(NO_VALUE), text)


def provenance_rank(metadata: str = "metadata") -> Column:
    """3 dataflow (detector names taint), 2 literal (parameters resolved), 1 assumed (not resolved), 0 unknown."""
    resolved = F.col(f"{metadata}.parameters_resolved")
    taint = F.contains(F.lower(F.coalesce(F.col(f"{metadata}.detector"), F.lit(""))), F.lit("taint"))
    return F.when(taint, 3).when(resolved, 2).when(~resolved, 1).otherwise(0)


def long_reports(evidence: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """GROUP columns, id, rank, at, field, value: one row per report and field; value null where there is none.

    Reports without a line number, scan, type, path or id belong to no group and are left out.
    """
    values = F.array(*[F.struct(F.lit(f).alias("field"), field_value(evidence, f).alias("value")) for f in fields])
    rows = evidence.select("scan_id", "line_number", "raw_type", plain_path(F.col("file_path")).alias("path"), "id", provenance_rank().alias("rank"), F.col("recorded_at").alias("at"), F.explode(values).alias("_v"))
    return rows.select(*GROUP, "id", "rank", "at", "_v.*").dropna(subset=[*GROUP, "id"])


def _peel(edges: DataFrame) -> DataFrame:
    """field, value, level: the longest chain of edges that ends in the value; null on and behind cycles.

    Each round takes the values that no value left leads to, so there are as many rounds as levels.
    """
    levels = edges.select("field", F.col("a").alias("value")).union(edges.select("field", "b")).distinct().withColumn("level", F.lit(None).cast("int"))
    k = 0
    while True:
        left = levels.filter("level is null").select("field", F.col("value").alias("a"))
        met = edges.join(left, ["field", "a"], "left_semi").select("field", F.col("b").alias("value")).distinct().withColumn("met", F.lit(True))
        levels = cut_lineage(levels.join(met, ["field", "value"], "left").select("field", "value", F.when(F.col("level").isNull() & F.col("met").isNull(), k).otherwise(F.col("level")).alias("level")))
        if levels.filter(F.col("level") == k).isEmpty():
            return levels
        k += 1


def _inside(edges: DataFrame, values: DataFrame) -> DataFrame:
    """The edges between two of the values."""
    of = lambda c: values.select("field", F.col("value").alias(c))
    return edges.join(of("a"), ["field", "a"], "left_semi").join(of("b"), ["field", "b"], "left_semi").select("field", "a", "b")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select("field", F.col("b").alias("a"), F.col("a").alias("b"))


def _least_reaching(edges: DataFrame, values: DataFrame) -> DataFrame:
    """field, value, label: the smallest value that leads to the value, itself included."""
    labels = values.select("field", "value", F.col("value").alias("label"))
    while True:
        sent = edges.join(labels.select("field", F.col("value").alias("a"), "label"), ["field", "a"]).select("field", F.col("b").alias("value"), "label", F.lit(None).cast("string").alias("was"))
        labels = cut_lineage(labels.withColumn("was", F.col("label")).union(sent).groupBy("field", "value").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        if labels.filter("label <> was").isEmpty():
            return labels.drop("was")
        labels = labels.drop("was")


def _components(edges: DataFrame) -> DataFrame:
    """field, value, part: values have the same part if each leads to the other (strongly connected components).

    Values of a part are split by the smallest value that leads to them and the smallest one they lead to,
    until no part splits: the smallest value of a part is set apart with its component each time.
    """
    values = cut_lineage(edges.select("field", F.col("a").alias("value")).union(edges.select("field", "b")).distinct())
    n = 0
    while True:
        ahead, back = _least_reaching(edges, values), _least_reaching(_turned(edges), values).withColumnRenamed("label", "to")
        parts = cut_lineage(ahead.join(back, ["field", "value"]).select("field", "value", F.struct("label", "to").alias("part")))
        found = parts.select("field", "part").distinct().count()
        if found == n:
            return parts
        n = found
        side = lambda c: parts.select("field", F.col("value").alias(c), F.col("part").alias(f"part_{c}"))
        edges = cut_lineage(edges.join(side("a"), ["field", "a"]).join(side("b"), ["field", "b"]).filter("part_a = part_b").select("field", "a", "b"))


def value_levels(reports: DataFrame) -> DataFrame:
    """field, value, level: how late a value stands in the learned order of currency (0: nothing precedes it).

    A transition is a pair of values of one group whose last reports follow each other; values
    compare without case. The direction seen more often is kept, and level is the longest chain of
    kept transitions that ends in the value, however long. Among values that lead to each other (on
    cycles) only transitions along the net flow (reports that arrive less reports that leave) are
    kept, which leaves no cycle. The graph has one node per distinct value, not per report.
    """
    value = F.lower("value").alias("value")
    seen = reports.filter("value is not null and at is not null").groupBy(*GROUP, "field", value).agg(F.max("at").alias("at"))
    follow = Window.partitionBy(*GROUP, "field").orderBy("at", "value")
    steps = seen.withColumn("a", F.lag("value").over(follow)).filter("a is not null").select("field", "a", F.col("value").alias("b"))
    # both directions of a pair meet on one row: n is positive where x before y is the majority
    pairs = steps.groupBy("field", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("n")).filter("n <> 0")
    forward = F.col("n") > 0
    edges = cut_lineage(pairs.select("field", F.when(forward, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("b"), F.abs("n").alias("n")))
    levels = _peel(edges)
    left = levels.filter("level is null")
    if left.isEmpty():
        return levels
    ahead = cut_lineage(_inside(edges, left))
    core = _peel(_turned(ahead)).filter("level is null")  # without what only lies behind cycles
    parts = _components(cut_lineage(_inside(ahead, core)))
    flow = edges.select("field", F.col("b").alias("value"), "n").union(edges.select("field", "a", -F.col("n"))).groupBy("field", "value").agg(F.sum("n").alias("flow"))
    placed = cut_lineage(flow.join(parts, ["field", "value"], "left"))
    side = lambda c: placed.select("field", F.col("value").alias(c), F.col("flow").alias(f"flow_{c}"), F.col("part").alias(f"part_{c}"))
    kept = edges.join(side("a"), ["field", "a"]).join(side("b"), ["field", "b"])
    cyclic = F.coalesce(F.col("part_a") == F.col("part_b"), F.lit(False))
    down = F.struct("flow_a", "a") < F.struct("flow_b", "b")
    return _peel(cut_lineage(kept.filter(~cyclic | down).select("field", "a", "b", "n")))


def _reports(evidence: DataFrame, fields: Sequence[str]) -> DataFrame:
    """k1, k2, id, rank, at, fields: one row per report, its group as a hash of 128 bits, its values cleaned."""
    path = plain_path(F.col("file_path"))
    key = ["scan_id", "line_number", "raw_type"]
    known = evidence.filter(" and ".join(f"{c} is not null" for c in [*key, "file_path", "id"]))
    values = [field_value(evidence, f).alias(f) for f in fields]
    return known.select(F.xxhash64(F.lit(1), *key, path).alias("k1"), F.xxhash64(F.lit(2), *key, path).alias("k2"), "id", provenance_rank().alias("rank"), F.col("recorded_at").alias("at"), *values)


def _micros() -> Column:
    return F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**62)))


def _by_time(reports: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Survivors of the groups whose reports all have a time: one aggregate by group, all fields at once."""
    best = [F.min(F.when(F.col(f).isNotNull(), F.struct((-F.col("rank")).alias("rank"), (-_micros()).alias("at"), "id", F.col(f).alias("value")))).alias(f) for f in fields]
    kept = reports.groupBy("k1", "k2").agg(F.min("id").alias("group_id"), F.max("id").alias("_last"), *best).filter("group_id <> _last")
    long = kept.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.id").alias("survivor_id"), F.col(f"{f}.value").alias("value")) for f in fields])).alias("s"))
    return long.select("group_id", "s.*").filter("survivor_id is not null")


def _by_level(reports: DataFrame, levels: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Survivors of groups in which times are missing: by the level of the value where a best report lacks its time."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = reports.select("k1", "k2", "id", "rank", "at", F.explode(values).alias("_v")).select("k1", "k2", "id", "rank", "at", "_v.*", F.lower("_v.value").alias("_l"))
    placed = salted_join(long, levels.withColumnRenamed("value", "_l"), ["field", "_l"], ["id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    valued = F.col("value").isNotNull()
    rank, late = (-F.col("rank")).alias("rank"), (-_micros()).alias("at")
    by_time = F.min(F.when(valued, F.struct(rank, late, "id", "value")))
    by_level = F.min(F.when(valued, F.struct(rank, (-F.col("level")).alias("level"), late, "id", "value")))
    untimed = F.max(F.when(valued, F.struct("rank", F.col("at").isNull().alias("missing"))))
    kept = placed.groupBy("k1", "k2", "field").agg(F.min("id").alias("group_id"), F.max("id").alias("_last"), by_time.alias("_t"), by_level.alias("_l"), untimed.alias("_u"))
    pick = F.when(F.col("_u.missing"), F.struct("_l.id", "_l.value")).otherwise(F.struct("_t.id", "_t.value"))
    return kept.filter("group_id <> _last and _t is not null").select("group_id", F.col("field").alias("field_name"), pick.alias("_p")).select("group_id", "field_name", F.col("_p.id").alias("survivor_id"), F.col("_p.value").alias("value"))


def survivors(evidence: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """group_id, field_name, survivor_id, value: for each group and field the report whose value is kept.

    A group is two or more ids with equal scan_id, line_number, raw_type and path; group_id is its
    smallest id. Among reports with a value: best provenance, then the most current, then the
    smallest id. Most current is the latest recorded_at; if a best-provenance report with a value
    lacks recorded_at, it is the topologically latest value (value_levels) and recorded_at, missing
    ones last, decides among equals. Fields without any value have no row; repeated rows count
    once; other columns are not read; no evidence, no rows.

    The order of values is learned, from all timed reports, only where some report lacks its time; groups
    without such a report go by their times in one aggregate. Hot groups: every step aggregates by group with
    map-side combine, so a group's rows are never in one task; only its distinct values meet.
    """
    reports = _reports(evidence, fields)
    untimed = reports.filter("at is null")
    if untimed.isEmpty():
        return _by_time(reports, fields)
    levels = value_levels(long_reports(evidence, fields))
    groups = untimed.select("k1", "k2").distinct()
    timed = reports.join(groups, ["k1", "k2"], "left_anti")
    others = salted_join(reports, groups, ["k1", "k2"], ["id"])
    return _by_time(timed, fields).unionByName(_by_level(others, levels, fields))


def agreement(evidence: DataFrame, share: int = 2, fields: Sequence[str] = FIELDS) -> DataFrame:
    """field_name, n_groups, learned, same_value: how well the learned order replaces times that are withheld.

    Every share-th report, by a hash of its id, loses its recorded_at; n_groups counts the groups and fields that have a
    survivor, learned those whose reports have two values or more, so that an order decides, and same_value those of them whose
    kept value is the one that all times together give, without case.
    """
    times = F.when(F.pmod(F.xxhash64("id"), F.lit(share)) != 0, F.col("recorded_at"))
    held = cut_lineage(survivors(evidence.withColumn("recorded_at", times), fields))
    whole = survivors(evidence, fields).withColumnRenamed("value", "true_value").drop("survivor_id")
    reports = long_reports(evidence, fields).filter("value is not null")
    best = reports.groupBy(*GROUP, "field").agg(F.max("rank").alias("rank"))
    tied = reports.join(best, [*GROUP, "field", "rank"]).groupBy(*GROUP, "field").agg(F.min(F.lower("value")).alias("a"), F.max(F.lower("value")).alias("z"))
    named = long_reports(evidence, fields).groupBy(*GROUP, "field").agg(F.min("id").alias("group_id")).join(tied.filter("a <> z"), [*GROUP, "field"]).select("group_id", F.col("field").alias("field_name"), F.lit(1).alias("open"))
    both = whole.join(held, ["group_id", "field_name"]).join(named, ["group_id", "field_name"], "left")
    same = (F.col("open") == 1) & (F.lower("value") == F.lower("true_value"))
    return both.groupBy("field_name").agg(F.count("*").alias("n_groups"), F.count("open").alias("learned"), F.count_if(same).alias("same_value"))
