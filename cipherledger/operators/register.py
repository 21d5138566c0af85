"""The artefact register: current rows, filters, search, ordering, pages, facets, roll-ups, horizon what-ifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions.scale import previous_in_series, salted_join
from cipherledger.functions.text import slashed
from cipherledger.operators.snapshot_changes import last_delivery

BANDS = ["Critical", "High", "Medium", "Low"]  # by rank from 0
STATUSES = ["fully_broken", "degraded", "classically_broken", "quantum_safe", "hybrid_protected", "unknown"]
# Fields of the free-text search, weights of the readiness score.
SEARCHED = ["name", "algorithm_family", "location", "system_name", "purl", "artefact_id"]
READINESS = {"Critical": 1.0, "High": 0.6, "Medium": 0.25, "Low": 0.0}
MATCH_CAP = 20_000
FAR = "9999-12-31"


def current(rows: DataFrame) -> DataFrame:
    """The register's rows: of each scan the last delivery, repeated rows once; artefact_id in lower case."""
    kept = salted_join(rows, last_delivery(rows), ["scan_id", "delivery_no"], ["artefact_id"])
    newest = Window.partitionBy("scan_id", F.lower("artefact_id")).orderBy(F.col("delivered_at").desc_nulls_last(), F.col("_id"))
    return kept.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n").withColumn("artefact_id", F.lower("artefact_id"))


def risk_rank(band: Column) -> Column:
    """0 for Critical to 3 for Low, 9 for anything else."""
    return F.when(band == "Critical", 0).when(band == "High", 1).when(band == "Medium", 2).when(band == "Low", 3).otherwise(9)


def matching(rows: DataFrame, search: str = "", overdue_only: bool = False, **equal: str) -> DataFrame:
    """Rows that meet all filters; an empty filter is none. Search is a substring of six fields joined by blanks, in lower case."""
    out = rows
    for name, value in equal.items():
        if value:
            out = out.filter(F.col(name) == value)
    if overdue_only:
        out = out.filter("is_overdue")
    if wanted := search.strip().lower():
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in SEARCHED]))
        out = out.filter(F.contains(text, F.lit(wanted)))
    return out


def ordering(sort_by: str) -> list[Column]:
    """Sort columns of the register; unknown names sort by risk. scan_id and artefact_id break ties."""
    rank = risk_rank(F.col("risk_category"))
    due, name = F.coalesce("must_start_by", F.lit(FAR)), F.coalesce("name", F.lit(""))
    keys = {
        "risk": [rank, due, name],
        "deadline": [due, rank],
        "system": [F.coalesce("system_name", F.lit("")), name],
        "name": [name],
        "occurrences": [F.coalesce("occurrence_count", F.lit(0)).desc()],
    }
    return [*keys.get(sort_by, keys["risk"]), F.col("scan_id"), F.col("artefact_id")]


def page(rows: DataFrame, number: int = 1, size: int = 50, sort_by: str = "risk") -> DataFrame:
    """One page of the ordered rows; number is at least 1, size between 1 and 500. Top rows only are sorted."""
    number, size = max(1, number), min(500, max(1, size))
    return rows.orderBy(*ordering(sort_by)).offset((number - 1) * size).limit(size)


def page_counts(rows: DataFrame, size: int = 50) -> DataFrame:
    """total and total_pages of matched rows: at least one page."""
    return rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("total_pages"))


def capped(rows: DataFrame, cap: int = MATCH_CAP) -> DataFrame:
    """The first `cap` matches in the order of scan and artefact, and whether there were more (results_capped)."""
    total = rows.agg(F.count("*").alias("n"))
    return rows.orderBy("scan_id", "artefact_id").limit(cap).agg(F.count("*").alias("kept")).join(total).select("kept", (F.col("n") > cap).alias("results_capped"))


def capped_page(rows: DataFrame, number: int = 1, size: int = 50, sort_by: str = "risk", cap: int = MATCH_CAP) -> DataFrame:
    """One page of the first `cap` matches in the order of scan and artefact, sorted only then; results_capped tells whether there were more.

    One row beyond the cap is read to tell that, so the matches are not counted.
    """
    first = rows.orderBy("scan_id", "artefact_id").limit(cap + 1)
    place, every = Window.orderBy("scan_id", "artefact_id"), Window.partitionBy(F.lit(1))
    kept = first.withColumn("_place", F.row_number().over(place)).withColumn("results_capped", F.count("*").over(every) > cap).filter(F.col("_place") <= cap).drop("_place")
    return page(kept, number, size, sort_by)


def file_name(path: Column) -> Column:
    """The last part of a path, the path itself if that is empty; a dash where there is no path."""
    p = slashed(path)
    last = F.element_at(F.split(p, "/"), -1)
    return F.when(F.coalesce(path, F.lit("")) == "", "\u2014").when(last == "", path).otherwise(last)


def short_path(path: Column, most: int = 48) -> Column:
    """A path of at most `most` characters, else as many of its first directories as leave room for the file name, an ellipsis and that name.

    A file name that leaves no room stands whole behind the ellipsis; a dash where there is no path.
    """
    p = slashed(path)
    last = F.element_at(F.split(p, "/"), -1)
    room = F.lit(most - 4) - F.length(last)
    directories = F.substr(p, F.lit(1), F.length(p) - F.length(last))
    head = F.regexp_extract(F.substr(directories, F.lit(1), F.greatest(room, F.lit(0))), "^(.*/)", 1)
    return F.when(F.coalesce(path, F.lit("")) == "", "\u2014").when(F.length(p) <= most, p).when(room <= 0, F.concat(F.lit("\u2026/"), last)).otherwise(F.concat(head, F.lit("\u2026/"), last))


def facets(rows: DataFrame) -> DataFrame:
    """facet, value, n: distinct non-empty values of system, family and vulnerability, in one pass."""
    columns = ["system_name", "algorithm_family", "quantum_vulnerability"]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("f")).select("f.*")
    return long.filter(F.coalesce("value", F.lit("")) != "").groupBy("facet", "value").agg(F.count("*").alias("n"))


def readiness(rows: DataFrame, by: list[str]) -> DataFrame:
    """readiness: 100 less the mean weight of the bands in percent, one decimal; rows without a band weigh nothing but count."""
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in READINESS.items() for x in (F.lit(k), F.lit(v))]), F.coalesce("risk_category", F.lit(""))), F.lit(0.0))
    score = 100 * (1 - F.sum(weight) / F.count("*"))
    return rows.groupBy(*by).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).cast("decimal(20,6)"), 1).cast("double").alias("readiness"), F.count("*").alias("n"))


def readiness_label(score: Column) -> Column:
    return F.when(score >= 80, "Ready").when(score >= 50, "Progressing").when(score >= 25, "At risk").otherwise("Exposed")


def histograms(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each band and each vulnerability status, zero where there are none."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("risk_category") == b).alias(f"risk_{b.lower()}") for b in BANDS], *[F.count_if(F.col("quantum_vulnerability") == s).alias(f"status_{s}") for s in STATUSES])


def rollup(rows: DataFrame, today: str) -> DataFrame:
    """Per scan: next deadline from `today` on, overdue assets, longest migration, occurrences, advisories."""
    due = F.when(F.col("must_start_by") >= today, F.substring("must_start_by", 1, 10))
    return rows.groupBy("scan_id").agg(
        F.min(due).alias("next_deadline"), F.count_if("is_overdue").alias("overdue"), F.max("migration_time_y").alias("longest_y"), F.sum("occurrence_count").alias("occurrences"), F.sum("known_vulnerability_count").alias("advisories"), F.count("*").alias("assets")
    )


def estate(rows: DataFrame) -> DataFrame:
    """Totals of each system and of the whole estate (system_name null), in one pass."""
    return rows.groupingSets([[F.col("system_name")], []], F.col("system_name")).agg(
        F.grouping("system_name").cast("int").alias("is_total"), F.count("*").alias("assets"), F.count_distinct("scan_id").alias("scans"), F.sum("occurrence_count").alias("occurrences"), F.count_if(F.col("risk_category") == "Critical").alias("critical"), F.count_if("is_overdue").alias("overdue")
    )


def horizons(rows: DataFrame, years: list[int]) -> DataFrame:
    """z, band, n: how many assets fall into each band if the horizon were z years, for each z; zero where none.

    Safe classes are Low, broken ones Critical; else slack below 1 is High, below 3 Medium, else Low, and
    a consequence of High or Critical raises Medium and High by one. Assets without times count in no band.
    Assets are first counted by class, consequence and time, so the what-if runs over groups.
    """
    groups = rows.groupBy("algorithm_class", "business_criticality", (F.col("shelf_life_x") + F.col("migration_time_y")).alias("time")).agg(F.count("*").alias("n"))
    at = groups.withColumn("z", F.explode(F.array(*map(F.lit, years))))
    margin, heavy = F.col("z") - F.col("time"), F.coalesce(F.col("business_criticality").isin("High", "Critical"), F.lit(False))
    band = (
        F.when(F.col("algorithm_class").isin("post_quantum", "hybrid"), "Low")
        .when(F.col("algorithm_class") == "legacy_broken", "Critical")
        .when(margin < 1, F.when(heavy, "Critical").otherwise("High"))
        .when(margin < 3, F.when(heavy, "High").otherwise("Medium"))
        .when(margin >= 3, "Low")
    )
    counted = at.withColumn("band", band).groupBy("z").agg(*[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("n"))), F.lit(0)).alias(b) for b in BANDS])
    return counted.unpivot("z", BANDS, "band", "n")


def scan_delta(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, family, type, path, bucket, occurrence_delta, rank moves of assets of consecutive scans.

    pairs: scan_id, prev_scan_id. Assets are the same if family, type and path (slashes alike) are; of
    several in one scan the last by artefact_id counts. bucket is the first that holds of added, removed,
    worsened, improved, parameters_changed (key size or curve), unchanged. Null is a value.
    """
    key = ["algorithm_family", "type", "path"]
    rank = F.when(F.col("risk_category") == "Critical", 3).when(F.col("risk_category") == "High", 2).when(F.col("risk_category") == "Medium", 1).when(F.col("risk_category") == "Low", 0).otherwise(-1)
    blank = F.lit("")
    assets = rows.select("scan_id", F.coalesce("algorithm_family", blank).alias("algorithm_family"), F.coalesce("type", blank).alias("type"), slashed(F.coalesce(F.trim("location"), blank)).alias("path"), "artefact_id", F.struct("artefact_id", rank.alias("rank"), F.coalesce("key_size_bits", F.lit(-1)).alias("size"), F.coalesce(F.trim("curve"), blank).alias("curve"), "occurrence_count").alias("v"))
    assets = assets.groupBy("scan_id", *key).agg(F.max_by("v", "artefact_id").alias("v"))
    sides = pairs.filter("prev_scan_id is not null")
    now = salted_join(assets, sides.select("scan_id"), ["scan_id"], ["path"]).withColumnRenamed("v", "now")
    then = salted_join(assets.withColumnRenamed("scan_id", "prev_scan_id"), sides, ["prev_scan_id"], ["path"]).drop("prev_scan_id").withColumnRenamed("v", "then")
    both = now.join(then, ["scan_id", *key], "full")
    changed = (F.col("now.size") != F.col("then.size")) | (F.col("now.curve") != F.col("then.curve"))
    bucket = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now.rank") > F.col("then.rank"), "worsened").when(F.col("now.rank") < F.col("then.rank"), "improved").when(changed, "parameters_changed").otherwise("unchanged")
    return both.select("scan_id", *key, bucket.alias("bucket"), (F.col("now.occurrence_count") - F.col("then.occurrence_count")).alias("occurrence_delta"), F.col("now.rank").alias("rank_now"), F.col("then.rank").alias("rank_then"))


def asset_changes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, family, type, path, parameter, before, after and previous_ columns of assets in both of two consecutive scans.

    One row for each parameter (key_size_bits, curve) that differs, null and blank curve being one value, null and a size two;
    an asset without such a change has no row. previous_name, previous_risk_category and occurrence_delta tell what else moved.
    Assets and the one of several that counts are those of scan_delta.
    """
    key = ["algorithm_family", "type", "path"]
    blank = F.lit("")
    value = F.struct("artefact_id", "key_size_bits", F.coalesce(F.trim("curve"), blank).alias("curve"), "name", "risk_category", "occurrence_count").alias("v")
    assets = rows.select("scan_id", F.coalesce("algorithm_family", blank).alias("algorithm_family"), F.coalesce("type", blank).alias("type"), slashed(F.coalesce(F.trim("location"), blank)).alias("path"), "artefact_id", value)
    assets = assets.groupBy("scan_id", *key).agg(F.max_by("v", "artefact_id").alias("v"))
    sides = pairs.filter("prev_scan_id is not null")
    now = salted_join(assets, sides.select("scan_id"), ["scan_id"], ["path"]).withColumnRenamed("v", "now")
    then = salted_join(assets.withColumnRenamed("scan_id", "prev_scan_id"), sides, ["prev_scan_id"], ["path"]).drop("prev_scan_id").withColumnRenamed("v", "then")
    both = now.join(then, ["scan_id", *key])
    change = lambda c: F.when(~F.col(f"now.{c}").eqNullSafe(F.col(f"then.{c}")), F.struct(F.lit(c).alias("parameter"), F.col(f"then.{c}").cast("string").alias("before"), F.col(f"now.{c}").cast("string").alias("after")))
    return both.select(
        "scan_id", *key, F.explode(F.array_compact(F.array(change("key_size_bits"), change("curve")))).alias("c"), F.col("then.name").alias("previous_name"), F.col("then.risk_category").alias("previous_risk_category"),
        (F.col("now.occurrence_count") - F.col("then.occurrence_count")).alias("occurrence_delta"),
    ).select("scan_id", *key, "c.*", "previous_name", "previous_risk_category", "occurrence_delta")


def band_movement(scans: DataFrame) -> DataFrame:
    """scan_id, prev_scan_id, band, movement, readiness_delta: how each band of a summary's distribution moved since the scan before.

    Bands of either summary count, 0 where one lacks them; readiness_delta has one decimal. Repeated rows count once.
    """
    once = scans.filter("scan_id is not null").dropDuplicates(["scan_id"])
    pairs = previous_in_series(once, ["installation_id", "target_name"], F.col("created_at"), "scan_id", ["scan_id", "risk_distribution", "quantum_readiness_score"]).filter("prev_scan_id is not null")
    held = lambda c: F.coalesce(F.col(c), F.create_map().cast("map<string,int>"))
    bands = F.array_union(F.map_keys(held("risk_distribution")), F.map_keys(held("prev_risk_distribution")))
    rows = pairs.withColumn("band", F.explode(bands))
    count = lambda c: F.coalesce(F.element_at(held(c), F.col("band")), F.lit(0))
    delta = F.round((F.col("quantum_readiness_score") - F.col("prev_quantum_readiness_score")).cast("decimal(20,6)"), 1).cast("double")
    return rows.select("scan_id", "prev_scan_id", "band", (count("risk_distribution") - count("prev_risk_distribution")).alias("movement"), delta.alias("readiness_delta"))


def long_lead(rows: DataFrame, least: float = 1.0) -> DataFrame:
    """scan_id, artefact_id, migration_time_y, critical_path: assets whose migration takes `least` years or more, and the scan's longest."""
    longest = rows.groupBy("scan_id").agg(F.max("migration_time_y").alias("critical_path"))
    return salted_join(rows.filter(F.col("migration_time_y") >= least).select("scan_id", "artefact_id", "migration_time_y"), longest, ["scan_id"], ["artefact_id"])


def delta_counts(delta: DataFrame) -> DataFrame:
    """Assets per scan and bucket, and how many of them are now critical."""
    return delta.groupBy("scan_id", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("rank_now") == 3).alias("critical"))


def delta_groups(delta: DataFrame) -> DataFrame:
    """scan_id, position, label, n: the groups of a scan's comparison that hold assets, in the order they are shown; unchanged ones have none."""
    # Buckets and how they are called, in the order of display
    shown = [("added", "New"), ("worsened", "Worse"), ("parameters_changed", "Changed"), ("improved", "Improved"), ("removed", "Removed")]
    position = F.array_position(F.array(*[F.lit(b) for b, _ in shown]), F.col("bucket")).cast("int")
    label = F.get(F.array(*[F.lit(name) for _, name in shown]), F.col("position") - 1)
    return delta.groupBy("scan_id", "bucket").agg(F.count("*").alias("n")).withColumn("position", position).filter("position > 0").select("scan_id", "position", label.alias("label"), "n")


def by_standard(rows: DataFrame) -> DataFrame:
    """Assets by target standard: how many, and the worst band."""
    return rows.filter("recommended_standard is not null").groupBy("recommended_standard").agg(F.count("*").alias("n"), F.min(risk_rank(F.col("risk_category"))).alias("worst_rank"))


def wave_of(today: str) -> Column:
    """Number of a row's migration wave by the years until it must start: 0 due, 1 under a year, 2 under three, 3 under five, 4 later."""
    slack = F.round((F.datediff(F.to_date(F.substring("must_start_by", 1, 10)), F.to_date(F.lit(today))) / 365.2425).cast("decimal(20,8)"), 2)
    return F.when(slack <= 0, 0).when(slack < 1, 1).when(slack < 3, 2).when(slack < 5, 3).otherwise(4)


def wave_sequence(rows: DataFrame, today: str) -> DataFrame:
    """scan_id, sequence, wave, artefact_id: every member of a scan's waves, the waves that have members numbered from 0.

    Assets without a start date are in none. A scan has five waves at most, so what is joined back is small for each scan.
    """
    members = rows.filter("must_start_by is not null").select("scan_id", "artefact_id", wave_of(today).alias("wave"))
    held = members.groupBy("scan_id").agg(F.array_sort(F.collect_set("wave")).alias("held"))
    placed = salted_join(members, held, ["scan_id"], ["artefact_id"])
    return placed.select("scan_id", (F.array_position("held", F.col("wave")) - 1).cast("int").alias("sequence"), "wave", "artefact_id")


def waves(rows: DataFrame, today: str) -> DataFrame:
    """Migration waves: assets by slack until they must start, with bounds, sizes and shortfall.

    Waves: 0 due, 1 under a year, 2 under three, 3 under five, 4 later; assets without a start date are in none.
    """
    day = F.to_date(F.lit(today))
    start, end = F.to_date(F.substring("must_start_by", 1, 10)), F.to_date(F.substring("must_complete_by", 1, 10))
    grouped = rows.filter("must_start_by is not null").withColumns({"wave": wave_of(today), "_s": start, "_e": end}).groupBy("scan_id", "wave")
    out = grouped.agg(F.count("*").alias("assets"), F.greatest(F.min("_s"), day).alias("starts"), F.min("_e").alias("deadline"), F.max("migration_time_y").alias("longest_y"), *[F.count_if(F.col("risk_category") == b).alias(b.lower()) for b in BANDS])
    years = F.round((F.datediff("deadline", "starts") / 365.2425).cast("decimal(20,8)"), 2).cast("double")
    short = F.round((F.col("longest_y") - years).cast("decimal(20,8)"), 2).cast("double")
    return out.withColumns({"shortfall": short, "infeasible": short > 0, "breached": F.col("deadline") < F.col("starts")}).withColumns({"starts": F.col("starts").cast("string"), "deadline": F.col("deadline").cast("string")})


def inventory_filter(rows: DataFrame, search: str = "", **equal: str) -> DataFrame:
    """Rows that meet the filters, where the search is a substring of any single field, unlike `matching`."""
    out = matching(rows, **equal)
    if wanted := search.strip().lower():
        fields = ["name", "algorithm_family", "location", "artefact_id"]
        any_field = F.lit(False)
        for c in fields:
            any_field = any_field | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted))
        out = out.filter(any_field)
    return out


def wave_members(rows: DataFrame, today: str, first: int = 20) -> DataFrame:
    """The `first` rows of each scan and migration wave, by band, then deadline; place counts from 1."""
    order = Window.partitionBy("scan_id", "wave").orderBy(risk_rank(F.col("risk_category")), F.coalesce("must_complete_by", F.lit(FAR)), "artefact_id")
    return rows.filter("must_start_by is not null").withColumn("wave", wave_of(today)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first)


def nearest_horizon(scans: DataFrame, years: list[int]) -> DataFrame:
    """scan_id, horizon: of the sampled horizons the one nearest to the scan's own, the first of equals; null without one."""
    at = F.array_min(F.array(*[F.struct(F.abs(F.col("mosca_global_z") - y).alias("gap"), F.lit(i).alias("i"), F.lit(y).alias("y")) for i, y in enumerate(years)]))
    return scans.dropDuplicates(["scan_id"]).select("scan_id", F.when(F.col("mosca_global_z").isNotNull(), at.getField("y")).alias("horizon"))


def binary_offsets(evidence: DataFrame, cap: int = 12) -> DataFrame:
    """id, place, total: signature matches in binaries by offset, at most `cap` shown per file and pattern, all counted.

    Matches of one pattern at one offset count once, by the smallest id; matches without an offset come last.
    """
    own = evidence.filter("target_type = 'binary' and id is not null").select("id", "scan_id", "file_path", "matched_pattern", "column_number").dropDuplicates(["id"])
    key = ["scan_id", "file_path", "matched_pattern"]
    once = own.groupBy(*key, "column_number").agg(F.min("id").alias("id"))
    totals = once.groupBy(*key).agg(F.count("*").alias("total"))
    order = Window.partitionBy(*key).orderBy(F.col("column_number").asc_nulls_last(), "id")
    shown = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
    on = [shown[c].eqNullSafe(totals[c]) for c in key]
    return shown.join(totals, on).select("id", "place", "total")
