"""Scan documents as flat child tables with parent, position and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage
from cipherledger.operators.shredding import last_readable, owned, shred

_LOCATION = {".": None, "location": {".": None, "path": None}}
#: The parts of a scan document that the flat tables need.
SCAN_SHAPE = {
    "artefacts": [
        {
            "id": None,
            "occurrences": [_LOCATION],
            "known_vulnerabilities": [{"aliases": [None]}],
        }
    ],
    "risk_assessments": {"*": {"artefact_id": None, "model_verdicts": [{".": None, "model": None}]}},
}


#: Leaves that name the outermost elements: artefacts by their id, assessments by what they are filed under.
OWNERS = {"artefacts": "artefacts.id", "risk_assessments": "risk_assessments.artefact_id"}


def scan_children(documents: DataFrame) -> DataFrame:
    """scan_id, artefact_id, child, parent_pos, pos, value of occurrences, aliases and verdicts.

    Missing values count in pos and parent_pos but are not listed; blank values are values. An
    artefact without an id has no rows, as its rows could not be told apart. Assessments are filed
    under their key in a map, else under their artefact_id. Empty tables give no rows.
    """
    leaves = shred(last_readable(documents, "scan_id", "received_at", "document"), "scan_id", "document", SCAN_SHAPE, 3, wrapper="result")
    occurrence, alias, verdict = (
        ["artefacts.occurrences.", "artefacts.occurrences.location.", "artefacts.occurrences.location.path"],
        ["artefacts.known_vulnerabilities.aliases"],
        ["risk_assessments.model_verdicts.", "risk_assessments.model_verdicts.model"],
    )
    path = F.col("path")
    child = F.when(path.isin(occurrence), "occurrence").when(path.isin(alias), "alias").otherwise("verdict")
    depth = F.when(path.isin(alias), 3).otherwise(2)
    present = leaves.filter(path.isin(list(OWNERS.values())) | F.col("value").isNotNull() & (F.col("def") >= depth))
    rows = owned(present, OWNERS, [*occurrence, *alias, *verdict]).filter("owner is not null")
    nested = child == "alias"
    return rows.select(F.col("key").alias("scan_id"), F.col("owner").alias("artefact_id"), child.alias("child"), F.when(nested, F.col("e2")).otherwise(0).alias("parent_pos"), F.when(nested, F.col("e3")).otherwise(F.col("e2")).alias("pos"), "value")


REGISTER_SHAPE = {
    "summary": {"target_name": None},
    "artefacts": [
        {
            "id": None,
            "name": None,
            "type": None,
            "algorithm_family": None,
            "target_type": None,
            "location": None,
            "classification": {"algorithm_class": None, "quantum_vulnerability": None},
            "known_vulnerabilities": [{"id": None, "severity": None}],
        }
    ],
    "risk_assessments": {"*": {"artefact_id": None, "risk_category": None, "shelf_life_x": None, "migration_time_y": None, "is_overdue": None, "binding_model": None}},
}
_ARTEFACT = ["id", "name", "type", "algorithm_family", "target_type", "location", "classification.algorithm_class", "classification.quantum_vulnerability"]
_RISK = ["artefact_id", "risk_category", "shelf_life_x", "migration_time_y", "is_overdue", "binding_model"]
# Ranks of an advisory's severity.
SEVERITIES = ["critical", "high", "moderate", "low"]


def register_rows(documents: DataFrame) -> DataFrame:
    """Register rows of each scan's last readable document: artefacts with their assessment, where there is one.

    worst_severity is the worst of the artefact's advisories, null without any. An assessment is filed under its
    map key, else its artefact_id; of several for one artefact the larger values count. Artefacts without an id
    keep their row; missing overdue marks are false.
    """
    leaves = shred(last_readable(documents, "scan_id", "received_at", "document"), "scan_id", "document", REGISTER_SHAPE, 2, wrapper="result")
    value_at = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    severity = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.when(F.lower("value") == "medium", "moderate").otherwise(F.lower("value")))
    advisory = (F.col("path") == "artefacts.known_vulnerabilities.severity") & (F.col("def") >= 2)
    # one aggregate by element over all leaves, so documents are read once; everything else comes from this table
    elements = leaves.groupBy("key", F.substring_index("path", ".", 1).alias("part"), "e1").agg(
        *[value_at(f"artefacts.{n}").alias(n.rpartition(".")[2]) for n in _ARTEFACT], *[value_at(f"risk_assessments.{n}").alias(n) for n in _RISK], F.max("map_key").alias("map_key"),
        value_at("summary.target_name").alias("system_name"), F.count(F.when(advisory, 1)).alias("advisories"), F.min(F.when(advisory & (severity > 0), severity)).alias("worst"),
    )
    elements = cut_lineage(elements)
    assets = elements.filter("part = 'artefacts' and e1 is not null").select("key", *[n.rpartition(".")[2] for n in _ARTEFACT], "advisories", "worst")
    risks = elements.filter("part = 'risk_assessments' and e1 is not null").withColumn("id", F.coalesce("map_key", "artefact_id")).filter("id is not null")
    risks = risks.groupBy("key", "id").agg(*[F.max(c).alias(c) for c in _RISK[1:]])
    names = elements.filter("part = 'summary'").select("key", "system_name")
    out = assets.join(risks, ["key", "id"], "left").join(names, "key", "left")
    return out.select(
        F.col("key").alias("scan_id"), F.coalesce("system_name", F.lit("Unknown system")).alias("system_name"), F.col("id").alias("artefact_id"), "name", "type", "algorithm_family", "algorithm_class", "quantum_vulnerability", "target_type", "location",
        F.col("advisories").cast("int").alias("known_vulnerability_count"), F.get(F.array(*map(F.lit, SEVERITIES)), F.col("worst").cast("int") - 1).alias("worst_severity"),
        "risk_category", F.col("shelf_life_x").try_cast("double").alias("shelf_life_x"), F.col("migration_time_y").try_cast("double").alias("migration_time_y"), F.coalesce(F.col("is_overdue") == "true", F.lit(False)).alias("is_overdue"), "binding_model",
    )


TABLES_SHAPE = {
    "artefacts": [
        {
            "id": None,
            "occurrences": [{"line_number": None, "snippet": None, **_LOCATION}],
            "known_vulnerabilities": [{"id": None, "severity": None, "fixed_version": None}],
        }
    ],
    "risk_assessments": {"*": {"artefact_id": None, "model_verdicts": [{"model": None, "at_risk": None, "slack_years": None, "must_start_by": None, "probability": {"low": None, "high": None}}]}},
}


def scan_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The child tables occurrences, advisories and verdicts of each scan's last readable document.

    Each row knows its scan_id, artefact_id and pos in its array; every element has a row, also one
    without values. Of several shapes of a field the first that has a value counts. Rows of artefacts
    without an id, and of assessments filed under none, are left out.
    """
    leaves = shred(last_readable(documents, "scan_id", "received_at", "document"), "scan_id", "document", TABLES_SHAPE, 2, wrapper="result")
    named = {
        "occurrences": ("artefacts.occurrences", {"location": [".", ".location.", ".location.path"], "line_number": [".line_number"], "snippet": [".snippet"]}),
        "advisories": ("artefacts.known_vulnerabilities", {"advisory_id": [".id"], "severity": [".severity"], "fixed_version": [".fixed_version"]}),
        "verdicts": ("risk_assessments.model_verdicts", {"model": [".model"], "at_risk": [".at_risk"], "slack_years": [".slack_years"], "must_start_by": [".must_start_by"], "low": [".probability.low"], "high": [".probability.high"]}),
    }
    typed = {"line_number": "int", "slack_years": "double", "low": "double", "high": "double", "at_risk": "boolean"}
    out = {}
    for table, (prefix, names) in named.items():
        paths = [f"{prefix}{p}" for ps in names.values() for p in ps]
        own = owned(leaves, {k: v for k, v in OWNERS.items() if prefix.startswith(k)}, paths).filter((F.col("def") >= 2) & F.col("owner").isNotNull())
        columns = [F.coalesce(*[F.max(F.when(F.col("path") == f"{prefix}{p}", F.col("value"))) for p in ps]).alias(name) for name, ps in names.items()]
        rows = own.groupBy("key", "part", "e1", F.col("e2").alias("pos")).agg(F.max("owner").alias("artefact_id"), *columns)
        out[table] = rows.select(F.col("key").alias("scan_id"), "artefact_id", "pos", *[F.col(c).try_cast(typed.get(c, "string")).alias(c) for c in names])
    return out


ADVISORY_SHAPE = {"artefacts": [{"id": None, "known_vulnerabilities": [{"id": None, "summary": None, "severity": None, "fixed_version": None, "reference_url": None, "aliases": [None]}]}]}


def bill_vulnerabilities(documents: DataFrame) -> DataFrame:
    """The advisories of each scan's last readable document as the entries of a bill of materials, which point to their component.

    scan_id, artefact_id, pos, bom_ref (artefact and advisory), id, url, description, aliases (in their order, without missing ones), severity,
    rating (null where the severity is not known), recommendation (null without a fixed version). severity is the stated label, first letters
    large; `See CVSS` for a vector; `Unknown` for none. Advisories without an id and those of artefacts without one are left out.
    """
    leaves = shred(last_readable(documents, "scan_id", "received_at", "document"), "scan_id", "document", ADVISORY_SHAPE, 3, wrapper="result")
    prefix = "artefacts.known_vulnerabilities."
    names = ["id", "summary", "severity", "fixed_version", "reference_url"]
    own = owned(leaves, {"artefacts": OWNERS["artefacts"]}, [f"{prefix}{n}" for n in (*names, "aliases")]).filter((F.col("def") >= 2) & F.col("owner").isNotNull())
    value_at = lambda n: F.max(F.when(F.col("path") == f"{prefix}{n}", F.nullif("value", F.lit(""))))
    alias = F.when((F.col("path") == f"{prefix}aliases") & F.col("value").isNotNull() & (F.col("def") >= 3), F.struct("e3", "value"))
    rows = own.groupBy("key", "owner", "e1", "e2").agg(*[value_at(n).alias(n) for n in names], F.array_sort(F.collect_list(alias)).alias("aliases")).filter("id is not null")
    severity = F.when(F.col("severity").startswith("CVSS:"), "See CVSS").otherwise(F.coalesce(F.initcap("severity"), F.lit("Unknown")))
    return rows.select(
        F.col("key").alias("scan_id"), F.col("owner").alias("artefact_id"), F.col("e2").alias("pos"), F.concat_ws(":", "owner", "id").alias("bom_ref"), "id", F.coalesce("reference_url", F.lit("https://osv.dev")).alias("url"), F.col("summary").alias("description"),
        F.col("aliases.value").alias("aliases"), severity.alias("severity"), F.when(severity != "Unknown", F.lower(severity)).alias("rating"), F.concat(F.lit("Upgrade to "), "fixed_version", F.lit(" or later.")).alias("recommendation"),
    )
