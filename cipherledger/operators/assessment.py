"""Risk verdicts, replacement strength and agility of assets, as column expressions.

Years are turned into days at 365.2425 a year; every rounding goes through a decimal, half up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import salted_join
from cipherledger.operators.context import RETENTION_YEARS

DAYS = 365.2425
# Probability that a capable machine exists within so many years (low, high).
CURVE = [(0.0, 0.00, 0.00), (5.0, 0.08, 0.15), (10.0, 0.28, 0.49), (15.0, 0.51, 0.70), (20.0, 0.70, 0.85), (30.0, 0.90, 0.97)]
# Classical strength by modulus, least sizes still allowed.
MODULUS_STRENGTH = [(15360, 256), (7680, 192), (3072, 128), (2048, 112), (1024, 80)]
LEAST_MODULUS, LEAST_CURVE = 2048, 224
ASYMMETRIC = ["asymmetric_factoring", "asymmetric_discrete_log"]
SAFE = ["post_quantum", "hybrid"]
# What counts as configuration.
CONFIG_ENDS = ["yaml", "yml", "json", "toml", "ini", "conf", "cfg", "properties", "env", "xml", "plist"]
CONFIG_NAMES = ["dockerfile", "docker-compose.yml", "nginx.conf", "httpd.conf", "ssl.conf", "sshd_config", "openssl.cnf"]


def rounded(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("decimal(24,9)"), digits).cast("double")


def years_from(day: Column, years: Column) -> Column:
    return F.date_add(day, F.round((years * DAYS).cast("decimal(24,9)"), 0).cast("int"))


def years_between(a: Column, b: Column) -> Column:
    return rounded(F.datediff(b, a) / DAYS)


def probability(years: Column) -> tuple[Column, Column]:
    """(low, high) by straight lines between the points of CURVE, three decimals; flat outside."""
    low, high = F.when(years <= 0, 0.0), F.when(years <= 0, 0.0)
    for (t0, l0, h0), (t1, l1, h1) in zip(CURVE, CURVE[1:]):
        part = (years - t0) / (t1 - t0)
        low, high = low.when(years <= t1, rounded(l0 + part * (l1 - l0), 3)), high.when(years <= t1, rounded(h0 + part * (h1 - h0), 3))
    return low.when(years.isNotNull(), CURVE[-1][1]), high.when(years.isNotNull(), CURVE[-1][2])


def classically_broken() -> Column:
    size, has_curve = F.coalesce("key_size_bits", F.lit(0)), F.coalesce("curve", F.lit("")) != ""
    least = F.when(F.col("algorithm_class") == "asymmetric_factoring", LEAST_MODULUS).when(F.col("algorithm_class") == "asymmetric_discrete_log", F.when(has_curve, LEAST_CURVE).otherwise(LEAST_MODULUS))
    return F.coalesce(F.col("algorithm_class") == "legacy_broken", F.lit(False)) | F.coalesce((size > 0) & (size < least), F.lit(False))


def deadline() -> tuple[Column, Column]:
    """(date from which the asset is disallowed, whether only national security rules say so)."""
    cls, size = F.col("algorithm_class"), F.coalesce("key_size_bits", F.lit(0))
    small = cls.isin("symmetric", "hash") & (size > 0) & (size < 256)
    day = F.when(cls.isin(SAFE), None).when(classically_broken(), "2023-12-31").when(cls.isin(ASYMMETRIC), "2035-12-31").when(small, "2030-12-31")
    return F.to_date(day), F.coalesce(small & ~classically_broken(), F.lit(False))


def verdicts(assets: DataFrame, today: str) -> DataFrame:
    """The assets with one column each of the four models and of the model that binds.

    assets: algorithm_class, quantum_vulnerability, key_size_bits, curve, shelf_life_x, migration_time_y,
    threat_timeline_z, business_criticality. The binding model must start first; on a tie it is the inequality.
    Safe assets are Low and bound by none; broken ones are Critical; others go by slack, and high consequence
    raises Medium and High. is_at_risk (X + Y beyond Z, safe assets never) and breach_likely (the high end of the
    probability is a half or more) stand beside the band. Assets without times have null verdicts and the band of their class, else null.
    """
    day = F.to_date(F.lit(today))
    x, y, z = F.col("shelf_life_x"), F.col("migration_time_y"), F.col("threat_timeline_z")
    limit, only_nss = deadline()
    low, high = probability(x + y)
    a = assets.withColumns(
        {
            "mosca_complete": years_from(years_from(day, z), -x),
            "mosca_slack": rounded(z - x - y),
            "breach_low": low,
            "breach_high": high,
            "exposure": F.greatest(F.lit(0.0), rounded(x + y - z)),
            "disallowed": limit,
            "only_nss": only_nss,
            "broken": classically_broken(),
            "safe": F.coalesce(F.col("algorithm_class").isin(SAFE) | F.col("quantum_vulnerability").isin("quantum_safe", "hybrid_protected"), F.lit(False)),
        }
    )
    a = a.withColumns({"mosca_start": years_from(F.col("mosca_complete"), -y), "law_start": years_from(F.col("disallowed"), -y)})
    a = a.withColumn("law_slack", years_between(day, F.col("law_start")))
    law_risk = F.coalesce((F.col("law_slack") < 0) & ~F.col("only_nss"), F.lit(False))
    law_first = F.coalesce(F.col("law_start") < F.col("mosca_start"), F.col("mosca_start").isNull() & F.col("law_start").isNotNull())
    a = a.withColumns({"binding": F.when(F.col("safe") & ~law_risk, None).when(law_first, "regulatory").when(F.col("mosca_start").isNotNull(), "mosca")})
    slack = F.when(F.col("binding") == "regulatory", F.col("law_slack")).when(F.col("binding") == "mosca", F.col("mosca_slack"))
    start = F.when(F.col("binding") == "regulatory", F.col("law_start")).when(F.col("binding") == "mosca", F.col("mosca_start"))
    heavy = F.coalesce(F.col("business_criticality").isin("High", "Critical"), F.lit(False))
    band = F.when(F.col("safe") & ~law_risk, "Low").when(F.col("broken"), "Critical").when(slack < 1, F.when(heavy, "Critical").otherwise("High")).when(slack < 3, F.when(heavy, "High").otherwise("Medium")).when(slack >= 3, "Low")
    likely = F.coalesce(F.col("breach_high") >= 0.5, F.lit(False))
    past = F.coalesce(x + y > z, F.lit(False)) & ~F.col("safe")
    return a.withColumns({"slack": slack, "start_by": start, "band": band, "overdue": F.coalesce(slack < 0, F.lit(False)), "breach_likely": likely, "is_at_risk": past, "margin": rounded(z - (x + y))})


def strength(assets: DataFrame) -> DataFrame:
    """Adds strength_bits (classical, null where unknown) and target_category (5, else 3 as the floor)."""
    size, cls = F.col("key_size_bits"), F.col("algorithm_class")
    table = reduce(lambda c, m: c.when(size >= m[0], m[1]), MODULUS_STRENGTH, F.when(F.lit(False), 0)).otherwise(80)
    known = F.coalesce(size, F.lit(0)) > 0
    bits = F.when(cls == "symmetric", size).when(~known, None).when((cls == "asymmetric_discrete_log") & (F.coalesce("curve", F.lit("")) != ""), F.floor(size / 2).cast("int")).when(cls.isin(ASYMMETRIC), table)
    category = F.when(F.col("sensitivity_profile") == "national_security", 5).when(bits >= 256, 5).otherwise(3)
    return assets.withColumns({"strength_bits": bits.cast("int"), "target_category": category})


FACTORS = [("indirection", 0.30), ("configurability", 0.30), ("concentration", 0.15), ("substitutability", 0.25)]


def agility(assets: DataFrame) -> DataFrame:
    """Adds the four factors, score, grade, the weakest factor (first of equals) and the multiplier of migration time.

    assets: parameter_source, type, target_type, location, occurrence_count, algorithm_class; nulls take the middle way.
    """
    name = F.element_at(F.split(F.lower(F.translate(F.coalesce("location", F.lit("")), "\\", "/")), "/"), -1)
    ending = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")
    kind, target, sites = F.col("type"), F.col("target_type"), F.greatest(F.coalesce("occurrence_count", F.lit(1)), F.lit(1))
    factors = {
        "indirection": F.when(F.col("parameter_source") == "dataflow", 80.0).when(F.col("parameter_source") == "literal", 30.0).otherwise(50.0),
        "configurability": F.when(kind == "hardware_module", 10.0).when(target == "binary", 5.0).when(kind == "certificate", 75.0).when(target == "dependency", 70.0).when(name.isin(CONFIG_NAMES) | ending.isin(CONFIG_ENDS), 90.0).when(kind == "protocol", 85.0).when(target == "container", 65.0).otherwise(55.0),
        "concentration": F.when(sites == 1, 90.0).otherwise(rounded(F.greatest(F.lit(20.0), 90 - 25 * F.log10(sites)), 1)),
        "substitutability": F.when(F.col("algorithm_class").isin(SAFE), 100.0).when(F.col("algorithm_class").isin("symmetric", "hash"), 95.0).when(F.col("algorithm_class").isin(ASYMMETRIC), 55.0).when(F.col("algorithm_class") == "legacy_broken", 70.0).otherwise(40.0),
    }
    out = assets.withColumns(factors)
    score = rounded(reduce(lambda a, b: a + b, [F.col(f) * w for f, w in FACTORS]), 1)
    weakest = F.array_min(F.array(*[F.struct(F.coalesce(F.col(f), F.lit(100.0)).alias("v"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, (f, _) in enumerate(FACTORS)])).getField("name")
    out = out.withColumns({"score": score, "weakest": weakest, "multiplier": F.when(F.col("indirection") >= 70, 0.9).when(F.col("indirection") <= 35, 1.2).otherwise(1.0)})
    return out.withColumn("grade", F.when(F.col("score") >= 70, "Agile").when(F.col("score") >= 40, "Moderate").otherwise("Rigid"))


def agility_estate(assets: DataFrame, by: list[str]) -> DataFrame:
    """mean_score (one decimal), n and rigid of assets with a score, from agility()."""
    return assets.groupBy(*by).agg(F.round(F.avg("score").cast("decimal(20,6)"), 1).cast("double").alias("mean_score"), F.count("*").alias("n"), F.count_if(F.col("grade") == "Rigid").alias("rigid"))


# What names a signature and what a key exchange; years a credential is trusted by type of asset, else 3.
SIGNATURES = ["DSA", "ECDSA", "EDDSA", "ED25519", "ED448", "SIGN", "SIGNATURE", "ML-DSA", "SLH-DSA", "DILITHIUM", "SPHINCS", "FALCON", "RSA-PSS", "PSS"]
EXCHANGES = ["DH", "ECDH", "X25519", "X448", "KEM", "ML-KEM", "KYBER", "KEY EXCHANGE", "KEYEXCHANGE", "ECIES"]
VALIDITY = {"certificate": 1.5, "key": 3.0, "hardware_module": 10.0, "cloud_service": 2.0, "protocol": 3.0, "library": 3.0, "algorithm": 3.0}
# Years a change takes by who owns the code (else 0.5) and by type of asset, factors, bounds.
OWNED_YEARS = {"source_code": 0.25, "dependency": 0.75, "binary": 1.5, "container": 0.5, "multi_target": 0.5}
TYPE_YEARS = {"protocol": 0.15, "certificate": 0.3, "key": 0.75, "cloud_service": 0.5, "hardware_module": 2.5}
NEGOTIATION, COORDINATION = 1.2, {"Critical": 1.3, "High": 1.15}
LEAST_YEARS, MOST_YEARS = 0.1, 6.0


def _looked_up(values: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.coalesce(key, F.lit(""))), F.lit(other))


def usage(assets: DataFrame) -> DataFrame:
    """Adds crypto_usage: what an asset is for, the reading with the longer shelf life where that is open.

    Hashes are for integrity; certificates, and what is named as a signature and not as a key exchange too, for authenticity;
    then symmetric for confidentiality, asymmetric and protocols for key transport, else unknown. Null names hold no mark.
    """
    named = F.upper(F.concat_ws(" ", "algorithm_family", "name"))
    marked = lambda marks: reduce(lambda a, b: a | b, [F.contains(named, F.lit(m)) for m in marks])
    cls, kind = F.col("algorithm_class"), F.col("type")
    use = F.when(cls == "hash", "integrity").when((kind == "certificate") | marked(SIGNATURES) & ~marked(EXCHANGES), "authenticity").when(cls == "symmetric", "confidentiality").when(cls.isin(ASYMMETRIC) | (kind == "protocol"), "key_transport").otherwise("unknown")
    return assets.withColumn("crypto_usage", use)


def risk_inputs(assets: DataFrame, scans: DataFrame) -> DataFrame:
    """Adds crypto_usage, shelf_life_x and migration_time_y to an inventory's assets with scan_id.

    X is how long a credential of the type is trusted for authenticity and integrity, else how long the scan's data are kept: its own years
    where it states them, else its profile's (financial where it has none). Y is the slower of the years by owner and by type, times
    factors for occurrences, negotiation, criticality and how the parameter is set, between 0.1 and 6 years. Assets of unknown
    scans are kept with the profile financial; repeated scans count once.
    """
    kept = scans.filter("scan_id is not null").dropDuplicates(["scan_id"]).select("scan_id", F.coalesce("retention_override_years", _looked_up(RETENTION_YEARS, F.col("sensitivity_profile"), RETENTION_YEARS["financial"])).alias("_kept"))
    rows = salted_join(usage(assets), kept, ["scan_id"], ["location"], "left")
    x = F.when(F.col("crypto_usage").isin("authenticity", "integrity"), _looked_up(VALIDITY, F.col("type"), 3.0)).otherwise(F.coalesce("_kept", F.lit(RETENTION_YEARS["financial"])))
    base = F.greatest(_looked_up(OWNED_YEARS, F.col("target_type"), 0.5), _looked_up(TYPE_YEARS, F.col("type"), 0.0))
    sites = F.greatest(F.coalesce("occurrence_count", F.lit(1)), F.lit(1))
    factors = [rounded(1 + 0.3 * F.log10(sites), 3), F.when(F.col("algorithm_class").isin(ASYMMETRIC), NEGOTIATION).otherwise(1.0), _looked_up(COORDINATION, F.col("business_criticality"), 1.0), F.when(F.col("parameter_source") == "dataflow", 0.9).when(F.col("parameter_source") == "literal", 1.2).otherwise(1.0)]
    y = rounded(F.greatest(F.lit(LEAST_YEARS), F.least(F.lit(MOST_YEARS), reduce(lambda a, b: a * b, factors, base))))
    return rows.withColumns({"shelf_life_x": x, "migration_time_y": y}).drop("_kept")
