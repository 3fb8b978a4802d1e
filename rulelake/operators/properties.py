"""Verified properties: which results bind to a property, which evidence is stale, what is still owed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers of evidence, and statuses of a property.
TIERS = ("proof", "bounded", "test")
STATUSES = ("proposed", "accepted", "retired")


def reason(result_known: Column, encodings: Column, allowed: Column, readable: bool = True) -> Column:
    """Why a result does not bind, in order; null if it does."""
    hex_ = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))
    return (F.when(F.coalesce(F.col("v") < 2, F.lit(True)), "legacy_record")
            .when(F.col("revision").isNull(), "missing_revision").when(~hex_("revision", 40), "invalid_revision")
            .when(F.col("tier").isNull(), "missing_tier").when(~F.col("tier").isin(*TIERS), "invalid_tier")
            .when(F.col("artifact_sha256").isNull(), "missing_artifact").when(~hex_("artifact_sha256", 64), "invalid_artifact")
            .when(~F.coalesce(result_known, F.lit(False)), "unknown_property").when(F.coalesce(encodings, F.lit(0)) == 0, "no_encoding")
            .when(F.lit(not readable), "allowlist_unreadable").when(~F.coalesce(allowed, F.lit(False)), "artifact_not_approved"))


def bind(results: DataFrame, properties: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """results (v, property, verifier, status, revision, tier, artifact_sha256) with the reason that they do not bind."""
    known = properties.select(F.col("id").alias("property"), F.lit(True).alias("__known"), F.size("encodings").alias("__n"))
    rows = results.join(known, "property", "left")
    if allowed is None:
        return rows.withColumn("reason", reason(F.col("__known"), F.col("__n"), F.lit(False), False)).drop("__known", "__n")
    approved = allowed.select("artifact_sha256", F.lit(True).alias("__ok")).distinct()
    return rows.join(approved, "artifact_sha256", "left").withColumn("reason", reason(F.col("__known"), F.col("__n"), F.col("__ok"))).drop("__known", "__n", "__ok")


def stale(properties: DataFrame, results: DataFrame, changed: DataFrame, head: str) -> DataFrame:
    """(property, verifier): results of an older revision for properties that depend on a changed region and have none at head."""
    touched = properties.select("id", F.explode("depends_on").alias("region")).join(changed.select("region").distinct(), "region", "left_semi").select(F.col("id").alias("property")).distinct()
    at_head = results.where(F.col("revision") == head).select("property", "verifier")
    return results.join(touched, "property", "left_semi").select("property", "verifier").distinct().join(at_head, ["property", "verifier"], "left_anti")


def obligations(properties: DataFrame, results: DataFrame, changed: DataFrame, head: str) -> DataFrame:
    """Accepted properties that depend on a changed region without a passing result at head."""
    asked = properties.where("status = 'accepted'").select("id", "kind", F.explode("depends_on").alias("region")).join(changed.select("region").distinct(), "region", "left_semi").select("id", "kind").distinct()
    done = results.where((F.col("revision") == head) & (F.col("status") == "pass")).select(F.col("property").alias("id"))
    return asked.join(done, "id", "left_anti")


def transition(properties: DataFrame, property_id: str, status: str, why: str, now: int) -> tuple[DataFrame, DataFrame]:
    """properties with the new status, and the audit row that goes first; a reason is mandatory."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    if not why.strip():
        raise ValueError("a status changes for a reason")
    own = F.col("id") == property_id
    log = properties.where(own).select("id", F.col("status").alias("was"), F.lit(status).alias("now"), F.lit(why).alias("reason"), F.lit(now).alias("ts"))
    return properties.withColumn("status", F.when(own, status).otherwise(F.col("status"))), log
