"""Incidents: built from rule matches and correlations, deduplicated, merged with what is already open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.catalog import GENERIC_TEXT, pattern_texts_frame
from faultline.config import IncidentConfig
from faultline.functions.text import clip, hosted, render
from faultline.lineage import cut
from faultline.operators.dedup import EARLIER, cooldown, fingerprint
from faultline.operators.rules import RULE_FIELDS, match_rules
from faultline.schemas import ACTIVE_STATES

DEDUP_KEYS = ["host", "fingerprint"]


def _incident_id() -> Column:
    return F.sha2(F.concat_ws("|", "host", "fingerprint", F.col("ts").cast("string"), "kind"), 256)


def event_candidates(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule matches with their fingerprint."""
    return match_rules(hosted(events), rules).withColumn(
        "fingerprint", fingerprint(F.col("rule_id"), F.col("account"), F.col("ip_address"), F.col("category")))


def last_created(existing: DataFrame) -> DataFrame:
    """When each fingerprint last passed its cooldown, from the incident table: host, fingerprint, ts."""
    at = F.col("last_ts") if "last_ts" in existing.columns else F.col("updated_at")
    return hosted(existing).groupBy(*DEDUP_KEYS).agg(F.max(at).alias("ts"))


def cooled_events(events: DataFrame, rules: DataFrame, cfg: IncidentConfig = IncidentConfig(), earlier: DataFrame | None = None) -> DataFrame:
    """The matches that pass the cooldown, narrow: host, fingerprint, ts, id, n and rule_id.

    Events are matched once; only keys are kept. Rows with id EARLIER stand for ``earlier`` (see dedup.cooldown).
    """
    matches = cut(event_candidates(events, rules).select(*DEDUP_KEYS, "ts", "id", "rule_id"))
    kept = cooldown(matches, DEDUP_KEYS, cfg.cooldown_s, last_created=earlier)
    return kept.join(matches.select(*DEDUP_KEYS, "id", "rule_id"), [*DEDUP_KEYS, "id"], "left")


def incidents_from_events(events: DataFrame, rules: DataFrame, cfg: IncidentConfig = IncidentConfig(),
                          cooled: DataFrame | None = None) -> DataFrame:
    """New incidents from single events after the cooldown of their fingerprint."""
    cooled = cooled_events(events, rules, cfg) if cooled is None else cooled
    # narrow keys went through the cooldown; the wide columns come for the few that passed
    texts = rules.select("rule_id", *[F.col(c).alias(f"rule_{c}") for c in RULE_FIELDS if c != "rule_id"])
    passed = cooled.filter(F.col("id") != EARLIER).select(*DEDUP_KEYS, "id", "rule_id", "n")
    chosen = hosted(events).join(passed, ["host", "id"]).join(texts, "rule_id")
    values = {
        "message": F.col("message"), "account": F.col("account"), "ip": F.col("ip_address"),
        "domain": F.col("domain"), "source": F.col("source"), "category": F.col("category"),
        "log_file": F.nullif(F.col("log_file"), F.lit("")),
    }
    summary = F.coalesce(F.nullif(render(F.col("rule_summary"), values), F.lit("")), clip(F.col("message"), 200))
    explanation = F.coalesce(F.nullif(render(F.col("rule_explanation"), values), F.lit("")),
                             F.concat(F.lit("Event detected: "), F.col("message")))
    logs = F.when(F.coalesce(F.col("log_file"), F.lit("")) != "", F.array("log_file")).otherwise(
        F.array().cast("array<string>"))
    return chosen.withColumn("kind", F.lit("event")).select(
        _incident_id().alias("id"), "host", "ts", F.col("ts").alias("updated_at"), "severity", "category",
        F.lit("new").alias("state"), "rule_id", clip(summary, cfg.summary_chars).alias("summary"),
        clip(explanation, cfg.explanation_chars).alias("explanation"),
        F.col("account").alias("affected_account"), F.col("source").alias("affected_service"),
        F.col("domain").alias("affected_domain"), F.col("ip_address").alias("affected_ip"),
        F.array(clip(F.col("raw_line"), cfg.evidence_chars)).alias("source_evidence"),
        F.array("id").alias("event_ids"), F.col("rule_base_confidence").alias("confidence_score"),
        F.coalesce("rule_remediation", F.lit("Look into the event and act on its cause.")).alias("suggested_remediation"),
        logs.alias("logs_consulted"), "fingerprint", F.lit(1).cast("long").alias("occurrence_count"),
        F.lit(None).cast("string").alias("assigned_to"), F.lit("").alias("resolution_notes"),
        F.to_json(F.struct(F.col("rule_name").alias("rule_name"), F.col("metadata").alias("event_metadata"))).alias("metadata"),
        (F.col("n") - 1).alias("suppressed_count"))


def keyed_correlations(correlations: DataFrame) -> DataFrame:
    """Correlations with rule_id, fingerprint and an id of their own."""
    rule_id = F.concat(F.lit("corr_"), F.col("pattern"))
    return (hosted(correlations)
            .withColumn("rule_id", rule_id)
            .withColumn("fingerprint", fingerprint(rule_id, F.col("account"), F.col("ip"), F.col("category")))
            .withColumn("_id", F.sha2(F.concat_ws("|", "host", "fingerprint", F.col("win_end").cast("string"), "type"), 256)))


def cooled_keys(keyed: DataFrame, cfg: IncidentConfig = IncidentConfig(), earlier: DataFrame | None = None) -> DataFrame:
    """The cooldown of keyed_correlations: host, fingerprint, ts, id, n (see dedup.cooldown for ``earlier``)."""
    return cooldown(keyed.select(*DEDUP_KEYS, F.col("win_end").alias("ts"), F.col("_id").alias("id")), DEDUP_KEYS,
                    cfg.cooldown_s, last_created=earlier)


def cool_correlations(correlations: DataFrame, cfg: IncidentConfig = IncidentConfig(), kept: DataFrame | None = None) -> DataFrame:
    """Correlations that pass the cooldown of their fingerprint, with rule_id, fingerprint and n.

    Done before evidence is gathered, so that only correlations which become incidents need any.
    """
    keyed = keyed_correlations(correlations)
    kept = cooled_keys(keyed, cfg) if kept is None else kept
    return keyed.join(kept.select(*DEDUP_KEYS, F.col("id").alias("_id"), "n"), [*DEDUP_KEYS, "_id"]).drop("_id")


def incidents_from_correlations(cooled: DataFrame, cfg: IncidentConfig = IncidentConfig()) -> DataFrame:
    """Incidents ``corr_<pattern>`` from the result of cool_correlations with its evidence (see with_evidence)."""
    chosen = cooled.withColumnRenamed("win_end", "ts")
    texts = pattern_texts_frame(cooled.sparkSession).withColumnRenamed("severity", "text_severity")
    chosen = chosen.join(texts, "pattern", "left")
    names = F.array_sort(F.map_keys("categories"))
    values = {
        "n": F.col("event_count"), "pattern": F.col("pattern"),
        "ip": F.coalesce("ip", F.lit("unknown")), "account": F.coalesce("account", F.lit("unknown")),
        "areas": F.size(names), "names": F.array_join(names, ", "),
    }

    def text(column: str, generic: str) -> Column:
        return render(F.coalesce(column, F.lit(generic)), values)

    first_category = F.try_element_at("events", F.lit(1))["category"]
    files = F.array_distinct(F.filter(F.transform("events", lambda e: e["log_file"]), lambda f: f.isNotNull() & (f != "")))
    return chosen.select(
        F.sha2(F.concat_ws("|", "host", "fingerprint", F.col("ts").cast("string"), F.lit("correlation")), 256).alias("id"),
        "host", "ts", F.col("ts").alias("updated_at"),
        F.coalesce("text_severity", F.lit(GENERIC_TEXT.severity)).alias("severity"),
        F.coalesce("category", first_category, F.lit("system")).alias("category"), F.lit("new").alias("state"), "rule_id",
        clip(text("summary", GENERIC_TEXT.summary), cfg.summary_chars).alias("summary"),
        clip(text("explanation", GENERIC_TEXT.explanation), cfg.explanation_chars).alias("explanation"),
        F.col("account").alias("affected_account"), F.lit(None).cast("string").alias("affected_service"),
        F.lit(None).cast("string").alias("affected_domain"), F.col("ip").alias("affected_ip"),
        F.slice("evidence", 1, cfg.max_evidence).alias("source_evidence"),
        F.slice(F.transform("events", lambda e: e["id"]), 1, cfg.max_event_ids).alias("event_ids"),
        F.col("confidence").alias("confidence_score"),
        F.coalesce("remediation", F.lit(GENERIC_TEXT.remediation)).alias("suggested_remediation"),
        F.slice(F.array_sort(files), 1, cfg.max_logs).alias("logs_consulted"), "fingerprint",
        F.col("event_count").alias("occurrence_count"), F.lit(None).cast("string").alias("assigned_to"),
        F.lit("").alias("resolution_notes"),
        F.to_json(F.struct("pattern", F.col("type").alias("correlation_type"), "categories")).alias("metadata"),
        (F.col("n") - 1).alias("suppressed_count"))


def latest_active(incidents: DataFrame) -> DataFrame:
    """The newest open incident of each fingerprint."""
    newest = Window.partitionBy(*DEDUP_KEYS).orderBy(F.desc("ts"), F.desc("id"))
    return (hosted(incidents).filter(F.col("state").isin(*ACTIVE_STATES))
            .withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn"))


def match_active(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates with ``active_id``: the open incident they repeat, or null for a new one."""
    open_ids = latest_active(existing).select(*DEDUP_KEYS, F.col("id").alias("active_id"))
    return hosted(candidates).join(open_ids, DEDUP_KEYS, "left")


def merge_occurrences(candidates: DataFrame, existing: DataFrame | None = None, covered: DataFrame | None = None) -> DataFrame:
    """The incident table after a batch of candidates.

    A candidate whose fingerprint is open adds one occurrence to it; otherwise the first candidate of the fingerprint
    opens an incident and its later candidates add to that. Of several open incidents the newest counts. ``covered``
    (host, fingerprint, n): candidates that the cooldown of an earlier one covered; they count as suppressed there.
    """
    candidates = hosted(candidates)
    summed = candidates.groupBy(*DEDUP_KEYS).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("_new"),
        F.sum("suppressed_count").alias("_suppressed"), F.min_by("id", F.struct("ts", "id")).alias("id"))
    opening = candidates.drop("suppressed_count").join(summed.drop("first_ts", "last_ts"), [*DEDUP_KEYS, "id"])
    opened = (opening.join(summed.select(*DEDUP_KEYS, "first_ts", "last_ts"), DEDUP_KEYS)
              .withColumn("occurrence_count", F.col("occurrence_count") + F.col("_new") - 1)
              .withColumn("updated_at", F.col("last_ts"))
              .withColumnRenamed("_suppressed", "suppressed_count").drop("_new"))
    if existing is None:
        return opened
    active = latest_active(existing).select(*DEDUP_KEYS, "id")
    fresh = opened.join(active.select(*DEDUP_KEYS), DEDUP_KEYS, "left_anti")
    hits = (active.join(summed.drop("id"), DEDUP_KEYS)
            .select("id", "_new", F.col("last_ts").alias("_last"), F.col("_suppressed")))
    if covered is not None:
        newest = Window.partitionBy(*DEDUP_KEYS).orderBy(F.desc("last_ts"), F.desc("ts"), F.desc("id"))
        last = (hosted(existing).select(*DEDUP_KEYS, "id", "ts", F.col("last_ts" if "last_ts" in existing.columns else "updated_at").alias("last_ts"))
                .withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1"))
        more = covered.groupBy(*DEDUP_KEYS).agg(F.sum("n").alias("_covered")).join(last, DEDUP_KEYS).select("id", "_covered")
        hits = (hits.join(more, "id", "full").withColumn("_suppressed", F.coalesce("_suppressed", F.lit(0)) + F.coalesce("_covered", F.lit(0)))
                .drop("_covered"))
    old = existing if "first_ts" in existing.columns else existing.withColumns(
        {"first_ts": F.col("ts"), "last_ts": F.col("updated_at")})
    grown = (old.join(hits, "id", "left")
             .withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("_new", F.lit(0)))
             .withColumn("suppressed_count", F.coalesce("suppressed_count", F.lit(0)) + F.coalesce("_suppressed", F.lit(0)))
             .withColumn("updated_at", F.coalesce("_last", "updated_at"))
             .withColumn("last_ts", F.coalesce("_last", "last_ts")).drop("_new", "_last", "_suppressed"))
    return grown.unionByName(fresh)


def incident_events(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence drill-down: each incident with each of its listed events (at most 50 per incident)."""
    links = incidents.select(F.col("id").alias("incident_id"), F.explode("event_ids").alias("id"))
    return links.join(events, "id")


def distinct_logs(events: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """Per group, the first ``limit`` distinct log files in name order; never gathers more than that."""
    files = events.filter(F.coalesce(F.col("log_file"), F.lit("")) != "").select(*keys, "log_file").distinct()
    ranked = files.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("log_file")))
    return (ranked.filter(F.col("_rn") <= limit).groupBy(*keys)
            .agg(F.sort_array(F.collect_list("log_file")).alias("logs")))
