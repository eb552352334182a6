"""Windowed correlation of events by address, account, domain and category.

Events are first counted per key and slide-wide pane, so a hot key shrinks to a few rows per pane before any
shuffle by window; a window is then the sum of its panes. This is exact because windows are whole numbers of panes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.catalog import COUNT_LIMITS, PATTERNS, CountLimit, Pattern
from faultline.config import CorrelationConfig
from faultline.functions.text import hosted
from faultline.schemas import CATEGORIES, SEVERITIES

_TEXT = "string"


def _counters() -> list[Column]:
    cats = [f"count_if(category = '{c}') as c_{c}" for c in CATEGORIES]
    sevs = [f"count_if(severity = '{s}') as s_{s}" for s in SEVERITIES]
    return [F.expr(e) for e in ("count(1) as event_count", *cats, *sevs)]


_COUNTER_NAMES = ["event_count", *[f"c_{c}" for c in CATEGORIES], *[f"s_{s}" for s in SEVERITIES]]


#: kind of correlation: (event column, column of the result)
_KEY_OF = {"ip_correlation": ("ip_address", "ip"), "account_correlation": ("account", "account"),
           "category_spike": ("category", "category"), "domain_correlation": ("domain", "domain")}


def _by_kind(events: DataFrame, kinds: tuple[str, ...], *columns) -> DataFrame:
    """Each event once for every kind whose key it has: columns, type, entity."""
    keys = F.array(*[F.struct(F.lit(k).alias("type"), F.col(_KEY_OF[k][0]).alias("entity")) for k in kinds])
    return hosted(events).select("host", *columns, F.inline(keys)).filter(F.coalesce("entity", F.lit("")) != "")


def window_counts(events: DataFrame, kinds: tuple[str, ...], cfg: CorrelationConfig, chained: bool = True) -> DataFrame:
    """Counts per host, kind, entity and window: total, per category (c_*), per severity (s_*), in one pass over the events.

    A stream takes the same two steps, each with its state: an event touches the row of its pane only, and a closed pane the
    rows of its windows. That needs append mode; not ``chained``, every event touches all its windows, in any output mode.
    """
    present = _by_kind(events, kinds, "ts", "category", "severity")
    by = ["host", "type", "entity"]
    if events.isStreaming and not chained:
        counted = present.groupBy(*by, F.window("ts", f"{cfg.window_s} seconds", f"{cfg.slide_s} seconds").alias("w")).agg(*_counters())
    elif events.isStreaming:
        panes = present.groupBy(*by, F.window("ts", f"{cfg.slide_s} seconds").alias("w")).agg(*_counters())
        wide = F.window(F.window_time("w"), f"{cfg.window_s} seconds", f"{cfg.slide_s} seconds").alias("w")
        counted = panes if cfg.window_s == cfg.slide_s else panes.groupBy(*by, wide).agg(*[F.expr(f"sum({n}) as {n}") for n in _COUNTER_NAMES])
    else:
        panes = present.groupBy(*by, F.window("ts", f"{cfg.slide_s} seconds").alias("pane")).agg(*_counters())
        counted = panes if cfg.window_s == cfg.slide_s else (
            panes.withColumn("w", F.window("pane.start", f"{cfg.window_s} seconds", f"{cfg.slide_s} seconds"))
            .groupBy(*by, "w").agg(*[F.expr(f"sum({n}) as {n}") for n in _COUNTER_NAMES]))
        counted = counted.withColumnRenamed("pane", "w")
    return counted.select(*by, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), *_COUNTER_NAMES)


def _count_map(names: tuple[str, ...], prefix: str) -> Column:
    """name -> count, without the names that never occurred."""
    words = ", ".join(f"'{n}'" for n in names)
    counts = ", ".join(f"{prefix}_{n}" for n in names)
    return F.expr(f"map_filter(map_from_arrays(array({words}), array({counts})), (name, n) -> n > 0)")


def category_histogram(events: DataFrame, key: str) -> DataFrame:
    """Per host and key value: events per category and per severity, as maps; whatever categories occur are counted."""
    present = hosted(events).filter(F.col(key).isNotNull() & (F.col(key) != ""))
    counted = present.groupBy("host", key, "category", "severity").agg(F.count(F.lit(1)).alias("n"))

    def totals(name: str) -> DataFrame:
        per = counted.filter(F.col(name).isNotNull()).groupBy("host", key, name).agg(F.sum("n").alias("n"))
        return per.groupBy("host", key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n")))).alias("m"))

    none = F.create_map().cast("map<string,bigint>")
    maps = [totals(name).withColumnRenamed("m", out) for name, out in (("category", "categories"), ("severity", "severities"))]
    total = counted.groupBy("host", key).agg(F.sum("n").alias("event_count"))
    return (total.join(maps[0], ["host", key], "left").join(maps[1], ["host", key], "left")
            .select("host", key, "event_count", F.coalesce("categories", none).alias("categories"), F.coalesce("severities", none).alias("severities")))


def capped(n: Column, full: int) -> Column:
    """Confidence of a count: 1 from ``full`` on."""
    return F.least(F.lit(1.0), n / F.lit(float(full)))


def _result(counts: DataFrame, pattern: Column, confidence: Column) -> DataFrame:
    def only(out: str) -> Column:
        kinds = [k for k, (_, name) in _KEY_OF.items() if name == out]
        return F.when(F.col("type").isin(*kinds), F.col("entity")).alias(out)

    return counts.withColumn("pattern", pattern).withColumn("confidence", confidence).filter("pattern is not null").select(
        "type", "pattern", "win_start", "win_end", "host", only("ip"), only("account"), only("domain"), only("category"), "event_count", "confidence",
        _count_map(CATEGORIES, "c").alias("categories"), _count_map(SEVERITIES, "s").alias("severities"),
        F.col("s_critical").alias("critical_count"), F.col("s_warning").alias("warning_count"))


def _entity_pattern(cfg: CorrelationConfig) -> tuple[Column, Column]:
    """Pattern of one address or domain; the test named first here wins."""
    tests = (
        ("security_spike", F.col("c_security"), cfg.security_min, 10),
        ("connection_flood", F.col("c_web"), cfg.web_min, 50),
        ("brute_force", F.col("c_auth"), cfg.auth_min, 10),
    )
    pattern, confidence = F.lit(None).cast(_TEXT), F.lit(0.0)
    for name, n, least, full in reversed(tests):
        pattern = F.when(n >= least, name).otherwise(pattern)
        confidence = F.when(n >= least, capped(n, full)).otherwise(confidence)
    return pattern, confidence


def _account_pattern(cfg: CorrelationConfig) -> tuple[Column, Column]:
    active = F.expr(" + ".join(f"int(c_{c} >= {cfg.account_category_min})" for c in CATEGORIES))
    warnings = F.col("s_warning") + F.col("s_critical")
    multi = (active >= cfg.account_active_categories) & (warnings >= cfg.account_warnings_min)
    database = F.col("c_database") >= cfg.database_min
    return (F.when(database, "database_abuse").when(multi, "multi_source_abuse"),
            F.when(database, capped(F.col("c_database"), 10)).otherwise(capped(warnings, 10)))


def _spike_pattern(cfg: CorrelationConfig) -> tuple[Column, Column]:
    critical, warning = F.col("s_critical"), F.col("s_warning")
    dense = (critical >= cfg.spike_critical_min) | (warning >= cfg.spike_warning_min)
    return F.when(dense, F.concat("entity", F.lit("_spike"))), capped(critical * 2 + warning, 20)


def correlate(events: DataFrame, kinds: tuple[str, ...], cfg: CorrelationConfig = CorrelationConfig(), chained: bool = True) -> DataFrame:
    """Correlations of the given kinds. Each kind has its tests; a window below the kind's number of events is none."""
    entity = (cfg.ip_min_events, _entity_pattern(cfg))
    tests = {"ip_correlation": entity, "domain_correlation": entity, "account_correlation": (cfg.account_min_events, _account_pattern(cfg)),
             "category_spike": (cfg.spike_min_events, _spike_pattern(cfg))}
    pattern, confidence, least = F.lit(None).cast(_TEXT), F.lit(0.0), F.lit(0)
    for kind in kinds:
        here = F.col("type") == kind
        enough, (name, sure) = tests[kind]
        pattern, confidence, least = F.when(here, name).otherwise(pattern), F.when(here, sure).otherwise(confidence), F.when(here, enough).otherwise(least)
    return _result(window_counts(events, kinds, cfg, chained).filter(F.col("event_count") >= least), pattern, confidence)


def correlate_ip(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    return correlate(events, ("ip_correlation",), cfg)


def correlate_domain(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    """Same tests by domain; not part of correlate_all unless asked for."""
    return correlate(events, ("domain_correlation",), cfg)


def correlate_account(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    return correlate(events, ("account_correlation",), cfg)


def correlate_category(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig()) -> DataFrame:
    return correlate(events, ("category_spike",), cfg)


def correlate_all(events: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), domains: bool = False) -> DataFrame:
    return correlate(events, ALL_KINDS + ("domain_correlation",) * domains, cfg)


ALL_KINDS = ("ip_correlation", "account_correlation", "category_spike")


def with_evidence(correlations: DataFrame, events: DataFrame, cfg: CorrelationConfig = CorrelationConfig(),
                  kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Adds ``events`` (first 20 by time and id) and ``evidence`` (first 5 raw lines, cut) to each correlation of ``kinds``.

    One pass over the events: the first 20 of each kind, key and pane are taken on the map side already, so of a hot key
    few rows are ever shuffled; the first 20 of a window are among those of its panes.
    """
    entity = F.coalesce(*[F.when(F.col("type") == k, F.col(_KEY_OF[k][1])) for k in kinds])
    wanted = correlations.filter(F.col("type").isin(*kinds)).withColumn("entity", entity)
    pane_of, window_of = f"{cfg.slide_s} seconds", f"{cfg.window_s} seconds"
    slim = _by_kind(events, kinds, "ts", "id", "category", "log_file", F.substring("raw_line", 1, cfg.evidence_chars).alias("line"),
                    F.window("ts", pane_of)["start"].alias("pane"))

    def first(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("ts", "id")
        return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cfg.keep_events)

    by = ["host", "type", "entity"]
    spread = first(slim, *by, "pane").drop("_rn").withColumn("win_start", F.window("pane", window_of, pane_of)["start"])
    top = first(spread.join(wanted.select(*by, "win_start").distinct(), [*by, "win_start"], "left_semi"), *by, "win_start")
    listed = top.groupBy(*by, "win_start").agg(F.sort_array(F.collect_list(F.struct("_rn", "ts", "id", "category", "log_file", "line"))).alias("_l"))
    return wanted.join(listed, [*by, "win_start"], "left").select(
        *correlations.columns,
        F.transform("_l", lambda x: F.struct(x["ts"].alias("ts"), x["id"].alias("id"), x["category"].alias("category"),
                                             x["log_file"].alias("log_file"))).alias("events"),
        F.transform(F.slice("_l", 1, cfg.keep_evidence), lambda x: x["line"]).alias("evidence"))


def pattern_counts(events: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, window_s: int | None = None) -> DataFrame:
    """Catalogue patterns: at least min_events of the listed categories per host, key and tumbling window.

    All patterns that share a key and a window length are counted in one pass over the events.
    """
    out = None
    groups: dict[tuple[str, int], list[Pattern]] = {}
    for p in patterns:
        groups.setdefault((p.key, window_s or p.window_s), []).append(p)
    for (key, width), members in groups.items():
        entity = F.coalesce(F.col(key), F.lit(""))
        counts = (hosted(events).filter(F.col("category").isin(sorted({c for p in members for c in p.categories})))
                  .filter(entity != "")
                  .groupBy("host", entity.alias("entity"), F.window("ts", f"{width} seconds").alias("w"))
                  .agg(*[F.count_if(F.col("category").isin(p.categories)).alias(p.pattern) for p in members]))
        hits = F.array(*[F.struct(F.lit(p.pattern).alias("pattern"), F.lit(p.severity).alias("severity"),
                                  F.lit(p.min_events).alias("least"), F.col(p.pattern).alias("n")) for p in members])
        part = (counts.select("host", "entity", "w", F.inline(hits))
                .filter(F.col("n") >= F.col("least"))
                .select("pattern", "severity", F.lit(key).alias("key_name"), "host", "entity",
                        F.col("w.start").alias("win_start"), F.col("n").alias("event_count")))
        out = part if out is None else out.unionByName(part)
    return out


def limit_counts(events: DataFrame, limits: tuple[CountLimit, ...] = COUNT_LIMITS,
                 window_s: int | None = None, at_least: int | None = None) -> DataFrame:
    """Declared "so many per window" limits that were reached, per host and key, over tumbling windows."""
    out = None
    groups: dict[tuple[str, int], list[CountLimit]] = {}
    for c in limits:
        groups.setdefault((c.key, window_s or c.window_s), []).append(c)
    for (key, width), members in groups.items():
        entity = F.coalesce(F.col(key), F.lit(""))
        counted = hosted(events).filter(F.expr(" or ".join(f"({c.predicate})" for c in members)))
        if key != "host":
            counted = counted.filter(entity != "")
        counts = (counted.groupBy("host", entity.alias("entity"), F.window("ts", f"{width} seconds").alias("w"))
                  .agg(*[F.count_if(F.expr(c.predicate)).alias(c.limit_id) for c in members]))
        hits = F.array(*[F.struct(F.lit(c.limit_id).alias("limit_id"), F.lit(at_least or c.limit).alias("least"),
                                  F.col(c.limit_id).alias("n")) for c in members])
        part = (counts.select("host", "entity", "w", F.inline(hits)).filter(F.col("n") >= F.col("least"))
                .select("limit_id", "host", "entity", F.col("w.start").alias("win_start"), F.col("n").alias("event_count")))
        out = part if out is None else out.unionByName(part)
    return out
