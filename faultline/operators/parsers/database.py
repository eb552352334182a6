"""Database error log and slow-query log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.severity import DB_LEVELS
from faultline.functions.text import behind_bracket, bracketed, clip, has, hosted, lookup, nth, search, sides, words
from faultline.functions.times import iso_ts, short_parts, short_ts
from faultline.operators.parsers.base import LineParser, Values, at, event, raw
from faultline.operators.sequence import fill_forward

QUERY_HEAD, USER_HEAD = "# Query_time:", "# User@Host:"
# What a shipper or rotation adds to a log's name: numbers or times behind a dot, dash or underscore, and a file ending.
CHUNK = r"(?:[._-][0-9][0-9T:-]*)*(?:\.(?:gz|bz2|zst|txt))?$"

# Words that make an error critical.
CRASH = "crash|segfault|assertion|fatal|aborting|shutting down"
REFUSED = "Too many connections|max_connections|Connection refused|Can't connect"
DENIED = r"(?i)Access denied for user '([^']+)'@'([^']+)'"


def _error_heads() -> Values:
    """``time thread [level] [code] text`` or ``yymmdd time [level] text``: the words before the first bracket, and the rest."""
    return {"head": words(F.trim(F.substring_index(raw(), "[", 1))), "tail": F.substring(raw(), F.instr(raw(), "["), F.length(raw()))}


def _error_tags() -> Values:
    first, n = nth(at("head"), 1), F.size(at("head"))
    numbered = nth(at("head"), -1).rlike("^[0-9]+$")
    dated = first.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return {"tag": bracketed(at("tail")), "rest": behind_bracket(at("tail")), "short": (n == 2) & first.rlike("^[0-9]{6}$"),
            "long": dated & numbered & ((n == 2) | (n == 3)), "stamp": F.when(n == 2, first).otherwise(F.concat_ws(" ", first, nth(at("head"), 2)))}


def _error_values() -> Values:
    code = F.when(at("long"), bracketed(at("rest")))
    whole = (at("short") | at("long")) & at("tag").rlike("^[A-Za-z0-9_]+$")
    return {"level": F.lower(F.when(whole, at("tag"))), "text": F.when(code.isNotNull(), behind_bracket(at("rest"))).otherwise(at("rest")),
            "l_time": F.when(at("long"), at("stamp")), "code": F.coalesce(code, F.lit("")),
            "s_when": short_parts(F.when(at("short"), F.array_join(at("head"), " ")))}


def _error_words() -> Values:
    return {"user": search(at("text"), DENIED, 1), "client": search(at("text"), DENIED, 2),
            "grave": has(at("text"), f"{CRASH}|{REFUSED}")}


def _error_event() -> Values:
    user, level = at("user"), at("level")
    message = F.when(
        user.isNotNull(), F.concat(F.lit("Access denied to database user '"), user, F.lit("' at '"), at("client"), F.lit("'"))
    ).otherwise(at("text"))
    return event(
        level.isNotNull(),
        ts=F.coalesce(short_ts(at("s_when")), iso_ts(at("l_time"))), category=F.lit("database"),
        severity=F.when(user.isNotNull(), "warning").when(at("grave"), "critical").otherwise(lookup(DB_LEVELS, level, "info")),
        message=clip(message, 500), mysql_user=user, event_type=F.lit("db_error"),
        metadata=F.to_json(F.struct(level.alias("level"), at("code").alias("code"),
                                    user.alias("mysql_user"), at("client").alias("mysql_host"))))


def _named_numbers() -> Values:
    """The header's ``Name: value`` pairs, in any order and with others between them."""
    pairs = words(F.regexp_replace(raw(), r":\s+", "="))
    return {"pairs": F.filter(pairs, lambda p: F.contains(p, F.lit("=")))}


def _slow_values() -> Values:
    def number(name: str) -> Column:
        own = F.filter(at("pairs"), lambda p: F.startswith(p, F.lit(name + "=")))
        return F.substring_index(F.try_element_at(own, F.lit(1)), "=", -1)

    return {"took": number("Query_time").try_cast("double"), "locked": F.coalesce(number("Lock_time").try_cast("double"), F.lit(0.0)),
            "sent": F.coalesce(number("Rows_sent").try_cast("long"), F.lit(0).cast("long")),
            "examined": F.coalesce(number("Rows_examined").try_cast("long"), F.lit(0).cast("long")),
            "user": F.coalesce("q_user", F.lit("unknown"))}


def _slow_event() -> Values:
    took = at("took")
    return event(
        took.isNotNull(),
        category=F.lit("database"),
        severity=F.when(took > 30, "critical").when(took > 10, "warning").otherwise("info"),
        message=F.format_string("Slow query of '%s': %.1f s, %d rows read, %d returned", at("user"), took,
                                at("examined"), at("sent")),
        ip_address=F.coalesce("q_ip", F.lit("")), mysql_user=at("user"), query_time=took, lock_time=at("locked"),
        rows_sent=at("sent"), rows_examined=at("examined"), event_type=F.lit("slow_query"),
        metadata=F.to_json(F.struct(
            took.alias("query_time"), at("locked").alias("lock_time"), at("sent").alias("rows_sent"),
            at("examined").alias("rows_examined"), at("user").alias("mysql_user"),
            F.coalesce("q_client", F.lit("")).alias("host"), F.lit("slow_query").alias("type"))))


def slow_user(line: Column) -> Column:
    """(u, c, i) of a ``# User@Host: user[name] @ client [address]`` header, cut at its at-sign and brackets; else null."""
    line = F.when(line.startswith(USER_HEAD), line)  # other lines are not taken apart
    named, place = sides(F.substring(line, F.lit(len(USER_HEAD) + 1), F.length(line)), "@")
    user = F.nullif(F.substring_index(F.trim(named), "[", 1), F.lit(""))
    whole = user.isNotNull() & F.contains(place, F.lit("[")) & F.contains(place, F.lit("]"))
    address = F.substring_index(F.substring_index(place, "[", -1), "]", 1)
    return F.when(whole, F.struct(user.alias("u"), F.trim(F.substring_index(place, "[", 1)).alias("c"), address.alias("i")))


def log_stream(file_path: Column) -> Column:
    """The log that a chunk is part of."""
    marked = (F.translate(file_path, "0123456789", "") != file_path) | reduce(lambda a, b: a | b, [file_path.endswith(e) for e in (".gz", ".bz2", ".zst", ".txt")])
    return F.when(marked, F.regexp_replace(file_path, CHUNK, "")).otherwise(file_path)


def slow_heads(lines: DataFrame) -> DataFrame:
    """Only the slow log's header lines, with their log (_stream), the chunk of it, and the user they name (_seen).

    Chunks of a log come in the order of their names' endings: shorter ones first, then by text.
    """
    heads = hosted(lines).filter(raw().startswith(QUERY_HEAD) | raw().startswith(USER_HEAD)).withColumn("_stream", F.coalesce(log_stream(F.col("file_path")), F.lit("")))
    ending = F.substring(F.col("file_path"), F.length("_stream") + 1, F.length("file_path"))
    return heads.withColumns({"_chunk": F.struct(F.length(ending).alias("n"), ending.alias("name")), "_seen": slow_user(raw())})


def last_users(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The last user of each log, (host, _stream, _seen): what a later batch of its lines starts from."""
    last = F.max_by("_seen", F.struct("_chunk", "line_no")).alias("_seen")
    now = slow_heads(lines).filter(F.col("_seen").isNotNull()).groupBy("host", "_stream").agg(last)
    return now if before is None else now.unionByName(before.join(now, ["host", "_stream"], "left_anti"))


def with_slow_query_user(lines: DataFrame, block_lines: int = 1_000_000, before: DataFrame | None = None) -> DataFrame:
    """Keep only slow-log header lines and give each ``# Query_time`` line the last user seen before it in its log.

    A log may come as several chunks; the user carries over from one to the next, and from earlier batches through
    ``before`` (see last_users). Adds q_user, q_client, q_ip; User@Host lines themselves are gone from the result.
    """
    seen = slow_heads(lines)
    if before is not None:
        first = F.struct(F.lit(-1).alias("n"), F.lit("").alias("name"))
        seen = seen.unionByName(before.withColumns({"_chunk": first, "line_no": F.lit(-1).cast("long")}), allowMissingColumns=True)
    filled = fill_forward(seen, ["host", "_stream"], "line_no", "_seen", block_lines, within=("_chunk",))
    return (filled.filter(raw().startswith(QUERY_HEAD))
            .withColumn("q_user", F.col("_seen.u")).withColumn("q_client", F.col("_seen.c"))
            .withColumn("q_ip", F.col("_seen.i")).drop("_seen", "_stream", "_chunk"))


ERROR_LOG = LineParser("database", (_error_heads, _error_tags, _error_values, _error_words), _error_event,
                       lambda line: line.rlike(r"^\d"))
# Takes lines that went through with_slow_query_user.
SLOW_LOG = LineParser("database", (_named_numbers, _slow_values), _slow_event, lambda line: line.startswith(QUERY_HEAD))
