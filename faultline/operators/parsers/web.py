"""Web server access and error logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline.functions.severity import WEB_LEVELS
from faultline.functions.text import behind_bracket, bracketed, clip, contains_any, lookup, nth, parse_size, words
from faultline.functions.times import access_parts, access_ts, error_parts, error_ts, plain_ts
from faultline.operators.parsers.base import LineParser, Values, at, either, event, raw, side_by_side

# Request paths that scanners look for, and the domain endings that count as a host name.
SUSPICIOUS = (
    "wp-login.php", "xmlrpc.php", "wp-admin", "/admin", "/phpmyadmin", "/.env",
    "/config", "/backup", "shell", "/cgi-bin", "eval(", "base64",
)
TLDS = ("com", "net", "org", "io", "co", "info", "biz", "us", "uk", "ca", "au", "de", "fr", "in", "ru", "jp", "br", "mx", "za",
        "xyz", "dev", "app", "site", "online", "store", "tech")

# A line without such a status can never become an event; this test is far cheaper than the full pattern.
ACCESS_GUARD = r'"\s+(?:[5-9]\d\d|40[13])\s'


def suspicious_path(path: Column) -> Column:
    return contains_any(F.lower(path), SUSPICIOUS)


def first_ip(client: Column) -> Column:
    return F.regexp_extract(client, r"([\d.]+)", 1)


def first_domain(text: Column) -> Column:
    """First name among the words of the text, cut at punctuation, whose last label is a known top-level domain; lower-cased."""
    names = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}.-]+"), F.lit(0)), lambda w: F.trim(w, F.lit(".-")))
    return F.try_element_at(F.filter(names, lambda w: F.contains(w, F.lit(".")) & F.substring_index(w, ".", -1).isin(*TLDS)), F.lit(1))


def _dated(line: Column) -> Column:
    return F.substring(line, 5, 1) == "-"


def _maybe_access(line: Column) -> Column:
    return line.rlike(ACCESS_GUARD)


def _access_parts(line: Column) -> Values:
    """A common or combined line, cut at its quotes: head, request, status and size, referer, blank, agent.

    A quote behind a backslash belongs to the quoted text.
    """
    return {"cut": F.when(F.contains(line, F.lit("\\")), F.split(line, r'(?<!\\)"')).otherwise(F.split(line, '"'))}


def _access_captures() -> Values:
    return _access_parts(raw())


def _access_words() -> Values:
    def piece(n: int) -> Column:
        return F.try_element_at(at("cut"), F.lit(n))

    return {"who": words(F.substring_index(piece(1), "[", 1)), "asked": words(piece(2)), "answer": words(F.trim(piece(3))), "between": F.substring_index(F.substring_index(piece(1), "[", -1), "]", 1),
            "fourth": F.coalesce(piece(4), F.lit("")), "sixth": F.coalesce(piece(6), F.lit(""))}


def _access_values() -> Values:
    def word(name: str, n: int) -> Column:
        return F.try_element_at(at(name), F.lit(n))

    # address, identity, user and an empty end; method, path and protocol; three digits and a size
    whole = ((F.size(at("who")) == 4) & (word("who", 4) == "") & word("who", 1).rlike("^[0-9a-fA-F.:]+$") & (F.size(at("asked")) >= 3)
             & word("answer", 1).rlike("^[0-9]{3}$") & word("answer", 2).rlike("^(?:[0-9]+|-)$"))
    parts = {"ip": word("who", 1), "user": word("who", 3), "time": at("between"), "method": word("asked", 1), "path": word("asked", 2),
             "status": word("answer", 1), "size": word("answer", 2), "referer": at("fourth"), "agent": at("sixth")}
    v = {n: F.when(whole, c) for n, c in parts.items()}
    return {**v, "code": v["status"].try_cast("int"), "bytes": parse_size(v["size"]),
            "lower_path": F.lower(v["path"]), "when": access_parts(v["time"])}


def _access_class() -> Values:
    return {"probing": contains_any(at("lower_path"), SUSPICIOUS), "request": F.concat(at("method"), F.lit(" "), at("path"))}


def _access_event() -> Values:
    code, probing, request = at("code"), at("probing"), at("request")
    return event(
        (code >= 500) | code.isin(401, 403),
        ts=access_ts(at("when")), category=F.when(probing, "security").otherwise("web"),
        severity=F.when(probing, "warning").when(code == 503, "critical").when(code >= 500, "warning").otherwise("info"),
        message=F.when(probing, F.concat(F.lit("Suspicious path asked by "), at("ip"), F.lit(": "), request))
                 .otherwise(F.concat(F.lit("Status "), at("status"), F.lit(" for "), request)),
        ip_address=at("ip"), status_code=code, method=at("method"), path=at("path"), size=at("bytes"),
        user_agent=at("agent"), event_type=F.lit("access"),
        metadata=F.to_json(F.struct(
            at("method").alias("method"), at("path").alias("path"), code.alias("status_code"), at("bytes").alias("size"),
            at("agent").alias("user_agent"), at("referer").alias("referer"), at("user").alias("user"))))


def _error_heads() -> Values:
    """``[time] [module:level] [pid n] [client ip] text`` by its brackets, ``date time [level] [module] text`` by its words."""
    dated = words(F.when(_dated(raw()), raw()), 3)
    return {"b_time": bracketed(raw()), "b_rest": behind_bracket(raw()), "date": nth(dated, 1), "clock": nth(dated, 2), "d_rest": nth(dated, 3)}


def _error_levels() -> Values:
    return {"tag": bracketed(at("b_rest")), "b_more": behind_bracket(at("b_rest")), "d_level": bracketed(at("d_rest")), "d_more": behind_bracket(at("d_rest"))}


def _error_places() -> Values:
    more = at("b_more")
    return {"b_place": F.when(more.startswith("[pid "), behind_bracket(more)).otherwise(more),
            "d_module": bracketed(at("d_more")), "d_text": F.coalesce(behind_bracket(at("d_more")), at("d_more"))}


def _error_values() -> Values:
    tag, place = at("tag"), at("b_place")
    client = F.when(place.startswith("[client "), bracketed(place))
    b_text = F.when(client.isNotNull(), behind_bracket(place)).otherwise(place)
    b_whole = tag.isNotNull() & ~tag.rlike(r"\s") & (tag != "")
    module = F.when(F.contains(tag, F.lit(":")), F.regexp_replace(tag, ":[^:]*$", ""))
    d_whole = at("date").rlike("^[0-9-]{10}$") & at("clock").rlike("^[0-9:]{8}[.][0-9]+$") & at("d_level").rlike("^[A-Za-z0-9_]+$")
    return {"level": F.lower(F.when(b_whole, F.substring_index(tag, ":", -1)).when(d_whole, at("d_level"))),
            "module": F.when(b_whole, F.coalesce(module, F.lit(""))).when(d_whole, F.coalesce(at("d_module"), F.lit(""))),
            "text": F.when(b_whole, b_text).when(d_whole, at("d_text")), "client": F.coalesce(first_ip(client), F.lit("")),
            "b_when": error_parts(at("b_time")), "any_time": F.coalesce(at("b_time"), F.concat_ws(" ", at("date"), at("clock")))}


def _error_event() -> Values:
    level = at("level")
    return event(
        level.isNotNull(),
        ts=F.coalesce(error_ts(at("b_when")), plain_ts(at("any_time"))), category=F.lit("web"),
        severity=lookup(WEB_LEVELS, level, "info"), message=clip(at("text"), 500), ip_address=at("client"),
        domain=first_domain(at("text")), event_type=F.lit("web_error"),
        metadata=F.to_json(F.struct(level.alias("level"), at("module").alias("module"))))


def _error_guard(line: Column) -> Column:
    return line.startswith("[") | _dated(line)


_ERROR_STAGES = (_error_heads, _error_levels, _error_places, _error_values)
_ACCESS_STAGES = (_access_words, _access_values, _access_class)

ACCESS_LOG = LineParser("web", (_access_captures, *_ACCESS_STAGES), _access_event, _maybe_access)
ERROR_LOG = LineParser("web", _ERROR_STAGES, _error_event, _error_guard)
# Either kind of line; the shapes exclude each other.
WEB = LineParser(
    "web",
    side_by_side((lambda: _access_parts(F.when(_maybe_access(raw()) & ~raw().startswith("#"), raw())), *_ACCESS_STAGES), _ERROR_STAGES),
    lambda: either(_access_event(), _error_event()),
    lambda line: _error_guard(line) | _maybe_access(line))
