"""String helpers used by parsers and rules. All of them build Column expressions; none needs Python workers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

IPV4 = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


def captured(text: Column, pattern: str, groups: int) -> Column:
    """All groups of an anchored pattern in one regex pass, as an array read by group_columns.

    A log line holds no line feed, so it separates the groups safely. A line that does not match has no groups;
    an optional group that took no part yields ''.
    """
    wanted = "".join(f"\n${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(text, f"(?s)^{pattern}.*$", wanted), "\n")


def group_columns(parts: Column, groups: int) -> list[Column]:
    """The groups, null where the pattern did not match (element 1 is the text before the first separator)."""
    return [F.try_element_at(parts, F.lit(i + 2)) for i in range(groups)]


def search(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group anywhere in the text, null when absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive regex search."""
    return text.rlike(f"(?iu)(?:{pattern})")


def contains_any(text: Column, words) -> Column:
    """True when the text holds any of the literal words (text must already be lower case)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def contains_any_of(text: Column, words: Column) -> Column:
    """Same, with the words in an array column."""
    return F.exists(words, lambda w: F.contains(text, w))


def clip(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def first_truthy(*values: Column, default: str | None = None) -> Column:
    """First value that is neither null nor ''."""
    picks = [F.nullif(v, F.lit("")) for v in values]
    if default is not None:
        picks.append(F.lit(default))
    return F.coalesce(*picks)


def lookup(mapping: dict[str, str], key: Column, default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` marks of a template column.

    Values are first shielded so that a value which itself looks like a mark is never filled again.
    """
    shield, out = "\x00", template
    for name in values:
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"{shield}{name}{shield}"))
    for name, value in values.items():
        safe = F.coalesce(F.replace(value.cast("string"), F.lit(shield), F.lit("")), F.lit("N/A"))
        out = F.replace(out, F.lit(f"{shield}{name}{shield}"), safe)
    return out


def decode_list(text: Column) -> Column:
    """JSON text to a string array; broken or missing JSON gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def decode_map(text: Column) -> Column:
    """JSON text to a string map; broken or missing JSON gives an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def version_number(text: Column) -> Column:
    """First d.d.d[.d], else first d.d, else the first line cut to 50 characters."""
    return F.coalesce(
        search(text, r"(\d+\.\d+\.\d+(?:\.\d+)?)"),
        search(text, r"[vV]?(\d+\.\d+)"),
        F.nullif(clip(F.trim(F.split_part(text, F.lit("\n"), F.lit(1))), 50), F.lit("")),
    )


def parse_size(text: Column) -> Column:
    """'-' (no body) counts as 0."""
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def shown_number(value: Column, digits: int = 1) -> Column:
    """A number as text with a fixed number of digits; halves are rounded away from zero."""
    return F.format_string(f"%.{digits}f", value)


def encode_json(**values: Column) -> Column:
    """JSON text of the named values; null ones are left out."""
    return F.to_json(F.struct(*[v.alias(n) for n, v in values.items()]))


def in_unit(value: Column, unit: int, digits: int = 1) -> Column:
    """``value`` in units of ``unit``, rounded for display."""
    return F.round(value / F.lit(unit), digits)


def hosted(df: DataFrame) -> DataFrame:
    """Rows without a host belong to the host '' like those that name none; so no join by host loses them."""
    return df.withColumn("host", F.coalesce("host", F.lit("")))


WHITE = " \t\n\x0b\f\r"


def _wide(text: Column) -> Column:
    """Whether white space in the text is anything but single spaces."""
    return contains_any(text, ("  ", *WHITE[1:]))


def words(text: Column, most: int = -1) -> Column:
    """The words between white space; with ``most``, the last one is all the rest.

    Nearly all lines have single spaces only, and one character is cut at without a pattern (which would be compiled for each row).
    """
    return F.when(_wide(text), F.split(text, r"\s+", most)).otherwise(F.split(text, " ", most))


def sides(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first ``mark`` that white space follows, and behind it, both without white space beside the mark.

    Null and null for a text without one.
    """
    at = F.when(_wide(text), F.regexp_instr(text, F.lit(rf"{re.escape(mark)}\s"))).otherwise(F.instr(text, f"{mark} "))
    found = F.when(at > 0, at)
    return (F.rtrim(F.substring(text, F.lit(1), found - 1), F.lit(WHITE)), F.ltrim(F.substring(text, found + len(mark), F.length(text)), F.lit(WHITE)))


def nth(parts: Column, n: int) -> Column:
    return F.try_element_at(parts, F.lit(n))


def _opens_bracket(text: Column) -> Column:
    return text.startswith("[") & F.contains(text, F.lit("]"))


def bracketed(text: Column) -> Column:
    """What stands in the bracket that a text begins with; null if it begins otherwise."""
    return F.when(_opens_bracket(text), F.substring_index(F.substring(text, F.lit(2), F.length(text)), "]", 1))


def behind_bracket(text: Column) -> Column:
    """What follows the bracket that a text begins with, without white space before it; null if it begins otherwise."""
    return F.when(_opens_bracket(text), F.ltrim(F.substring(text, F.instr(text, "]") + 1, F.length(text)), F.lit(WHITE)))
