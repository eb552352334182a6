"""What all parsers share: how a line is taken apart in stages and how it becomes an event row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from faultline.schemas import EVENTS, PARSED

Values = dict[str, Column]


@dataclass(frozen=True)
class LineParser:
    """A log format.

    ``stages`` name the values of a line that are worth computing once (captures first, then what needs them); a later
    stage reads an earlier one with ``at`` or ``groups``. ``build`` gives the event fields plus ``keep``, the condition
    that the line is an event at all. ``guard`` is an optional cheap condition that every such line meets.
    """

    source: str
    stages: tuple[Callable[[], Values], ...]
    build: Callable[[], Values]
    guard: Callable[[Column], Column] | None = None



def raw() -> Column:
    return F.col("raw_line")


def now() -> Column:
    return F.col("arrival_ts")


def at(name: str) -> Column:
    return F.col(f"_{name}")


def side_by_side(*stages: tuple[Callable[[], Values], ...]) -> tuple[Callable[[], Values], ...]:
    """Stages of several formats as one list: each stage names the values of the same stage of all."""
    def at_step(i: int) -> Callable[[], Values]:
        return lambda: {n: c for own in stages if i < len(own) for n, c in own[i]().items()}

    return tuple(at_step(i) for i in range(max(map(len, stages))))


def event(keep: Column, **fields: Column) -> Values:
    unknown = set(fields) - set(PARSED.fieldNames())
    if unknown:
        raise ValueError(f"not event fields: {sorted(unknown)}")
    return {"keep": F.coalesce(keep, F.lit(False)), **fields}


def either(first: Values, second: Values) -> Values:
    """Fields of the first event where it is one, else of the second."""
    none = F.lit(None)
    names = [f.name for f in PARSED.fields if f.name in first or f.name in second]
    return {"keep": first["keep"] | second["keep"],
            **{n: F.when(first["keep"], first.get(n, none)).otherwise(second.get(n, none)) for n in names}}


def staged(lines: DataFrame, parser: LineParser, guarded: bool = True) -> DataFrame:
    """Lines with all stage values.

    Each stage passes through a generator, which the optimizer does not look through; so neither a later filter nor a
    later use runs a regex again. A line that fails the guard is gone before any capture.
    """
    out = lines
    for i, stage in enumerate(parser.stages):
        values = F.array(F.struct(*[c.alias(f"_{n}") for n, c in stage().items()]))
        if i == 0 and guarded and parser.guard is not None:
            values = F.when(parser.guard(raw()), values)
        out = out.select("*", F.inline(values))
    return out


def parse(lines: DataFrame, parser: LineParser) -> DataFrame:
    """Events of the lines of one format.

    The id is a hash of where the line stands, so a replay gives the same ids. Without a time in the line the event
    takes the arrival time.
    """
    fields = parser.build()
    keep = fields.pop("keep")
    fields = {f"e_{n}": c for n, c in fields.items()}
    place = {
        "id": "sha2(concat_ws('|', host, file_path, cast(line_no as string)), 256)",
        "ts": "coalesce(e_ts, arrival_ts)" if "e_ts" in fields else "arrival_ts",
        "ts_parsed": "e_ts is not null" if "e_ts" in fields else "false",
        "host": "host", "raw_line": "raw_line", "log_file": "file_path",
        "source": "source" if "source" in lines.columns else f"'{parser.source}'",
    }
    missing = {"category": "'system'", "severity": "'info'", "metadata": "'{}'"}

    def text(name: str) -> str:
        return place.get(name) or (f"e_{name}" if f"e_{name}" in fields else missing.get(name, "null"))

    kept = staged(lines, parser).filter(keep).withColumns(fields)
    return kept.selectExpr(*[f"cast({text(f.name)} as {f.dataType.simpleString()}) as {f.name}" for f in EVENTS.fields])
