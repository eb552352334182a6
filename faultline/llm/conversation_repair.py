"""Conversations brought back to the form: perhaps a system turn, then pairs of a user and an assistant turn.

A conversation's turns are aligned with the alternating grammar string, in Wagner-Fischer tables over (turns left, symbols
left). Strings that end alike share their ends, so one table holds the alignments with each feasible length; cells that
cannot lie on a way as cheap as the incumbent (a greedy repair) are outside the Ukkonen band and never computed. The tables
run from the last turn backwards, so the audit of each length is read off forwards, least letter first, and the audits of the
cheapest lengths are compared.

A long conversation is aligned in blocks of turns: of each block the cheapest audit from each state of the grammar to each
other one. Blocks are joined by their costs and by the order of their audits alone. (Insertions stand before a turn, only
the last ones after all turns; so of two audits over the same turns none is the beginning of the other, and their first
difference decides whatever follows.) Short conversations do this in memory; those over LONG rows are dealt over tasks by
ranges of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import stored

RELABEL, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
#: Turns aligned at once; rows of a conversation that one task may hold; long conversations that may be broadcast by id.
BLOCK, LONG, NAMED = 128, 1024, 100_000
CLEAN, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3
#: States: nothing yet, a system turn only, a user turn waits for its answer, all pairs are whole. What comes next from each.
START, SYSTEM, OPEN, PAIRED = range(4)
NEXT, WANTED = (OPEN, OPEN, PAIRED, OPEN), "uuau"
#: Insertions that end the conversation from each state.
CLOSING = (0, 2, 1, 0)
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 60

TURNS = "array<struct<role: string, text: string>>"


def _greedy(turns: list[tuple[str, int]], entry: int) -> list[int]:
    """By exit state the cost of a simple repair: up to two insertions first, then every turn kept, relabelled or deleted."""
    costs = [FAR] * 4
    for first in range(3):
        state, cost = entry, INSERT * first
        for _ in range(first):
            state = NEXT[state]
        for initial, fault in turns:
            if fault:
                cost += DELETE
            elif state == START and initial == "s":
                state = SYSTEM
            else:
                cost += RELABEL * (initial != WANTED[state])
                state = NEXT[state]
        costs[state] = min(costs[state], cost)
    return costs


def _table(turns: list[tuple[str, int]], exit: int, incumbent: int) -> list[tuple[int, list[int]]]:
    """Row i: (lo, costs): cheapest ways to turn the turns from i on into the last lo, lo + 1 ... symbols before ``exit``."""
    n = len(turns)
    slack = incumbent - DELETE * sum(fault > 0 for _, fault in turns)
    last = "ua"[exit == PAIRED], "au"[exit == PAIRED]  # the symbol that is last but 0, 1, 0 ...
    rows: list[tuple[int, list[int]]] = [(0, [0])] * (n + 1)
    lo, below, clean = 0, [0], 0
    for i in range(n - 1, -1, -1):
        initial, fault = turns[i]
        clean += not fault
        low, high = max(0, clean - slack // DELETE), clean + slack // (KEEP_TRUNCATED - DELETE)
        here, kept = [], KEEP_TRUNCATED * (fault == TRUNCATED)
        for left in range(low, high + 1):
            at = left - lo
            best = below[at] + DELETE if 0 <= at < len(below) else FAR
            if left:
                if fault <= TRUNCATED and 0 < at <= len(below):
                    best = min(best, below[at - 1] + kept + RELABEL * (initial != last[(left - 1) & 1]))
                if here:
                    best = min(best, here[-1] + INSERT)
            here.append(best)
        lo, below = low, here
        rows[i] = (lo, below)
    return rows


def _audit(turns: list[tuple[str, int]], rows: list[tuple[int, list[int]]], exit: int, i: int, left: int) -> str:
    """The least audit among the cheapest ones from cell (i, left) of a table."""
    def cost(i, left):
        lo, costs = rows[i]
        return costs[left - lo] if 0 <= left - lo < len(costs) else FAR

    out, n = [], len(turns)
    last = "ua"[exit == PAIRED], "au"[exit == PAIRED]
    while i < n:
        now, (initial, fault) = cost(i, left), turns[i]
        if now == cost(i + 1, left) + DELETE:
            out.append("D")
            i += 1
        elif left and now == cost(i, left - 1) + INSERT:
            out.append("I")
            left -= 1
        else:
            out.append("K" if initial == last[(left - 1) & 1] else "R")
            i, left = i + 1, left - 1
    return "".join(out)


def alignments(turns: list[tuple[str, int]], entries: tuple[int, ...] = (START,), exits: tuple[int, ...] = (START, SYSTEM, OPEN, PAIRED)) -> dict[tuple[int, int], tuple[int, str]]:
    """By (entry, exit) state the least cost and its least audit, for turns (role initial, fault); no insertions after the last turn."""
    n, out = len(turns), {}
    systems = [k for k, (initial, fault) in enumerate(turns) if initial == "s" and fault <= TRUNCATED]
    if START in entries and START in exits:
        out[START, START] = (DELETE * n, "D" * n)
    if SYSTEM in exits:
        if SYSTEM in entries:
            out[SYSTEM, SYSTEM] = (DELETE * n, "D" * n)
        if START in entries and systems:
            cost, k = min((DELETE * (n - 1) + KEEP_TRUNCATED * (turns[k][1] == TRUNCATED), -k) for k in systems)
            out[START, SYSTEM] = (cost, "D" * -k + "K" + "D" * (n - 1 + k))
    incumbents = {e: _greedy(turns, e) for e in entries}
    for x in (OPEN, PAIRED):
        if x not in exits:
            continue
        rows = _table(turns, x, max(c[x] for c in incumbents.values()))
        for e in entries:
            starts = [(0, "", 0)]
            if e == START:
                starts += [(DELETE * k + KEEP_TRUNCATED * (turns[k][1] == TRUNCATED), "D" * k + "K", k + 1) for k in systems]
            least, cells = FAR, []
            for spent, said, i in starts:
                lo, costs = rows[i]
                feasible = (x == OPEN) != (e == OPEN)  # whether an odd number of symbols leads from e to x
                for left in range(lo + ((lo & 1) != feasible), lo + len(costs), 2):
                    total = spent + costs[left - lo]
                    if total > least or (left == 0 and e != x):
                        continue
                    if total < least:
                        least, cells = total, []
                    cells.append((said, i, left))
            out[e, x] = (least, min(said + _audit(turns, rows, x, i, left) for said, i, left in cells))
    return out


def _ranked(found: dict[tuple[int, int], tuple[int, str]]) -> tuple[list[int], list[int]]:
    """Costs and, within each entry state, ranks of the audits, both at 4 * entry + exit; FAR where there is no way."""
    costs, ranks = [FAR] * 16, [0] * 16
    for e in range(4):
        exits = sorted((x for x in range(4) if (e, x) in found), key=lambda x: found[e, x][1])
        for rank, x in enumerate(exits):
            costs[4 * e + x], ranks[4 * e + x] = found[e, x][0], rank
    return costs, ranks


class Chain:
    """Blocks joined one after the other; of each block only the entry state behind each exit state is remembered."""

    def __init__(self):
        self.cost, self.rank, self.behind = [0, FAR, FAR, FAR], [0, 0, 0, 0], bytearray()

    def add(self, costs: list[int], ranks: list[int]) -> None:
        best = [min((self.cost[e] + costs[4 * e + x], self.rank[e], e) for e in range(4)) for x in range(4)]
        order = sorted(range(4), key=lambda x: (best[x][1], ranks[4 * best[x][2] + x]))
        self.behind += bytes(b[2] for b in best)
        self.cost = [min(b[0], FAR) for b in best]
        self.rank = [order.index(x) for x in range(4)]

    def end(self) -> tuple[int, int]:
        """The cheapest cost with the closing insertions, and the last exit state."""
        cost, _, x = min((self.cost[x] + INSERT * CLOSING[x], self.rank[x], x) for x in range(4))
        return cost, x

    def states(self) -> bytearray:
        """The exit state of each block."""
        x, out = self.end()[1], bytearray(len(self.behind) // 4)
        for k in range(len(out) - 1, -1, -1):
            out[k], x = x, self.behind[4 * k + x]
        return out


def _repaired(turns: list[tuple[str, str]], entry: int, audit: str) -> list[dict[str, str]]:
    """The turns (role, text) that an audit leaves, from the grammar's state before it."""
    out, state, rest = [], entry, iter(turns)
    for edit in audit:
        if edit == "D":
            next(rest)
            continue
        wanted = "assistant" if state == OPEN else "user"
        role, text = (wanted, "") if edit == "I" else next(rest)
        if edit == "K" and state == START and role[:1] == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
        out.append({"role": role if edit == "K" else wanted, "text": text})
    return out


def _illegal(roles: list[str], before: str | None) -> int:
    initials = ([] if before is None else [before]) + [r[:1] for r in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a turn; ``seen``: an earlier turn has the same role and text."""
    said = text.rstrip(WHITE)
    return BLANK if not said else DUPLICATE if seen else TRUNCATED if said[-1] not in ".!?" else CLEAN


PIECE = f"piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns {TURNS}"
PIECE_NAMES = ["piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]


def _piece(number: int, gaps: int, roles: list[str], texts: list[str], faults: list[int], before: str | None, cost: int, entry: int, audit: str) -> tuple:
    return (number, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), _illegal(roles, before), cost, audit,
            _repaired(list(zip(roles, texts)), entry, audit))


def pieces_of(rows: list[tuple], block: int = BLOCK) -> list[tuple]:
    """A whole conversation's pieces, in order, from its rows (turn, role, text); none: one empty piece."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    numbers = {r[0] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    if not rows:
        return [(0, 0, 0, 0, 0, 0, 0, "", [])]
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    found, chain = [], Chain()
    for start in range(0, len(rows), block):
        turns = [(r[1][:1], f) for r, f in zip(rows[start:start + block], faults[start:start + block])]
        found.append(alignments(turns, tuple(range(4)) if start else (START,)))
        chain.add(*_ranked(found[-1]))
    states, out, entry, before = chain.states(), [], START, None
    for k, (x, ways) in enumerate(zip(states, found)):
        part, (cost, audit) = rows[k * block:(k + 1) * block], ways[entry, x]
        closing = CLOSING[x] if k == len(found) - 1 else 0
        roles = [r[1] for r in part]
        out.append(_piece(k, 0 if k else gaps, roles, [r[2] for r in part], faults[k * block:(k + 1) * block], before,
                          cost + INSERT * closing, entry, audit + "I" * closing))
        entry, before = x, roles[-1][:1]
    return out


def _batches(ids: list, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip([ids, *(list(c) for c in zip(*rows))] if rows else [[]] * len(schema), schema)], schema=schema)


def _piece_schema(id_type: pa.DataType) -> pa.Schema:
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.schema([("conv_id", id_type), *((n, pa.int64()) for n in PIECE_NAMES[:-2]), ("audit", pa.string()), ("turns", turns)])


def _short(block: int):
    """Rows (conv_id, turn, role, text, dropped), sorted by conv_id, to pieces; a conversation may span batches."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, schema, ids, out = [], None, None, [], []
        for batch in batches:
            schema = schema or _piece_schema(batch.schema.field("conv_id").type)
            for conv, turn, role, text, dropped in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        made = pieces_of(held, block)
                        ids += [now[0]] * len(made)
                        out += made
                    held, now = [], (conv,)
                if not dropped:
                    held.append((turn, role, text))
                if len(out) >= 256:
                    yield _batches(ids, out, schema)
                    ids, out = [], []
        if now is not None:
            made = pieces_of(held, block)
            yield _batches(ids + [now[0]] * len(made), out + made, schema)

    return work


def _blocks(block: int):
    """Rows (conv_id, role, text, first) of long conversations, sorted, to numbered blocks with their costs and ranks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number, held, now, kind = TaskContext.get().partitionId(), 0, [], None, None

        def done():
            nonlocal number
            turns = [(role[:1], fault) for role, _, fault in held]
            costs, ranks = _ranked(alignments(turns, tuple(range(4))))
            rows = [{"role": r, "text": t, "fault": f} for r, t, f in held]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                (now[0], kind), (segment, pa.int64()), (number, pa.int64()), (costs, pa.list_(pa.int64())), (ranks, pa.list_(pa.int64())),
                (rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int64())]))),
                (held[0][0][:1], pa.string()), (held[-1][0][:1], pa.string()))],
                names=["conv_id", "segment", "block", "costs", "ranks", "rows", "first_initial", "last_initial"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "first"))):
                if held and (now[0] != conv or len(held) == block):
                    yield done()
                    held = []
                now = (conv,)
                held.append((role, text, fault_of(text, not first)))
        if held:
            yield done()

    return work


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, without their rows, to (conv_id, segment, block, piece, entry, exit, closing, before); some 20 bytes a block are held."""
    chain, now, at, lasts, kind = Chain(), None, [], [], None

    def done():
        states, n = chain.states(), len(at)
        places = np.array(at, np.int64).reshape(-1, 2)
        for s in range(0, n, 4096):
            e = min(n, s + 4096)
            exits = list(states[s:e])
            entries = [states[s - 1] if s else START, *exits[:-1]]
            closing = [CLOSING[states[-1]] if k == n - 1 else 0 for k in range(s, e)]
            before = [lasts[s - 1] if s else None, *lasts[s:e - 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * (e - s), kind), pa.array(places[s:e, 0]), pa.array(places[s:e, 1]), pa.array(range(s, e), pa.int64()),
                 pa.array(entries, pa.int64()), pa.array(exits, pa.int64()), pa.array(closing, pa.int64()), pa.array(before, pa.string())],
                names=["conv_id", "segment", "block", "piece", "entry", "exit", "closing", "before"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, segment, block, costs, ranks, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "block", "costs", "ranks", "last_initial"))):
            if now is not None and now[0] != conv:
                yield from done()
                chain, at, lasts = Chain(), [], []
            now = (conv,)
            chain.add(costs, ranks)
            at.append((segment, block))
            lasts.append(last)
    if now is not None:
        yield from done()


def _pieces_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = _piece_schema(batch.schema.field("conv_id").type)
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            roles, texts, faults = ([t[c] for t in r["rows"]] for c in ("role", "text", "fault"))
            e, x = r["entry"], r["exit"]
            cost, audit = alignments([(role[:1], f) for role, f in zip(roles, faults)], (e,), (x,))[e, x]
            yield _batches([r["conv_id"]], [_piece(r["piece"], 0, roles, texts, faults, r["before"], cost + INSERT * r["closing"], e, audit + "I" * r["closing"])], schema)


def _long_pieces(rows: DataFrame, id_type: str, block: int) -> DataFrame:
    """Pieces of conversations of any length; ``rows``: conv_id, turn, role, text, dropped."""
    rows = stored(rows.withColumn("nth", F.monotonically_increasing_id()), "long-rows")
    there = rows.where("not dropped")
    # the first of equal turns, found by an aggregation; joined by the row's number, so no hot key
    first = (there.groupBy("conv_id", F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256).alias("digest"))
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "nth")).alias("least")).select(F.col("least.nth").alias("nth"), F.lit(True).alias("first")))
    marked = there.join(first, "nth", "left").select("conv_id", "turn", "role", "text", "nth", F.coalesce("first", F.lit(False)).alias("first"))
    order = ["conv_id", "turn", "role", "text", "nth"]
    turns = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(turns.mapInArrow(_blocks(block), f"conv_id {id_type}, segment long, block long, costs array<long>, ranks array<long>, "
                                     "rows array<struct<role: string, text: string, fault: long>>, first_initial string, last_initial string"), "blocks")
    ways = (blocks.select("conv_id", "segment", "block", "costs", "ranks", "last_initial").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "block")
            .mapInArrow(_chained, f"conv_id {id_type}, segment long, block long, piece long, entry long, exit long, closing long, before string"))
    chosen = blocks.select("conv_id", "segment", "block", "rows").join(ways.drop("conv_id"), ["segment", "block"])
    known = there.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("known_gaps"))
    every = rows.groupBy("conv_id").agg(F.count("*").alias("n")).alias("e")
    gaps = every.join(known.alias("k"), F.col("e.conv_id").eqNullSafe(F.col("k.conv_id")), "left").select(
        "e.conv_id", F.lit(-1).cast("long").alias("piece"), F.coalesce("known_gaps", F.lit(0)).cast("long").alias("gaps"),
        *(F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.lit("").alias("audit"), F.lit(None).cast(TURNS).alias("turns"))
    return chosen.mapInArrow(_pieces_of_blocks, f"conv_id {id_type}, {PIECE}").unionByName(gaps)


def _parts(turns: DataFrame, dropped: Column | None, block: int, long: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of short conversations, in order within their partitions, and of long ones, in no order."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                        (F.lit(False) if dropped is None else dropped).alias("dropped"))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    over = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select(F.col("conv_id").alias("over_id")), "over")
    count = over.count()
    far = None
    if count:
        over = F.broadcast(over) if count <= NAMED else over
        is_over = F.col("conv_id").eqNullSafe(F.col("over_id"))
        far = _long_pieces(rows.join(over, is_over, "left_semi"), id_type, block)
        rows = rows.join(over, is_over, "left_anti")
    near = rows.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_short(block), f"conv_id {id_type}, {PIECE}")
    return near, far


def repair(turns: DataFrame, dropped: Column | None = None, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """The repaired conversations in pieces of at most ``block`` turns before repair: conv_id, piece (their order), gaps, blank, duplicate,
    truncated, illegal, cost (of this piece; sums are those of the conversation), audit (its edits), turns (what they leave).

    ``turns``: conv_id, turn, role, text; more columns are ignored. Turns stand in order of turn (null first), then role and
    text. A null role or text counts as one space, null ids are one conversation. Rows for which ``dropped`` holds are not
    there, but their conversation is named, with empty pieces if nothing is left. No rows give no rows. Costs: keep 0,
    relabel 1, delete 2 (blank and repeated turns must go), insert an empty turn 5, leave a truncated one 5 more.
    """
    near, far = _parts(turns, dropped, block, long)
    return near if far is None else near.unionByName(far)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row for each conversation; of the text only the state of its hash is held."""
    now, sums, audit, text, some, kind = None, [0] * 6, [], hashlib.sha256(), False, None
    names, ids, out = PIECE_NAMES[1:-2], [], []

    def batch_of():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(list(c), pa.int64()) for c in cols[:6]), *(pa.array(list(c), pa.string()) for c in cols[6:])],
                                          names=["conv_id", *names, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for r in batch.to_pylist():
            if now is not None and now[0] != r["conv_id"]:
                ids.append(now[0])
                out.append((*sums, "".join(audit), text.hexdigest()))
                sums, audit, text, some = [0] * 6, [], hashlib.sha256(), False
            now = (r["conv_id"],)
            sums = [a + r[c] for a, c in zip(sums, names)]
            audit.append(r["audit"])
            for t in r["turns"] or ():
                text.update((("\n" if some else "") + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                some = True
        if len(out) >= 1024:
            yield batch_of()
            ids, out = [], []
    if now is not None:
        ids.append(now[0])
        out.append((*sums, "".join(audit), text.hexdigest()))
        yield batch_of()


def repair_summary(turns: DataFrame, dropped: Column | None = None, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """One row for each conversation of ``repair``: its sums, its whole audit and the SHA-256 of ``role:text`` of what is left, one a line.

    A hash takes its text in order, so the pieces of a long conversation pass through one task, one piece at a time.
    """
    near, far = _parts(turns, dropped, block, long)
    id_type = turns.schema["conv_id"].dataType.simpleString()
    done = near.mapInArrow(_summed, f"conv_id {id_type}, {SUMMARY}")
    if far is None:
        return done
    in_order = far.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return done.unionByName(in_order.mapInArrow(_summed, f"conv_id {id_type}, {SUMMARY}"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows with faults that follow from crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, question and exclamation marks, 3 repeats it, 4 makes its role
    user. Nulls count as one space, in the hash as well; the turn itself stays null.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") == 0).alias("dropped"), copies).drop("copy")
