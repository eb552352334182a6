"""Conversation repair against a plain search over grammar states, and against every edit of small conversations."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.llm import conversation_repair as cr
from faultline.llm.queries import op11_conversation_repair

WHITE = " \t\n\x0b\x0c\r"


def plain_summary(rows):
    """From (turn, role, text) rows, by one pass over (cost, audit) of each grammar state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    numbers = {r[0] for r in rows if r[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"0u": "o", "0s": "1", "1u": "o", "oa": "p", "pu": "o"}

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, audit, kept) in list(best.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if state + c in after:
                        new = (cost + 5, audit + "I", [*kept, (role, "")])
                        best[after[state + c]] = min(best.get(after[state + c], new), new, key=lambda b: b[:2])
        return best

    best = {"0": (0, "", [])}
    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for state, (cost, audit, kept) in with_inserts(best).items():
            ways = [(state, cost + 2, "D", kept)]
            if kind in ("", "truncated"):
                more = 5 * (kind == "truncated")
                ways += [(after.get(state + role[:1]), cost + more, "K", [*kept, (role, text)])]
                ways += [(after.get(state + c), cost + more + 1, "R", [*kept, (r, text)]) for c, r in (("u", "user"), ("a", "assistant"))]
            for to, total, edit, left in ways:
                if to is not None:
                    found = (total, audit + edit, left)
                    new[to] = min(new.get(to, found), found, key=lambda b: b[:2])
        best = new
    best = with_inserts(best)
    cost, audit, kept = min((best[s] for s in "0p" if s in best), key=lambda b: b[:2])
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def plain_damage(rows):
    """conversations after damage, from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def random_rows(rng, n):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Fine. ", "more?"] + [f"text {k}." for k in range(4)]
    weights = rng.choice([(6, 6, 1), (1, 1, 6), (9, 1, 0), (3, 3, 3)])
    return [(rng.choice([None, *range(n + 2)]), rng.choices(["user", "assistant", "system"], weights)[0] if rng.random() < .97 else rng.choice(["", " ", "tool", "sure"]), rng.choice(texts)) for _ in range(n)]


def summary(pieces):
    rows = list(cr._summed(iter([cr._batches([1] * len(pieces), pieces, cr._piece_schema(__import__("pyarrow").int64()))])))
    return tuple(rows[0].to_pylist()[0].values())[1:]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 128])
def test_alignment_as_plain_search(block):
    rng = random.Random(block)
    for k in range(200):
        rows = random_rows(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 30]) if k % 40 else 150)
        assert summary(cr.pieces_of(rows, block)) == plain_summary(rows), rows


@pytest.mark.parametrize("length, gap", [(2, ["", "u", "a", "ua", "au"]), (3, ["", "u", "a"])])
def test_every_edit_of_small_conversations(length, gap):
    """No edit sequence with such insertions is cheaper, or as cheap and less."""
    def accepted(initials):
        s = "".join(initials)
        s = s[1:] if s[:1] == "s" else s
        return not initials or (len(s) >= 2 and len(s) % 2 == 0 and s == "ua" * (len(s) // 2))

    options = [("u", 0), ("a", 0), ("s", 0), ("u", 1), ("a", 3), ("x", 0)]
    for turns in itertools.product(options, repeat=length):
        best = (10 ** 9, "")
        for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=length):
            for inserts in itertools.product(gap, repeat=length + 1):
                cost, audit, left = 5 * sum(map(len, inserts)), "", []
                for (initial, fault), edit, extra in zip(turns, edits, inserts):
                    audit += "I" * len(extra) + edit[0]
                    left += extra
                    cost += 2 if edit == "D" else 5 * (fault == 1) + (edit != "K") + 1000 * (fault > 1)
                    left += [] if edit == "D" else [initial if edit == "K" else edit[1]]
                left += inserts[length]
                if cost <= best[0] and accepted(left):
                    best = min(best, (cost, audit + "I" * len(inserts[length])))
        chain = cr.Chain()
        ways = cr.alignments(list(turns))
        chain.add(*cr._ranked(ways))
        cost, x = chain.end()
        assert (cost, ways[0, x][1] + "I" * cr.CLOSING[x]) == best, turns


SCHEMA = "conv_id long, turn long, role string, text string, cost string, piece string, nth string, kind string"


def as_tuples(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


@pytest.mark.parametrize("long", [20, 1024])
def test_damage_and_repair_as_plain(spark, long):
    """Short and long conversations, nulls everywhere, repeated rows, and one conversation with a third of all rows."""
    rng = random.Random(5)
    rows = [(None if conv == 7 else conv, *r) for conv in range(60) for r in random_rows(rng, rng.randrange(12))]
    rows += [(99, *r) for r in random_rows(rng, 300)] + [(98, 5, "user", "the same.")] * 40
    rows = [(c, t, r if rng.random() < .97 else None, x if rng.random() < .95 else None) for c, t, r, x in rows] + [(1000 + k, 0, "user", "only one.") for k in range(40)]
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(5)
    harmed = cr.damaged(df)
    got = as_tuples(cr.repair_summary(harmed, F.col("dropped"), block=8, long=long))
    want = sorted(((conv, *plain_summary(left)) for conv, left in plain_damage(rows).items()), key=repr)
    assert got == want
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in got)
    left = [r for r in cr.repair(harmed, F.col("dropped"), block=8, long=long).collect() if r["conv_id"] == 99]
    audit = "".join(r["audit"] for r in sorted(left, key=lambda r: r["piece"]))
    assert audit == next(r[7] for r in want if r[0] == 99) and max(len(r["turns"] or ()) for r in left) <= 40


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_summary(cr.damaged(none), F.col("dropped")).count() == 0 and cr.repair(none).count() == 0


def test_query_on_the_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = as_tuples(op11_conversation_repair(spark, sf))
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    assert got == sorted(((conv, *plain_summary(left)) for conv, left in plain_damage(rows).items()), key=repr)


def test_long_conversations_take_bounded_time():
    """Turns that fit nowhere, with faults of each kind: bands stay narrow in blocks."""
    rows = [(k, "user", ["same.", f"more {k}", "", f"fine {k}."][k % 4]) for k in range(3000)]
    rows += [(3000 + k, "user", f"fine {k}!") for k in range(2000)] + [(5000 + k, "system", f"s {k}!") for k in range(2000)] + [(7000 + k, "assistant", f"s {k}") for k in range(2000)]
    cut = defaultdict(int)
    for p in cr.pieces_of(rows):
        for name, n in zip(cr.PIECE_NAMES, p):
            cut[name] += n if isinstance(n, int) else 0
    assert cut["cost"] == plain_summary(rows)[5]
