"""Conversation repair against a search over all cheapest edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tailwatch.llm import queries, turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, symbol string, part int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """One conversation: best (cost, audit, turns) of each state after each row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = WORD.findall(text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, turns) in list(states.items()):
                role, to = ("assistant", 3) if s == 2 else ("user", 2)
                new = (cost + 5, audit + "I", (*turns, f"{role}:"))
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = {0: (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(to, entry, new=new):
            if to not in new or entry[:2] < new[to][:2]:
                new[to] = entry

        for s, (cost, audit, turns) in inserted(states).items():
            offer(s, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            want, to = ("assistant", 3) if s == 2 else ("user", 2)
            offer(to, (cost + 1 + more, audit + "R", (*turns, f"{want}:{text}")))
            if role[:1] == want[0]:
                offer(to, (cost + more, audit + "K", (*turns, f"{role}:{text}")))
            if role[:1] == "s" and s == 0:
                offer(1, (cost + more, audit + "K", (*turns, f"{role}:{text}")))
        states = new
    cost, audit, turns = min(e for s, e in inserted(states).items() if s in (0, 3))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()), turns


def expected(rows):
    convs = defaultdict(list)
    for r in damage(rows):
        convs[r[0]].append(r)
    return {c: repair(convs[c]) for c in {r[0] for r in rows}}


def odd_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No", "Why?", "", " \t", "a long answer. ", None, "é ß!", "x" * 200_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(300) for _ in range(rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(30)]
    rows += [(900, None, "user", "Hi.")] * 40
    rows += [(901, t, ["user", "assistant"][t % 2], f"Turn {t}{'.' if t % 7 else ''}") for t in range(1500)]
    rows += [(901, t, "assistant", f"More {t}.") for t in range(400, 900)]
    rows += [(902, t, "user", "Same.") for t in range(1200)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA)


def found(spark, rows):
    df = frame(spark, rows)
    out = turn_repair.digests(turn_repair.damaged(df), df.select(F.col("conv_id").alias("conv"))).collect()
    return {r["conv"]: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("partitions", [1, 13])
def test_repair_matches_search(spark, partitions):
    """Cut conversations included: 13 partitions part the long ones."""
    rows = odd_rows()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {c: r for c, (r, _) in expected(rows).items()}
    assert set(got) == set(want)
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}


def test_repaired_turns_are_legal(spark):
    rows = odd_rows()
    df = turn_repair.damaged(frame(spark, rows))
    got = defaultdict(list)
    for r in turn_repair.repaired_turns(df).orderBy("place").collect():
        got[r["conv"]].append(f"{r['role']}:{r['text']}")
    want = {c: list(t) for c, (_, t) in expected(rows).items() if t}
    assert dict(got) == want
    assert all(re.fullmatch(r"s?(ua)+", "".join(t[0] for t in turns)) for turns in want.values())


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES["op11_turn_repair"](spark, sf)
    assert dict(out.dtypes) == {"conv_id": "bigint", **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "repaired_sha256": "string"}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in out.collect()} == {c: r for c, (r, _) in expected(rows).items()}


def test_empty(spark):
    assert found(spark, []) == {}


def test_powers_advance_runs():
    for symbol in range(12):
        for n in (1, 2, 5, 37):
            one = turn_repair.run_matrix(symbol, 1)
            many = one
            for _ in range(n - 1):
                many = turn_repair._times(many, one)
            assert (turn_repair.run_matrix(symbol, n) == many).all()
    runs = [(4 * 1, 3000), (2 * 3, 2500)]
    assert len(list(turn_repair.unrolled(runs, turn_repair.at_end(), 0))) == 5500
