"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from accordant.llm import turn_repair

SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Best (cost, audit) by tables of what may stand last after each row: nothing, s, u or a."""
    best = {"": (0, "")}

    def grow(table, last, way):
        if last not in table or way < table[last]:
            table[last] = way

    for i in range(len(rows) + 1):
        for _ in range(4):  # inserts
            for last, (cost, audit) in list(best.items()):
                grow(best, "a" if last == "u" else "u", (cost + 5, audit + "I"))
        if i == len(rows):
            break
        after = {}
        initial, fault = rows[i]
        for last, (cost, audit) in best.items():
            grow(after, last, (cost + 2, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            onward = "a" if last == "u" else "u"
            if initial == onward or initial == "s" and last == "":
                grow(after, initial, (cost + extra, audit + "K"))
            grow(after, onward, (cost + extra + 1, audit + "R"))
        best = after
    return min(best[last] for last in ("", "a") if last in best)


def letters(rows):
    out = ""
    for initial, fault in rows:
        c = initial if initial in tuple("sua") else "o"
        out += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    return out


def test_search_finds_the_cheapest():
    rng = random.Random(1)
    for _ in range(4000):
        rows = [(rng.choice("suuaao"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 9))]
        assert turn_repair.search(letters(rows)) == cheapest(rows), rows
    rows = [(rng.choice("suuaa"), rng.choice([None] * 6 + ["blank", "truncated"])) for _ in range(400)]
    assert turn_repair.search(letters(rows)) == cheapest(rows)
    assert turn_repair.search("u" * 512)[0] == cheapest([("u", None)] * 512)[0]


def test_bounds_never_exceed_the_cost():
    rng = random.Random(2)
    for _ in range(800):
        rows = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 7)))
        first, begun = turn_repair.lower_bounds(rows)
        for i in range(len(rows) + 1):
            for state in turn_repair.STATES:
                found = [turn_repair.search(rows[i:], state, (e,)) for e in turn_repair.STATES]
                assert min(f[0] for f in found if f) >= (begun if state else first)[i]


def expected(turns):
    """The whole contract in plain Python: {conv_id: row}."""
    convs = {}
    for conv_id, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs.setdefault(conv_id, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        rows += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv_id, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            shown = SHOWN.findall(text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults)])
        lines, i, last = [], 0, ""
        for e in audit:
            onward = "a" if last == "u" else "u"
            name = {"a": "assistant", "u": "user"}[onward]
            if e == "I":
                lines.append(f"{name}:")
            elif e != "D":
                lines.append(f"{rows[i][1] if e == 'K' else name}:{rows[i][2]}")
            last = last if e == "D" else rows[i][1][:1] if e == "K" else onward
            i += e != "I"
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv_id] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def summarised(turns, **options):
    out = {}
    for r in turn_repair.summary(turn_repair.repair(turn_repair.damage(turns), **options)).collect():
        out[r["conv"]] = tuple(r)[1:]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_registered_query(spark, size):
    import __spark_entry__ as contract

    sf = f"/root/testdata/{size}"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in contract.queries()["op11_turn_repair"](spark, sf).collect()}
    assert got == expected(turns)


def test_odd_rows_and_many_blocks(spark):
    rng = random.Random(4)
    texts = ["Fine.", "Fine.", "cut off", "", "  \n", None, "é!", "x" * 9000 + "?", "No? "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "User", "tool"]
    turns = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, 1, 2, 3, 4] for _ in range(rng.randint(1, 40))]
    turns += [(9, i, rng.choice(roles[:5]), f"{rng.random()}.") for i in range(700)] + [(10, 1, "user", "same.")] * 90  # long, and equal rows
    df = spark.createDataFrame([(*t, "theirs") for t in turns], "conv_id long, turn long, role string, text string, place string")
    want = {c: row for c, row in expected(turns).items() if row[-2] or any(row[:5])}
    for rows_per_block in (16, 512):
        got = summarised(df, rows_per_block=rows_per_block)
        assert {c: got[c] for c in want} == want
    edits = turn_repair.repair(turn_repair.damage(df))
    assert edits.columns == ["conv", "block", "step", "edit", "fault", "turn", "role", "text", "new_role", "new_text"]
    assert summarised(df.limit(0)) == {}
    with pytest.raises(ValueError):
        turn_repair.repair(df, rows_per_block=100)
