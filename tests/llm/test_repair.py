from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarmac.llm import queries, repair

SF = "/root/testdata/sf0.001"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, conv string, cost string, letter string, fault string"


def table(spark, rows):
    return spark.createDataFrame([(*row, *("x",) * 5) for row in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def _with_inserts(best):
    for _ in range(4):
        for state, (cost, audit, lines) in list(best.items()):
            then = "a" if state == "u" else "u"
            new = (cost + 2, audit + "I", [*lines, ("user:" if then == "u" else "assistant:")])
            if then not in best or new[:2] < best[then][:2]:
                best[then] = new
    return best


def cheapest(rows, faults):
    """(cost, audit, lines) by trying every edit in every state and keeping the least cost and text."""
    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults):
        found = {}

        def offer(state, cost, audit, lines):
            if state not in found or (cost, audit) < found[state][:2]:
                found[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in _with_inserts(best).items():
            offer(state, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = int(fault == "truncated")
            if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                offer(role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"])
            new = "assistant" if state == "u" else "user"
            offer(new[0], cost + 2 + more, audit + "R", [*lines, f"{new}:{text}"])
        best = found
    return min((value for state, value in _with_inserts(best).items() if state in ("", "a")), key=lambda value: value[:2])


def plain(rows, conversations):
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {conv: (0,) * 6 + ("", EMPTY) for conv in conversations}
    for conv, own in grouped.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            core = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {turn for turn, *_ in own if turn is not None}
        roles = [role[:1] for _, role, _ in own]
        cost, audit, lines = cheapest([row[1:] for row in own], faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(frame):
    rows = frame.collect()
    out = {row.conv_id: tuple(row[name] for name in COLUMNS) for row in rows}
    assert len(out) == len(rows)
    return out


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op12_ranked_repair"](spark, SF)) == plain(damaged(rows), {row[0] for row in rows})


def sample(seed, rows, convs):
    chance = random.Random(seed)
    texts = ["yes.", "no!", "why", "", " \t", None, "more?", "end\n", "x" * 50 + "."]
    return [(chance.choice(convs), chance.choice([None, *range(12)]), chance.choice(["user", "assistant", "system", "tool", None, "", "u", "sage"]),
             chance.choice(texts)) for _ in range(rows)]


@pytest.mark.parametrize("chunk", [5, 4096])
def test_awkward_rows_over_many_pieces(spark, chunk):
    # One conversation holds over a third of all rows; one id is null; one has long runs of copies.
    rows = sample(1, 120, [1, 2, None]) + sample(2, 90, [7]) + [(9, 3, "user", "the same.")] * 40 + [(10, None, None, None)]
    rows += [(11, i, ("user", "assistant")[i % 2], f"turn {i}." * (4000 if i == 3 else 1)) for i in range(40)]
    frame = table(spark, rows)
    assert found(repair.audit(frame, chunk=chunk)) == plain(rows, {row[0] for row in rows})
    assert found(repair.audit(repair.damage(frame), frame, chunk)) == plain(damaged(rows), {row[0] for row in rows})


def test_empty_table_and_conversations_without_rows(spark):
    empty = table(spark, [])
    assert repair.audit(empty).collect() == [] and repair.audit(repair.damage(empty), empty).collect() == []
    named = table(spark, [(4, 1, "user", "a."), (None, 1, "user", "a.")])
    assert found(repair.audit(empty, named)) == dict.fromkeys((4, None), (0,) * 6 + ("", EMPTY))


def test_ranks_order_the_least_audits():
    chance = random.Random(8)
    for _ in range(20):
        lengths = np.array([chance.randrange(1, 20) for _ in range(3)])
        ends = np.cumsum(lengths + 1) - 1
        codes = np.array([chance.randrange(repair.GONE + 1) for _ in range(ends[-1] + 1)])
        codes[ends] = -1
        costs = repair.costs_before(codes, ends, lengths, np.tile(repair._END, (3, 1)))
        filled = codes == -1
        then = repair.optimal_arcs(codes, costs, filled)
        pointers = repair.ranked_pointers(then)

        def least(node):
            options = [(letter, int(to)) for letter, to in enumerate(then[node]) if to >= 0]
            return min((repair.LETTERS[letter] + least(to) for letter, to in options), default="")

        for start, end in zip(ends - lengths, ends):
            assert costs[start].tolist() == (repair.product(codes[start:end]) + repair._END).min(axis=1).tolist()
            for state in range(repair.STATES):
                path = repair.least_paths(pointers, np.array([start * repair.STATES + state]))
                put_in, letters, _ = repair.planned(then, path)
                audit = "".join("I" * int(put_in[place]) + ("" if place == end else repair.LETTERS[letters[place]]) for place in range(start, end + 1))
                assert audit == least(start * repair.STATES + state)


def test_repaired_rows_follow_the_grammar(spark):
    rows = sample(5, 150, [1, 2, 3])
    edited = repair.edits(repair.ordered_rows(table(spark, rows)), 8)
    out = repair.repaired(edited).orderBy("conv", "pos", "place").collect()
    for conv in "123":
        assert re.fullmatch("(s?(ua)+)?", "".join(row.role[:1] for row in out if row.conv == conv))
