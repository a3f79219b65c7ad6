import functools
import hashlib
import random
import sys
import zlib
from collections import defaultdict

import duckdb
import pytest

from sparkloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, key string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Cost and letters of (initial, fault) rows, from costs still to come and then the least letter each time."""
    sys.setrecursionlimit(100_000)

    def ways(i, state, inserts):
        if inserts < 2:
            yield "I", 2, i, NEXT[state], inserts + 1
        if i < len(rows):
            initial, fault = rows[i]
            yield "D", 3, i + 1, state, 0
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                yield "R", 2 + cut, i + 1, NEXT[state], 0
                if initial and initial == NEXT[state] or (initial == "s" and state == ""):
                    yield "K", cut, i + 1, initial, 0

    @functools.cache
    def left(i, state, inserts):
        done = [0] if i == len(rows) and state in ("", "a") else []
        return min(done + [cost + left(*after) for _, cost, *after in ways(i, state, inserts)], default=10**9)

    for i in range(len(rows), -1, -1):
        for state in NEXT:
            left(i, state, 0)
    at, out = (0, "", 0), []
    while not (at[0] == len(rows) and left(*at) == 0 and at[1] in ("", "a")):
        letter, after = min((letter, tuple(after)) for letter, cost, *after in ways(*at) if cost + left(*after) == left(*at))
        out.append(letter)
        at = after
    return left(0, "", 0), "".join(out)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, said in groups.items():
        after = []
        for turn, role, text in said:
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = "user" if how == 4 else role, "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
            after += [(turn, role, text)] * ((how != 0) + (how == 3))
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in after:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(after, faults)])
        lines, state, i = [], "", 0
        for letter in audit:
            name = {"u": "user", "a": "assistant"}[NEXT[state]]
            if letter == "I":
                lines.append(f"{name}:")
                state = NEXT[state]
                continue
            if letter == "R":
                lines.append(f"{name}:{after[i][2]}")
                state = NEXT[state]
            elif letter == "K":
                lines.append(f"{after[i][1]}:{after[i][2]}")
                state = after[i][1][0]
            i += 1
        turns = {r[0] for r in after} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def awkward():
    draw = random.Random(5)
    texts = ["Fine.", "Fine.", "cut off", "", " \n", None, "why?", "é😀!", "tail. \t", "nbsp.\xa0"]
    rows = [(c, draw.choice([None, t, t, t + draw.randrange(3)]), draw.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "uncle"]), draw.choice(texts) if draw.random() < 0.6 else f"text {draw.random()}.") for c in range(120) for t in range(draw.randrange(1, 14))]
    rows += [(None, 1, "user", "null id."), (None, None, None, None), (500, 0, "user", "again."), (500, 0, "user", "again.")]
    rows += [(600, t, draw.choice(["user", "assistant", "system", "tool"]), f"t{draw.randrange(400)}" + draw.choice([".", ""])) for t in range(700)]
    return rows + [(700, t, "tool", f"number {t}.") for t in range(300)] + [(800, None, "user", "z" * 60_000)] * 2


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "k") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("long", [False, True])
def test_op12_matches_brute_force_and_sql(spark, tmp_path, monkeypatch, long):
    if long:
        monkeypatch.setattr(repair, "LONG_ROWS", 3)
        monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = awkward()
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, repair.op12_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    if not long:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert sorted(con.execute(repair.OP12_SQL).fetchall(), key=str) == got


def test_survivors_against_costs_to_come():
    draw = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 40, 300] * 12:
        codes = [draw.choice([0, 3, 4, 5, 6, 7, 8, 9, 11, 12, 15]) for _ in range(n)]
        search, out = repair.Survivors(), b""
        for code in codes:
            search.feed(code)
            out += search.settled()
        cost, last = search.finish()
        assert (cost, (out + last).decode()) == cheapest([(repair.CLASSES[c // 4], repair.FAULTS[c % 4]) for c in codes])


def test_what_is_settled_is_forgotten():
    draw, search, most = random.Random(2), repair.Survivors(), 0
    for _ in range(100_000):
        search.feed(draw.choice([4, 4, 8, 8, 7, 11, 5, 6, 15]))
        search.settled()
        paths = {id(node): node for _, _, node in search.live}
        for node in list(paths.values()):
            while node.up is not None:
                node = node.up
                paths[id(node)] = node
        assert len(paths) <= 7
        most = max(most, sum(len(n.edge) for n in paths.values()))
    assert most < 500


def test_empty_table(spark):
    assert repair.repaired(table(spark, [])).count() == 0
