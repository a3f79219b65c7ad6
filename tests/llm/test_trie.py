import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from sparkloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, at string, depth long"


def brute(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v)] for c, v in said.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in said:
        h, b = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        turns = tuple(said.get(b, [])[:h] + said[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        listed = ",".join(map(str, sorted(ends[node])))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def awkward():
    rows = []
    for c in [*range(-3, 40), 100, *range(130, 160), 250, 251, 310]:
        for turn in range(c % 7 + 1):
            rows.append((c, turn, ["user", "assistant", None][turn % 3], ["same", None, "", "é😀 text", f"t{c % 4}"][(turn + c % 3) % 5]))
    rows += [(500, None, "user", "b"), (500, None, "user", "a"), (500, 0, "user", "a"), (500, 0, "user", "a"), (None, 0, "user", "nobody"), (501, 0, "x" * 40, "y" * 50_000), (501, 0, "x" * 40, "y" * 50_000)]
    rows += [(700 + i, j, "user", "copy") for i in range(60) for j in range(8)]
    rows += [(900, i, "user", f"long {i % 5}") for i in range(600)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


def test_op11_matches_brute_force_and_sql(spark, tmp_path):
    rows = awkward()
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, trie.op11_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(trie.OP11_SQL).fetchall(), key=str) == got


def test_end_lists_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    rows = [(1, 5, 6, c) for c in range(500)] + [(2, 5, c, c) for c in range(40)] + [(0, 0, 0, -3), (0, 0, 0, 10), (0, 0, 0, 2)]
    found = trie.end_lists(spark.createDataFrame(rows, "depth long, k1 long, k2 long, conv_id long").repartition(3)).collect()
    want = {(1, 5, 6): range(500), (0, 0, 0): (-3, 2, 10)} | {(2, 5, c): [c] for c in range(40)}
    assert {tuple(r)[:3]: r["ends_sha256"] for r in found} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_without_conversations(spark, rows):
    assert trie.prefix_trie(table(spark, rows)).count() == 0
