"""Repair of damaged conversations: the cheapest edits to an alternating one, by a Viterbi search with coalescing survivors.

Four states say what has been put out: nothing (0), a system turn (1), up to a user's (2) or an assistant's turn (3). Each
row moves every state on by inserts and then one of delete, keep and rerole; the cheapest path into a state survives, of
equally cheap ones the one whose letters sort first. Survivors share a tree of back pointers with counts of their
children. What is left of the root has only one way down is settled, so it is handed out and forgotten, and memory holds
the letters of unsettled rows only. Paths of the same rows end in a row's letter, so none is the beginning of another and
their order never changes later; it is kept as a rank, which compares whole unsettled paths at once.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, guarded, written
from .trie import crc_sql
from .turns import conversations, in_order

SPACE = r"\x20\x09-\x0D"
#: Conversations of more rows or code points than this are cut into blocks and settled as streams, shorter ones whole.
LONG_ROWS, LONG_CHARS = 4096, 4 << 20
#: Bits of the rows that a block of codes holds.
BLOCK_BITS = 12
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
CLASSES, FAULTS = ("s", "u", "a", ""), ("", "blank", "duplicate", "truncated")
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A code is 4 * class of the role's initial + fault, as a letter from A on.
FIRST = ord("A")
TURN = {0: (2, 3), 1: (2, 3), 2: (3, 2), 3: (2, 3)}  # the state after one insert, and after two
#: What state y needs at most, beside what state x pays, to put out whatever may follow x: SPARE[x][y].
SPARE = {0: {1: 4, 2: 5, 3: 3}, 1: {0: 0, 2: 2, 3: 0}, 2: {0: 2, 1: 2, 3: 2}, 3: {0: 0, 1: 4, 2: 2}}
ENDING = {0: (0, b""), 1: (2 * INSERT, b"II"), 2: (INSERT, b"I"), 3: (0, b"")}


def _moves(state: int, code: int) -> list[tuple[int, int, bytes]]:
    """Where a row of this code leads from a state: the new state, its cost and letters, the best for each new state."""
    kind, fault = divmod(code, 4)
    best: dict[int, tuple[int, bytes]] = {}
    for inserts, at in ((0, state), (1, TURN[state][0]), (2, TURN[state][1])):
        ways = [(at, DELETE, b"D")]
        if fault not in (1, 2):
            cut = CUT * (fault == 3)
            ways.append((TURN[at][0], REROLE + cut, b"R"))
            if (kind == 0 and at == 0) or (kind in (1, 2) and TURN[at][0] == kind + 1):
                ways.append((kind + 1, KEEP + cut, b"K"))
        for new, cost, letter in ways:
            found = (cost + INSERT * inserts, b"I" * inserts + letter)
            best[new] = min(best.get(new, found), found)
    return [(new, *found) for new, found in best.items()]


MOVES = [[_moves(state, code) for code in range(16)] for state in range(4)]


class Node:
    """A stretch of letters that all paths below share; `kids` counts the ways that go on from it."""

    __slots__ = ("edge", "kids", "up")

    def __init__(self, up: Node | None, edge: bytes) -> None:
        self.up, self.edge, self.kids = up, bytearray(edge), []


class Survivors:
    """The cheapest paths so far, in the order of their letters."""

    def __init__(self) -> None:
        self.root = Node(None, b"")
        self.live = [(0, 0, self.root)]

    def feed(self, code: int) -> None:
        best: dict[int, tuple[int, int, bytes]] = {}
        for rank, (state, cost, _) in enumerate(self.live):
            for new, more, letters in MOVES[state][code]:
                way = (cost + more, rank, letters)
                if new not in best or way < best[new]:
                    best[new] = way
        kept = [(rank, letters, new, cost) for new, (cost, rank, letters) in best.items() if not any(y != new and cost > other[0] + SPARE[new][y] for y, other in best.items())]
        ways: list[list] = [[] for _ in self.live]
        for way in sorted(kept):
            ways[way[0]].append(way)
        before, self.live = self.live, []
        for (_, _, node), mine in zip(before, ways, strict=True):
            for _, letters, new, cost in mine:
                if len(mine) == 1:
                    node.edge += letters
                    kid = node
                else:
                    kid = Node(node, letters)
                    node.kids.append(kid)
                self.live.append((new, cost, kid))
        self._release([node for (_, _, node), mine in zip(before, ways, strict=True) if not mine])

    def _release(self, dead: list[Node]) -> None:
        """Take paths that have died out of the tree; what then has one way on is joined with it."""
        while dead:
            node = dead.pop()
            up = node.up
            up.kids.remove(node)
            if len(up.kids) == 1:
                only = up.kids[0]
                up.edge += only.edge
                up.kids = only.kids
                for kid in up.kids:
                    kid.up = up
                self.live = [(state, cost, up if at is only else at) for state, cost, at in self.live]
                dead = [up if at is only else at for at in dead]

    def settled(self) -> bytes:
        """Letters that all survivors share and that have not been handed out."""
        out = bytes(self.root.edge)
        self.root.edge.clear()
        return out

    def finish(self) -> tuple[int, bytes]:
        """The cost of the whole, and its last letters."""
        cost, rank, last = min((cost + ENDING[state][0], rank, ENDING[state][1]) for rank, (state, cost, _) in enumerate(self.live))
        node, path = self.live[rank][2], [last]
        while node is not None:
            path.append(bytes(node.edge))
            node = node.up
        return cost, b"".join(reversed(path))


class Replay:
    """The repaired rows' hash, and their letters, from rows with the edits that precede and meet each."""

    def __init__(self) -> None:
        self.state, self.hash, self.first, self.letters = 0, hashlib.sha256(), True, bytearray()

    def _line(self, line: bytes) -> None:
        self.hash.update(line if self.first else b"\n" + line)
        self.first = False

    def _turn(self, text: bytes) -> None:
        self.state = TURN[self.state][0]
        self._line((b"user:" if self.state == 2 else b"assistant:") + text)

    def row(self, letters: bytes, role: str, text: str) -> None:
        """Inserts, one letter for the row, and inserts again after the last row."""
        self.letters += letters
        for letter in letters:
            if letter == 73:  # I
                self._turn(b"")
            elif letter == 82:  # R
                self._turn(text.encode())
            elif letter == 75:  # K
                self.state = CLASSES.index(role[0]) + 1
                self._line(f"{role}:{text}".encode())


def cut_rows(letters: bytes) -> list[bytes]:
    """Letters of each row: inserts before it and its own; inserts after the last row go with it."""
    out, begin = [], 0
    for at, letter in enumerate(letters):
        if letter != 73:
            out.append(letters[begin : at + 1])
            begin = at + 1
    if begin < len(letters):
        out[-1:] = [b"".join([*out[-1:], letters[begin:]])]
    return out


class Counts:
    """Numbers of faults and of role initials next to each other that may not be."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None

    def add(self, code: int) -> None:
        kind, fault = divmod(code, 4)
        self.faults[fault] += 1
        self.illegal += self.last is not None and (self.last, kind) not in LEGAL
        self.last = kind


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage, with `key`, the decimal conv_id or one space; null roles and texts are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), space("conv_id").alias("key"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("how"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    times = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.where("how <> 0").select("conv_id", "turn", role, text, "key", times).drop("copy")


def _code() -> Column:
    """A row's code, but for being a duplicate."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return 4 * kind + F.when(last == "", FAULTS.index("blank")).when(last.isin(*".!?"), 0).otherwise(FAULTS.index("truncated"))


RESULT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, gaps long"


def _grouped(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, tuple]]:
    """Rows of sorted batches, each with whether its key is a new one."""
    last = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            yield row[0] != last, row
            last = row[0]


def _batches(rows: Iterable[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    pack = lambda held: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kind) for i, (_, kind) in enumerate(schema)], [n for n, _ in schema])
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > 4 << 20:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _of_short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows come whole and in order."""

    def result(key: str, rows: list[tuple]) -> tuple:
        seen, counts, search = set(), Counts(), Survivors()
        for _, _, role, text, code in rows:
            if code % 4 != 1 and (role, text) in seen:
                code = code - code % 4 + 2
            seen.add((role, text))
            counts.add(code)
            search.feed(code)
        cost, letters = search.finish()
        replay = Replay()
        for mine, (_, _, role, text, _) in zip(cut_rows(letters), rows, strict=True):
            replay.row(mine, role, text)
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return (key, *counts.faults[1:], counts.illegal, cost, letters.decode(), replay.hash.hexdigest(), gaps)

    def results() -> Iterator[tuple]:
        rows: list[tuple] = []
        for new, row in _grouped(batches, ["key", "turn", "role", "text", "code"]):
            if new and rows:
                yield result(rows[0][0], rows)
                rows = []
            rows.append(row)
        if rows:
            yield result(rows[0][0], rows)

    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]
    yield from _batches(results(), list(zip([x.split()[0] for x in RESULT.split(", ")], kinds, strict=True)))


SETTLED = [("key", pa.string()), ("first", pa.int64()), ("letters", pa.string()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]]


def _of_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of the rows of each block, handed out as soon as they are settled, and each conversation's counts."""

    def settled(search: Survivors, open_: deque, part: bytearray, last: bytes | None) -> Iterator[tuple]:
        part += search.settled() if last is None else last
        while len(open_) > (last is None):  # the last block waits for inserts behind its rows
            key, first, size = open_[0]
            if len(part) - part.count(b"I") < size:
                return
            own = cut_rows(bytes(part))
            whole = len(open_) == 1 and last is not None
            letters = bytes(part) if whole else b"".join(own[:size])
            open_.popleft()
            del part[: len(letters)]
            yield (key, first, letters.decode(), None, None, None, None, None)

    def rows() -> Iterator[tuple]:
        key = None
        for new, (key_, first, codes) in _grouped(batches, ["key", "first", "codes"]):
            if new:
                if key is not None:
                    yield from closing(key, search, counts, open_, part)
                key, search, counts, open_, part = key_, Survivors(), Counts(), deque(), bytearray()
            open_.append((key, first, len(codes)))
            for code in codes.encode():
                counts.add(code - FIRST)
                search.feed(code - FIRST)
            yield from settled(search, open_, part, None)
        if key is not None:
            yield from closing(key, search, counts, open_, part)

    def closing(key: str, search: Survivors, counts: Counts, open_: deque, part: bytearray) -> Iterator[tuple]:
        cost, last = search.finish()
        yield from settled(search, open_, part, last)
        yield (key, None, None, *counts.faults[1:], counts.illegal, cost)

    yield from _batches(rows(), SETTLED)


def _of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """audit and repaired_sha256 of conversations whose rows come in order with their letters."""

    def rows() -> Iterator[tuple]:
        key, replay = None, None
        for new, (key_, letters, role, text) in _grouped(batches, ["key", "letters", "role", "text"]):
            if new:
                if key is not None:
                    yield (key, replay.letters.decode(), replay.hash.hexdigest())
                key, replay = key_, Replay()
            replay.row(letters.encode(), role, text)
        if key is not None:
            yield (key, replay.letters.decode(), replay.hash.hexdigest())

    yield from _batches(rows(), [("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repaired_short(rows: DataFrame) -> DataFrame:
    """Results of conversations that a task may hold whole."""
    held = rows.select("key", "turn", "role", "text", _code().alias("code")).repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return held.mapInArrow(_of_short, RESULT)


def repaired_long(rows: DataFrame) -> DataFrame:
    """Results of conversations of any length: codes and then texts pass through their tasks as streams."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    ranged = written(in_order(rows).select("key", "at", "turn", "role", "text", _code().alias("code"), digest.alias("digest")))
    firsts = ranged.groupBy("key", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.col("code") % 4
    code = F.when(F.col("new").isNull() & (fault != 1), F.col("code") - fault + 2).otherwise(F.col("code"))
    coded = ranged.select("key", "at", "code").join(firsts, "at", "left").select("key", "at", F.char(code + FIRST).alias("code"))
    blocks = coded.groupBy("key", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
    blocks = written(blocks.select("key", F.col("rows")[0]["at"].alias("first"), F.array_join(F.col("rows.code"), "").alias("codes")))
    schema = "key string, first long, letters string, blank long, duplicate long, truncated long, illegal long, cost long"
    settled = written(blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_of_codes, schema))
    own = F.posexplode(F.regexp_extract_all("letters", F.lit("I*[DKR](?:I+$)?"), F.lit(0))).alias("place", "letters")
    edits = settled.where("first is not null").select("first", own).select((F.col("first") + F.col("place")).alias("at"), "letters")
    texts = ranged.select("key", "at", "role", "text").join(edits, "at").select("key", "at", "letters", "role", "text")
    told = texts.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_of_rows, "key string, audit string, repaired_sha256 string")
    gaps = ranged.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    counts = settled.where("first is null").select("key", "blank", "duplicate", "truncated", "illegal", "cost")
    return counts.join(told, "key").join(gaps, "key").select(*[x.split()[0] for x in RESULT.split(", ")])


def repaired(turns: DataFrame) -> DataFrame:
    """Each conv_id of `turns` with gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn (null first), ties by role and text; a repeated row is a duplicate. Null conv_ids are one
    conversation; null roles and texts are one space, which is blank, or a role that can't be kept. Conversations
    without rows after damage have zeros, and a table without rows has no result. Other columns are not looked at.
    """
    rows = damaged(turns)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    long = written(sizes.where((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).select("key"))
    found = repaired_short(rows.join(guarded(long), "key", "left_anti"))
    if not long.isEmpty():
        found = found.unionByName(repaired_long(rows.join(guarded(long), "key", "left_semi")))
    ids = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every conv_id; nulls, ties and empty tables as repaired() says."""
    return repaired(conversations(spark, sf_dir))


OP12_SQL = f"""
WITH RECURSIVE o AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS key, any_value(conv_id) AS conv_id FROM conversations GROUP BY 1),
b AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations),
c AS (SELECT key, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM b WHERE how <> 0),
d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i, role[1:1] AS ini, regexp_extract(text, '([^{SPACE}])[{SPACE}]*$', 1) AS last FROM c),
e AS (SELECT *, lag(ini) OVER (PARTITION BY key ORDER BY i) AS prev, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 2 WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM d),
n AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY key),
ins(p, q, cost, letters, lines) AS (VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('0', 'u', 2, 'I', '
user:'), ('s', 'u', 2, 'I', '
user:'), ('a', 'u', 2, 'I', '
user:'), ('u', 'a', 2, 'I', '
assistant:'), ('0', 'a', 4, 'II', '
user:
assistant:'), ('s', 'a', 4, 'II', '
user:
assistant:')),
st AS (SELECT key, 0::BIGINT AS i, '0' AS state, {{'cost': 0, 'audit': '', 'lines': ''}} AS best FROM n
  UNION ALL
  SELECT key, i, state, min(best) FROM (
    SELECT st.key, e.i, CASE op WHEN 'D' THEN q WHEN 'K' THEN ini WHEN 'R' THEN CASE WHEN q = 'u' THEN 'a' ELSE 'u' END END AS state,
      {{'cost': st.best.cost + ins.cost + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 3 AND op <> 'D' THEN 1 ELSE 0 END, 'audit': st.best.audit || ins.letters || op,
        'lines': st.best.lines || ins.lines || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE WHEN q = 'u' THEN 'assistant' ELSE 'user' END || ':' || text END}} AS best
    FROM st JOIN ins ON ins.p = st.state JOIN e ON e.key = st.key AND e.i = st.i + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) ops(op)
    WHERE op = 'D' OR (fault IN (0, 3) AND (op = 'R' OR q || ini IN ('0s', '0u', 'su', 'ua', 'au')))) GROUP BY key, i, state),
z AS (SELECT st.key, min({{'cost': best.cost + ins.cost, 'audit': best.audit || ins.letters, 'lines': best.lines || ins.lines}}) AS best
  FROM st JOIN n ON n.key = st.key AND n.n = st.i JOIN ins ON ins.p = st.state AND ins.q IN ('0', 'a') GROUP BY st.key)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.lines, ''), 2)) AS repaired_sha256
FROM o LEFT JOIN n USING (key) LEFT JOIN z USING (key)
"""
