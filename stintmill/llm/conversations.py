"""Operator 13: conversation structure repair by a persistent audit DP.

A conversation's rows are kept, given another role, deleted, or have rows inserted between them, at the least
cost after which its roles read as an optional system row and then user and assistant in turns. The
audit is the string of edits; of equally cheap audits the ASCII-least is taken.

The DP holds a cost and an audit for each of four states. Audits are linked nodes that share their prefixes;
a node has its depth, its parent's parents at distances of powers of two, and a rolling hash of its string.
Ties are decided by the longest common prefix, found by lifting both nodes while their hashes differ; the
equality that the hashes tell is then verified along the nodes, and a collision falls back to the strings.
A state and an audit fix what follows, so no cheapest audit is a proper prefix of another and prefixes may
be compared where they meet.

Spark ranges rows by conversation and turn, so a crowded conversation lies over many partitions. A
conversation inside a partition is repaired there. One that reaches over its edge, or is longer than a block, is
cut into parts: a part hands on its cheapest audits from each state to each state, which compose, and only
these are brought together by conversation. Equal rows of a turn travel as one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, table
from .linking import crowded, spread_join

BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
EDITS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
BLOCK_ROWS = 2000
BLOCK_CHARS = 1 << 20
BASE, PRIME = 1_000_003, (1 << 61) - 1


class Audits:
    """Strings as nodes that share prefixes; node 0 is the empty string."""

    def __init__(self):
        self.char, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, parent: int, char: str) -> int:
        up, k = [parent], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.char.append(char)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append(self._rolled(self.hash[parent], char))
        self.up.append(up)
        return len(self.char) - 1

    def _rolled(self, before: int, char: str) -> int:
        return (before * BASE + ord(char)) % PRIME

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _ancestor(self, node: int, depth: int) -> int:
        while (far := self.depth[node] - depth) > 0:
            node = self.up[node][far.bit_length() - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        while a != b:
            if self.char[a] != self.char[b] or self.depth[a] != self.depth[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's string sorts before b's."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._ancestor(a, depth), self._ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.string(a) < self.string(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self._same(self.up[x][0], self.up[y][0]) and self.char[x] != self.char[y]:
            return self.char[x] < self.char[y]
        return self.string(a) < self.string(b)  # two strings share a hash


def _offer(best: list, audits: Audits, state: int, cost: int, parent: int, char: str) -> None:
    held = best[state]
    if held is None or cost < held[0]:
        best[state] = (cost, audits.add(parent, char))
    elif cost == held[0]:
        node = audits.add(parent, char)
        if audits.less(node, held[1]):
            best[state] = (cost, node)


def _inserted(best: list, audits: Audits, price: int) -> None:
    """best with insertions: from a user's row to an assistant's, else to a user's."""
    for _ in range(2):
        for state in (START, SYSTEM, ASSISTANT, USER):
            if best[state] is not None:
                to = ASSISTANT if state == USER else USER
                cost, node = best[state]
                if best[to] is None or cost + price <= best[to][0]:
                    _offer(best, audits, to, cost + price, node, "I")


def cheapest(rows: list[tuple[str, str]], entry: int, prices: dict[str, int] = EDITS) -> list[tuple[int, str] | None]:
    """For each state the least (cost, audit) that leads there from ``entry``.

    rows: (initial of the role, fault); fault is blank, duplicate, truncated or empty.
    """
    audits, best = Audits(), [None] * 4
    best[entry] = (0, 0)
    _inserted(best, audits, prices["insert"])
    for initial, fault in rows:
        new: list = [None] * 4
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _offer(new, audits, state, cost + prices["delete"], node, "D")
            if fault in ("blank", "duplicate"):
                continue
            more = prices["truncated"] if fault else 0
            turn = ASSISTANT if state == USER else USER
            _offer(new, audits, turn, cost + prices["rerole"] + more, node, "R")
            if initial == "s" and state == START:
                _offer(new, audits, SYSTEM, cost + prices["keep"] + more, node, "K")
            elif initial == "ua"[turn - USER]:
                _offer(new, audits, turn, cost + prices["keep"] + more, node, "K")
        _inserted(new, audits, prices["insert"])
        best = new
    return [None if b is None else (b[0], audits.string(b[1])) for b in best]


def applied(rows: list[tuple[str, str]], audit: str, entry: int) -> list[str]:
    """``role:text`` of the rows (role, text) after the edits of an audit."""
    out, state, rest = [], entry, iter(rows)
    for edit in audit:
        role, text = next(rest) if edit != "I" else ("", "")
        if edit == "D":
            continue
        turn = ASSISTANT if state == USER else USER
        if edit == "K":
            state = SYSTEM if role[:1] == "s" else turn
        else:
            state, role = turn, ("user", "assistant")[turn - USER]
        out.append(f"{role}:{text}")
    return out


PART = (
    "conv_id long, pid int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, "
    "last_turn long, first_role string, last_role string, costs array<long>, audits array<string>, roles array<string>, texts array<string>, "
    "messages long, repaired string"
)
PART_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("pid", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")]
    + [("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("messages", pa.int64()), ("repaired", pa.string())]
)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Part:
    """Rows of one conversation in order, and what they say of it."""

    def __init__(self, conv_id: int | None, seq: int, begins: bool):
        self.conv_id, self.seq, self.begins, self.chars = conv_id, seq, begins, 0  # seq numbers the parts of a partition
        self.rows: list[tuple[str, str]] = []
        self.faults: list[tuple[str, str]] = []
        self.turns: list[int] = []

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        if turn is not None and copies and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        kept = text.rstrip(BLANKS)
        for n in range(copies):
            fault = "blank" if not kept else "duplicate" if seen or n else "truncated" if kept[-1] not in ".!?" else ""
            self.rows.append((role, text))
            self.faults.append((role[:1], fault))
        self.chars += copies * (len(text) + len(role))

    def record(self, pid: int, whole: bool) -> dict:
        initials = [i for i, _ in self.faults]
        out = {"conv_id": self.conv_id, "pid": pid, "seq": self.seq, "whole": whole}
        for fault in ("blank", "duplicate", "truncated"):
            out[fault] = sum(f == fault for _, f in self.faults)
        out["illegal"] = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
        out |= {"turns": len(self.turns), "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None}
        out |= {"first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None}
        ways = [w for entry in ([START] if whole else range(4)) for w in cheapest(self.faults, entry)]
        if whole:
            cost, audit = min(ways[s] for s in FINAL if ways[s] is not None)
            done = applied(self.rows, audit, START)
            return out | {"costs": [cost], "audits": [audit], "roles": None, "texts": None, "messages": len(done), "repaired": "\n".join(done)}
        out |= {"costs": [w and w[0] for w in ways], "audits": [w and w[1] for w in ways]}
        return out | {"roles": [r for r, _ in self.rows], "texts": [t for _, t in self.rows], "messages": None, "repaired": None}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the conversations of a partition that is sorted by conversation and turn.

    The first and the last conversation may go on in the partitions beside this one.
    """
    pid, seq, part, first, mark, held, size = TaskContext.get().partitionId(), 0, None, True, None, [], 0
    for batch in batches:
        for conv, turn, role, text, copies, key in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "key"))):
            if part is None or part.conv_id != conv:
                if part is not None:
                    held.append(part.record(pid, whole=not first and part.begins))
                    size, seq, first = size + part.chars + 100, seq + 1, False
                part = _Part(conv, seq, True)
            if copies is None:  # tells that the row after it was seen at an earlier turn
                mark = (conv, turn, key)
                continue
            seen = mark == (conv, turn, key)
            while copies > BLOCK_ROWS or len(part.rows) >= BLOCK_ROWS or part.chars >= BLOCK_CHARS:
                some = min(copies, BLOCK_ROWS - len(part.rows)) if part.chars < BLOCK_CHARS else 0
                part.add(turn, role, text, some, seen)
                copies, seen = copies - some, seen or some > 0
                held.append(part.record(pid, whole=False))
                size, seq = size + part.chars + 100, seq + 1
                part = _Part(conv, seq, False)
            part.add(turn, role, text, copies, seen)
            if size > BLOCK_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=PART_ARROW)
                held, size = [], 0
    if part is not None:
        held.append(part.record(pid, whole=False))
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=PART_ARROW)


class _Chain:
    """Composes the parts of one conversation, in order; candidates are linked parts that share their beginnings."""

    def __init__(self):
        self.best: list = [(0, None), None, None, None]  # (cost, (chain before, part, entry, exit, audit))

    @staticmethod
    def _strings(a, b) -> tuple[str, str]:
        """What two chains of as many parts say after the parts that they share."""
        left, right = [], []
        while a is not b:
            left.append(a[4])
            right.append(b[4])
            a, b = a[0], b[0]
        return "".join(reversed(left)), "".join(reversed(right))

    def add(self, part: tuple[int, int], costs: list, audits: list) -> None:
        new: list = [None] * 4
        for entry, held in enumerate(self.best):
            if held is None:
                continue
            for exit_ in range(4):
                if (more := costs[4 * entry + exit_]) is None:
                    continue
                cost, link = held[0] + more, (held[1], part, entry, exit_, audits[4 * entry + exit_])
                if new[exit_] is None or cost < new[exit_][0]:
                    new[exit_] = (cost, link)
                elif cost == new[exit_][0]:
                    mine, theirs = self._strings(link, new[exit_][1])
                    if mine < theirs:
                        new[exit_] = (cost, link)
        self.best = new

    def ways(self) -> Iterator[tuple[tuple[int, int], int, int, str]]:
        """(part, entry, exit, audit) of the cheapest chain, the last part first."""
        ends = [self.best[s] for s in FINAL if self.best[s] is not None]
        cheap = min(cost for cost, _ in ends)
        link = None
        for cost, end in ends:
            if cost == cheap and (link is None or self._strings(end, link)[0] < self._strings(end, link)[1]):
                link = end
        while link is not None:
            yield link[1:]
            link = link[0]


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, pid, seq, entry, exit) from the parts of split conversations, sorted."""
    chain, conv, any_ = None, None, False

    def out(chain: _Chain, conv) -> pa.RecordBatch:
        rows = [(p, s, e, x) for (p, s), e, x, _ in chain.ways()]
        columns = [pa.array([conv] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(4))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "pid", "seq", "entry", "exit"])

    for batch in batches:
        for c, p, s, costs, audits in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "pid", "seq", "costs", "audits"))):
            if not any_ or c != conv:
                if any_:
                    yield out(chain, conv)
                chain, conv, any_ = _Chain(), c, True
            chain.add((p, s), costs, audits)
    if any_:
        yield out(chain, conv)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their way chosen: the one cost and audit, and the repaired rows."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            way = 4 * r.pop("entry") + r.pop("exit")
            r["costs"], r["audits"] = [r["costs"][way]], [r["audits"][way]]
            done = applied(list(zip(r["roles"], r["texts"])), r["audits"][0], way // 4)
            r |= {"messages": len(done), "repaired": "\n".join(done), "roles": None, "texts": None}
        yield pa.RecordBatch.from_pylist(rows, schema=PART_ARROW)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations from their edited parts, sorted; texts go through the hash part by part."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    now = None

    def closed(r: dict) -> pa.RecordBatch:
        gaps = r["last_turn"] - r["first_turn"] + 1 - r["turns"] if r["turns"] else 0
        values = [r["conv_id"], gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], "".join(r["audit"]), r["hash"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield closed(now)
                now = {"conv_id": r["conv_id"], "last_role": None, "first_turn": None, "last_turn": None, "audit": [], "hash": hashlib.sha256(), "messages": 0}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
            for c in ("blank", "duplicate", "truncated", "illegal"):
                now[c] += r[c]
            if r["first_role"] is not None:
                now["illegal"] += now["last_role"] is not None and not _legal(now["last_role"], r["first_role"])
                now["last_role"] = r["last_role"]
            if r["turns"]:
                now["turns"] += r["turns"] - (now["last_turn"] == r["first_turn"])
                now["first_turn"] = r["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = r["last_turn"]
            now["cost"] += r["costs"][0]
            now["audit"].append(r["audits"][0])
            if r["messages"]:
                now["hash"].update(("\n" if now["messages"] else "").encode() + r["repaired"].encode())
                now["messages"] += r["messages"]
    if now is not None:
        yield closed(now)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of ``conv_id:turn`` over 20.

    0 leaves no copy (the conversation stays known), 1 empties the text, 2 takes its ``.!?``, 3 doubles the row,
    4 makes its role user. A null role or text, and a null in the hashed string, is one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), way.alias("way"))
    gone = F.col("way") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, F.lit(" ")).when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(gone, F.lit(" ")).when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("way") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired texts of conversations (conv_id, turn, role, text, copies).

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    texts: conv_id, pid, seq, messages, repaired; a conversation's parts by (pid, seq), each the ``role:text`` of
    its messages joined by newlines.

    Rows are taken by turn, null turns first; those of one turn by role and text, copies beside each other. A
    null role or text is one space; a null conv_id is a conversation of its own. Rows of no copies only make
    their conversation known: zeros, an empty audit and the hash of an empty string. An empty table gives no
    reports. Other columns are left out.
    """
    spark = rows.sparkSession
    small_batches(spark)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    equal = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")).agg(F.sum("copies").alias("copies"))
    equal = staged(equal.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "turns")
    order = ["conv_id", "turn", "role", "opening", "key", "row"]
    # texts that stand at more than one turn: all turns but the first are marked by a row before theirs
    slim = equal.where("copies > 0").select("conv_id", "turn", "role", F.left("text", F.lit(100)).alias("opening"), "key", F.xxhash64("conv_id", "key").alias("k"))
    firsts = slim.groupBy("k", "conv_id", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = staged(firsts.select("k", F.col("conv_id").alias("c"), F.col("key").alias("same"), F.col("first.turn").alias("first"), "n"), "repeated-texts")
    later = spread_join(slim, firsts, crowded(firsts, "k"), "k", "turn").where("conv_id <=> c and key = same and turn is not null and (first is null or turn > first)")
    marks = later.select("conv_id", "turn", "role", "opening", "key", F.lit(0).alias("row"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"))
    both = equal.select("conv_id", "turn", "role", F.left("text", F.lit(100)).alias("opening"), "key", F.lit(1).alias("row"), "text", "copies").unionByName(marks)
    parts = staged(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parts, PART), "conversation-parts")
    whole = parts.where("whole")
    split = parts.where("not whole")
    ways = split.select("conv_id", "pid", "seq", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq").mapInArrow(_chosen, "conv_id long, pid int, seq int, entry int, exit int")
    edited = staged(split.join(ways.drop("conv_id"), ["pid", "seq"]).select(*split.columns, "entry", "exit").mapInArrow(_edited, PART), "edited-parts")
    told = edited.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "seq").mapInArrow(_told, REPORT)
    at_once = whole.select(
        "conv_id",
        F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(F.lit(0)).cast("long").alias("gaps"),
        *["blank", "duplicate", "truncated", "illegal"],
        F.get("costs", F.lit(0)).alias("cost"),
        F.get("audits", F.lit(0)).alias("audit"),
        F.sha2("repaired", 256).alias("repaired_sha256"),
    )
    texts = [p.select("conv_id", "pid", "seq", "messages", "repaired") for p in (whole, edited)]
    return at_once.unionByName(told), texts[0].unionByName(texts[1])


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))[0]
