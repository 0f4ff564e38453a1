"""Operator 12: byte-level BPE encoding and decoding by tree reduction.

A piece (one match of the pattern) is halved down to a few bytes, the parts are merged by rank, and
neighbours are joined going up: the bytes of the last tokens of the left and the first of the right part
are encoded anew, in windows that double until the tokens outside cannot change. That is known by this: a row
of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of theirs. (The first
merge over a border of two tokens, in the row, would be made in the pair alone too: what ran before it inside
the two is the same.) So a window is wide enough once it forms such pairs with the tokens on both sides.

Joining is associative, so texts may be cut anywhere between matches: texts longer than a leaf are dealt over the
cluster in leaves, cut where a match surely ends, and their parts are concatenated up a tree of
bounded groups. Other texts stay in their row. Decoding concatenates halves of a row's ids likewise.

Ids travel as a binary of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import heapq
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, table

LEAF_BYTES = 32
REMEMBERED = 1 << 18  # pieces whose ids a worker remembers, and as many that it met before those
NONE = 1 << 62  # more than any rank
LEAF_CHARS = 1 << 16
FAN_IN = 16
#: A match never goes on from these into what follows: a letter, a digit or another sign before white space, a letter before a non-letter, a digit before a non-digit.
ENDS = regex.compile(r"\S(?=\s)|\p{L}(?=\P{L})|\p{N}(?=\P{N})")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a .tiktoken file: lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Tokenizer:
    """Encodes and decodes with given ranks; ``pattern`` cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        ids_of = self.ids_of

        class Remembered(dict):
            older: dict = {}

            def __missing__(self, piece: str) -> bytes:
                if (found := self.older.get(piece)) is None:
                    ids = ids_of(piece.encode())
                    found = pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    if len(self) >= REMEMBERED:
                        self.older = self.copy()
                        self.clear()
                    self[piece] = found
                return found

        self.remembered = Remembered()

    def __reduce__(self):
        return Tokenizer, (self.ranks, self.pattern)

    def merged(self, data: bytes) -> list[int]:
        """Ids of bytes by merging the neighbours of least rank first, the leftmost of equal ones."""
        if len(data) > 2 * LEAF_BYTES:
            return self._merged_long(data)
        ranks = self.ranks
        rank = ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != NONE:
            i = pairs.index(least)
            parts[i] = whole = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(whole + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + whole, NONE)
        return [ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """``merged`` with a queue of pairs, for windows that grew."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        rank = dict((i, r) for r, i in queue)  # of the pair that starts at i, as it stands now
        alive = [True] * n
        while queue:
            r, i = heapq.heappop(queue)
            if rank.get(i) != r:
                continue
            gone = end[i]
            end[i], alive[gone] = end[gone], False
            rank.pop(gone, None)
            if end[i] < n:
                before[end[i]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = end[left]
                    new = ranks.get(data[left : end[right]]) if right < n else None
                    if new is None:
                        rank.pop(left, None)
                    else:
                        rank[left] = new
                        heapq.heappush(queue, (new, left))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings side by side."""
        width = 1
        while left and right:
            window = self.merged(b"".join(map(self.token.__getitem__, [*left[-width:], *right[:width]])))
            firm_left = len(left) <= width or self.stable(left[-width - 1], window[0])
            firm_right = len(right) <= width or self.stable(window[-1], right[width])
            if firm_left and firm_right:
                return [*left[:-width], *window, *right[width:]]
            width *= 2
        return left or right

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.reduced(data[:half]), self.reduced(data[half:]))

    def ids_of(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        return self.reduced(piece) if whole is None else [whole]

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.remembered.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        """Bytes of ids: halves are decoded apart and concatenated, down to LEAF_CHARS ids."""
        if not ids:
            return b""
        if len(ids) > 4 * LEAF_CHARS:
            half = len(ids) // 8 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def leaves(text: str, size: int) -> list[str]:
    """Parts of a text that are encoded apart: cut at the first sure end of a match after ``size`` characters each."""
    found, start = [], 0
    while len(text) - start > size:
        cut = ENDS.search(text, start + size - 1)
        if cut is None:
            break
        found.append(text[start : cut.end()])
        start = cut.end()
    return [*found, text[start:]]


def _dealt(parts: DataFrame, work) -> DataFrame:
    """(row, ids): work over the leaves (row, at, part) of each row, dealt by row and place, then concatenated
    in order in groups of FAN_IN, level by level, so that no step holds more than that of a row but the last."""
    nodes = staged(parts.repartition("row", "at").select("row", "at", work("part").alias("out")), "bpe-leaves")
    top = nodes.agg(F.max("at")).first()[0] or 0
    while True:
        grouped = nodes.groupBy("row", F.expr(f"at div {FAN_IN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "out"))).alias("parts"))
        nodes = grouped.select("row", F.col("up").alias("at"), F.expr("aggregate(parts.out, cast('' as binary), (all, one) -> concat(all, one))").alias("out"))
        top //= FAN_IN
        if not top:
            return nodes.select("row", "out")
        nodes = staged(nodes, "bpe-level")


def _in_struct(df: DataFrame, col: str) -> DataFrame:
    """df's columns in one struct, and the column to work on: no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"), F.col(f"`{col}`").alias("part"))


def _unpacked(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    return df.select(*[F.col(f"all.`{c}`").alias(c) for c in columns if c != out], F.col("out").alias(out))


def encode(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", out_col: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs plus ``ids``, the whole text's ids as little-endian 32-bit integers.

    Null and empty texts have no ids (an empty binary). Rows are encoded one by one, so copies and repeated ids agree;
    an empty table gives no rows. A column that is named as the result is replaced. Texts longer than
    ``leaf_chars`` are dealt in leaves; a match that is longer stays in one leaf.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary
    work = F.pandas_udf(lambda s: pd.Series([shared.value.encode(t) for t in s], dtype=object), "binary")
    cut = F.pandas_udf(lambda s: pd.Series([leaves(t, leaf_chars) for t in s], dtype=object), "array<string>")
    rows = _in_struct(docs, text_col)
    short = F.coalesce(F.length("part"), F.lit(0)) <= leaf_chars
    near = rows.where(short).withColumn("out", work("part"))
    far = staged(rows.where(~short).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    if not far.isEmpty():
        parts = far.select("row", F.posexplode(cut("part")).alias("at", "part")).withColumn("at", F.col("at").cast("long"))
        near = near.unionByName(far.join(_dealt(parts, work), "row").drop("row"))
    return _unpacked(near, docs.columns, out_col)


def decode(tokens: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens plus ``decoded``, the bytes of the ids; null ids give an empty binary. An id without a token raises.

    Ids of a row are one value, so a row is decoded where it lies.
    """
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer)
    work = F.pandas_udf(lambda s: pd.Series([shared.value.decode(t) for t in s], dtype=object), "binary")
    return _unpacked(_in_struct(tokens, ids_col).withColumn("out", work("part")), tokens.columns, out_col)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = Tokenizer(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer).select("doc_id", "ids")
    both = decode(ids, tokenizer)
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
