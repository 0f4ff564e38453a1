"""Operator 1: benchmark decontamination by template canonicalisation.

Texts become template tokens: lower-case words, with numbers, names (capitalised words inside a
sentence) and units (a unit word behind a number) replaced by typed placeholders, runs of one
placeholder being one. Windows of eight template tokens are hashed and hash-joined with the
benchmark's; hits of one document and item on one alignment must put the same document value into
the same item slot everywhere. Equal values are a copy, others a re-parameterised question. A window whose own values are all the item's is copied whatever
the rest of its alignment holds, and a run of names or numbers at a window's edge, which may go on
outside, says nothing about consistency. Items without a usable window are searched by plain words.
Only pairs that share one of the item's rarest windows are aligned: as many are taken as a pair that
reaches the least share cannot all miss, so a window that many items and documents share makes no
product of them and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import P, chunks, mixed, span_hashes
from .common import small_batches, staged, table
from .linking import WORD_BITS, crowded, spread_join, without_ids

WINDOW = 8
SHORTEST = 4  # items of fewer template tokens are searched for by plain words
LEAST_BITS, MOST_BITS = 24, 29  # the documents' windows are screened by 2^24 bits or 512 a benchmark window, 64 MB at most
BROADCAST_WINDOWS = 200_000  # benchmark windows are broadcast up to this many (some tens of MB), and joined by a shuffle beyond
# Words taken for units when they follow a number.
UNITS = (
    "mm cm m km kms in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz "
    "ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week "
    "weeks month months year years percent pct usd eur gbp dollar dollars euro euros cent cents mph kmh kph degree degrees celsius "
    "fahrenheit k w kw kwh v volt volts watt watts hz khz mhz ghz kb mb gb tb"
).split()
LITERAL, NUMBER, NAME, UNIT = range(4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[0, 10, 13, 33, 46, 58, 63]] = True
_PLACE = mixed(np.arange(1, 4, dtype=np.uint64) * P)


def _unit_hashes() -> np.ndarray:
    buf = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    cuts = np.flatnonzero(buf == 32)
    return np.sort(span_hashes(buf, np.append(0, cuts + 1), np.append(cuts, len(buf))))


_UNITS = _unit_hashes()


class Templates:
    """Template tokens of a batch of texts: id, kind, document, and the bytes they stand for."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer("\0".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        buf = _LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # capital letters of the Latin-1 range
        caps = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] <= 0x9E) & (raw[lead + 1] != 0x97)]
        buf[caps + 1] += 32
        kinds = _CLASS[raw]
        cuts = np.append(0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1) if len(raw) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(raw))
        word = kinds[cuts] > 0
        starts, ends = cuts[word], ends[word]
        doc = np.cumsum(raw == 0)[starts] if len(raw) else starts
        ids = span_hashes(buf, starts, ends)
        self.plain, self.plain_doc = ids.copy(), doc
        n = len(starts)
        kind = np.zeros(n, np.uint8)
        same = np.append(False, doc[1:] == doc[:-1])[:n]
        number = kinds[starts] == 2
        kind[number] = NUMBER
        behind = np.append(False, number[:-1])[:n] & same & ~number
        at = np.searchsorted(_UNITS, ids[behind]).clip(max=len(_UNITS) - 1)
        kind[np.flatnonzero(behind)[_UNITS[at] == ids[behind]]] = UNIT
        upper = (raw[starts] >= 65) & (raw[starts] <= 90)
        upper[np.isin(starts, caps)] = True
        stops = np.cumsum(_ENDS[raw])[starts] if len(raw) else starts
        inside = same & np.append(False, stops[1:] == stops[:-1])[:n]
        kind[(kind == LITERAL) & upper & inside] = NAME
        slot = kind != LITERAL
        ids[slot] = _PLACE[kind[slot] - 1]
        joined = same & slot & np.append(False, kind[1:] == kind[:-1])[:n]
        first = np.flatnonzero(~joined)
        self.raw = raw
        self.ids, self.kind, self.doc, self.start = ids[first], kind[first], doc[first], starts[first]
        self.end = ends[np.append(first[1:] - 1, n - 1)] if n else ends

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of every window of so many tokens inside one text; of plain words if length < 0."""
        ids, doc = (self.plain, self.plain_doc) if length < 0 else (self.ids, self.doc)
        size = abs(length)
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        key = np.full(n, length, np.int64).view(np.uint64)
        for j in range(size):
            key = key * P + ids[j : n + j]
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        return at, mixed(key[at])

    def slots(self, at: int, length: int) -> list[str]:
        """Values of a window's placeholders; plain words have none."""
        return [
            f"{self.kind[k]}:{' '.join(bytes(self.raw[self.start[k] : self.end[k]]).decode('utf-8', 'replace').lower().split())}"
            for k in range(at, at + length)
            if self.kind[k] != LITERAL
        ]

    def marks(self, at: int, length: int, first: int, last: int) -> list[str]:
        """Where each slot of a window stands: ^ and $ at the text's own edges, < and > at the window's, else =."""
        end = at + length - 1
        place = {at: "^" if at == first else "<", end: "$" if end == last else ">"}
        return [place.get(k, "=") for k in range(at, at + length) if self.kind[k] != LITERAL]

    def first_of(self, length: int = 1) -> np.ndarray:
        """For each token (plain word if length < 0) the index of its text's first one."""
        doc = self.plain_doc if length < 0 else self.doc
        return np.searchsorted(doc, doc)


def _clean(texts: pd.Series) -> list[str]:
    return [t.replace("\0", " ") if t else "" for t in texts]


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = _clean(pdf["text"])
        for a, b in chunks(texts):
            t = Templates(texts[a:b])
            size, words = np.bincount(t.doc, minlength=b - a), np.bincount(t.plain_doc, minlength=b - a)
            first, found = t.first_of(), np.zeros(b - a, bool)
            out = []
            for length in range(SHORTEST, WINDOW + 1):
                for at, key in zip(*t.windows(length), strict=True):
                    d = t.doc[at]
                    n = size[d]
                    plain = int((t.kind[at : at + length] == LITERAL).sum())
                    if (length == WINDOW or n == length) and 2 * plain >= length:
                        marks = t.marks(at, length, first[at], first[at] + n - 1)
                        slots = [m + v for m, v in zip(marks, t.slots(at, length), strict=True)]
                        out.append((int(pdf["item_id"].iloc[a + d]), key.view(np.int64), int(at - first[at]), length, slots))
                        found[d] = True
            first = t.first_of(-1)
            for length in range(1, WINDOW + 1):
                for at, key in zip(*t.windows(-length), strict=True):
                    d = t.plain_doc[at]
                    if not found[d] and min(words[d], WINDOW) == length:
                        out.append((int(pdf["item_id"].iloc[a + d]), key.view(np.int64), int(at - first[at]), -length, []))
            yield pd.DataFrame(out, columns=["item_id", "key", "item_pos", "length", "item_slots"])


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Staged windows of the benchmark: (item_id, key, item_pos, length, item_slots).

    Windows with more placeholders than words say too little and are left out; items of four to
    seven template tokens are one window. Items of fewer, and those without a window that says
    enough, have windows of eight plain words (one window if they are shorter) with length < 0.
    """
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInPandas(_item_windows, "item_id long, key long, item_pos int, length int, item_slots array<string>"), "item-windows")


def _screen(items: DataFrame) -> np.ndarray:
    """Bits that tell which window hashes may be in the benchmark."""
    n = items.count()
    width = min(MOST_BITS, max(LEAST_BITS, (512 * n).bit_length()))
    top = F.shiftrightunsigned("key", 64 - width)
    rows = (
        items.groupBy(F.shiftright(top, WORD_BITS).alias("chunk"))
        .agg(F.bitmap_construct_agg(top.bitwiseAND((1 << WORD_BITS) - 1)).alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << width) >> 3, np.uint8)
    part = (1 << WORD_BITS) >> 3
    for r in rows:
        bits[r.chunk * part : (r.chunk + 1) * part] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def window_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, doc_pos, doc_slots) of the documents' windows that may be among the items'."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = spark.sparkContext.broadcast(_screen(items))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = bits.value
        shift = np.uint64(64 - (len(marks) * 8).bit_length() + 1)
        for pdf in batches:
            texts = _clean(pdf["text"])
            for a, b in chunks(texts):
                t = Templates(texts[a:b])
                out = []
                for length in lengths:
                    at, keys = t.windows(length)
                    first, doc = t.first_of(length), t.plain_doc if length < 0 else t.doc
                    slot = (keys >> shift).astype(np.int64)
                    hit = (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    for k, key in zip(at[hit], keys[hit], strict=True):
                        out.append((int(pdf["doc_id"].iloc[a + doc[k]]), key.view(np.int64), int(k - first[k]), t.slots(k, max(length, 0))))
                yield pd.DataFrame(out, columns=["doc_id", "key", "doc_pos", "doc_slots"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, "doc_id long, key long, doc_pos int, doc_slots array<string>")


def _by_key(hits: DataFrame, items: DataFrame, many: int) -> DataFrame:
    """Hits joined with a table of one row a key, broadcast where it holds few windows."""
    if many <= BROADCAST_WINDOWS:
        return hits.join(F.broadcast(items), "key")
    return spread_join(hits, items, crowded(staged(hits.groupBy("key").agg(F.count("*").alias("n")), "hit-keys"), "key"), "key", "doc_id")


def _probes(hits: DataFrame, items: DataFrame, least_share: float) -> DataFrame:
    """(key, items): the windows of each item that a document must share one of to reach ``least_share`` of them.

    Who holds t of an item's w windows holds one of any w - t + 1, so the t - 1 windows that the most pairs of
    items and documents hold need no join. Items of which documents hold fewer than t windows have none.
    """
    held = hits.groupBy("key").agg(F.count("*").alias("docs"))
    windows = items.select("item_id", "key").distinct()
    windows = windows.join(windows.groupBy("key").agg(F.count("*").alias("among")), "key").join(held, "key", "left")
    cost = F.coalesce(F.col("docs") * F.col("among"), F.lit(0))
    listed = windows.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(cost.alias("cost"), "key"))).alias("keys"))
    listed = listed.withColumn("t", F.greatest(F.lit(1), F.ceil(F.size("keys") * F.lit(least_share) - 1e-9).cast("int")))
    listed = listed.where("size(filter(keys, k -> k.cost > 0)) >= t")
    probes = listed.select("item_id", F.explode(F.expr("slice(keys, 1, size(keys) - t + 1)")).alias("k")).where("k.cost > 0")
    return probes.groupBy(F.col("k.key").alias("key")).agg(F.collect_list("item_id").alias("items"))


def candidates(hits: DataFrame, items: DataFrame, least_share: float) -> DataFrame:
    """(doc_id, item_id) once each: all pairs that can reach the share, and few others."""
    probes = staged(_probes(hits, items, least_share), "probes")
    met = _by_key(hits.select("doc_id", "key").distinct(), probes, items.count())
    return met.select("doc_id", F.explode("items").alias("item_id")).distinct()


def _met(hits: DataFrame, items: DataFrame, least_share: float) -> DataFrame:
    """Hits of candidate pairs with the item's windows of their key."""
    pairs = staged(candidates(hits, items, least_share), "candidates")
    of_item = items.groupBy("item_id").agg(F.collect_list(F.struct("key", "item_pos", "item_slots")).alias("windows"))
    if items.count() <= BROADCAST_WINDOWS:
        asked = pairs.join(F.broadcast(of_item), "item_id")
    else:
        asked = spread_join(pairs, of_item, crowded(staged(pairs.groupBy("item_id").agg(F.count("*").alias("n")), "item-sizes"), "item_id"), "item_id", "doc_id")
    return hits.join(asked.select("doc_id", "item_id", F.inline("windows")), ["doc_id", "key"])


def leaks(docs: DataFrame, benchmark: DataFrame, copied_share: float = 0.3, changed_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, windows, item_windows, share): items found in documents.

    A window whose slot values are all the item's own is copied; where a run at the item's first or
    last token goes on in the document, its part is compared. ``share`` is the part of an item's
    windows that are copied or found on alignments whose slots are consistent; ``kind`` is "copy"
    when copied windows suffice, else "reparameterised". A copy counts from ``copied_share`` on, a re-parameterised item from ``changed_share``. Whole texts
    are searched. Null and empty texts match nothing, null ids are left out, rows that share an
    id count as one document, and an item listed twice counts once.
    """
    items = item_windows(benchmark)
    hits = staged(window_hits(docs, items, id_col, text_col), "window-hits")
    total = items.groupBy("item_id").agg(F.count_distinct("key").alias("item_windows"))
    met = _met(hits, items, min(copied_share, changed_share)).withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    met = met.withColumn("slots", F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d")))
    own = """forall(slots, s -> substring(s.i, 2) = s.d or (left(s.i, 1) = '$' and startswith(s.d, concat(substring(s.i, 2), ' ')))
        or (left(s.i, 1) = '^' and endswith(s.d, concat(' ', substring(s.i, 4)))))"""
    met = met.withColumn("own", F.expr(own)).withColumn("slots", F.expr("filter(slots, s -> left(s.i, 1) = '=')"))
    pairs = F.array_distinct(F.flatten(F.collect_set("slots")))
    lined = met.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("own"), F.col("key"))).alias("copied"), pairs.alias("slots")
    )
    agreed = F.expr("size(slots) = size(array_distinct(transform(slots, s -> s.i)))")
    lined = lined.withColumn("keys", F.when(agreed, F.col("keys")).otherwise(F.col("copied")))
    found = lined.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).cast("long").alias("windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("copied")))).cast("long").alias("copied"),
    )
    judged = found.join(total, "item_id").withColumn("share", F.col("windows") / F.col("item_windows"))
    copied = F.col("copied") / F.col("item_windows")
    return judged.where((copied >= copied_share) | (F.col("share") >= changed_share)).select(
        "doc_id", "item_id", F.when(copied >= copied_share, "copy").otherwise("reparameterised").alias("kind"), "windows", "item_windows", "share"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold an item of the benchmark."""
    gone = leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(id_col))
    return without_ids(docs, gone, id_col)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
