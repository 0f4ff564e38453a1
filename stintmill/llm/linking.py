"""Candidate links from shared signature keys, and distributed union-find.

Used by the near-duplicate operators. Ids are 64-bit integers. Each member carries keys and a sketch of
32 bytes that agree with the probability of two members' similarity. Members of a key are first compared
with one leader, the member whose keys are shared most widely, which is linear in the members. Where a key
then still holds members of more than one component, the members other than its leader are compared
with each other in blocks of bounded size, each block pair in one task: by their sketches, and where
these come near, by the exact test. So no pair that shares a key and is not joined by other links is
left open. Only a spanning forest of a block's links is handed on.
Joins on a key deal the rows of crowded keys by a salt too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shielded, staged

WORD_BITS = 15  # Spark's bitmaps hold 2^15 bits
BLOCK = 1000  # members of a key that are compared with as many others in one step of a task
FAMILY = 256  # members of one leader beyond which their comparison is dealt by a salt too
CROWD = 2000  # rows of a key beyond which a join deals them by a salt too
SALTS = 64
LANES = 32  # bytes of a sketch, in four 64-bit integers
SKETCH = [f"s{k}" for k in range(LANES // 8)]
PAIRS = 1 << 18  # pairs whose sketches are compared at once
MANY = 8  # near pairs a member beyond which nearest ones are tested first
WIDTH = 2048  # distinct hashes that a comparison of blocks holds as columns at once


def bits_for(n: int) -> int:
    """Bits of a bitmap of n values: 64 a value, within 2^16 and 2^26."""
    return min(26, max(16, (64 * n).bit_length()))


def bitmap(values: DataFrame, col: str, bits: int | None = None) -> tuple[DataFrame, int]:
    """A bitmap of hashed values and its bits: 8 MB at most however many values there are.

    Without bits they are chosen by the count of values, which should be staged then.
    """
    bits = bits_for(values.count()) if bits is None else bits
    slot = F.pmod(F.col(col), F.lit(1 << bits))
    made = values.groupBy(F.shiftright(slot, WORD_BITS).alias("_bucket")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << WORD_BITS) - 1)).alias("_b"))
    words = f"transform(sequence(0, {(1 << WORD_BITS) // 32 - 1}), i -> cast(conv(hex(substring(_b, 4 * i + 1, 4)), 16, 10) as bigint))"
    return made.select("_bucket", F.expr(f"transform({words}, w -> cast(w - if(w >= 2147483648, 4294967296, 0) as int))").alias("_bits")), bits


def _marked(rows: DataFrame, col: str, marks: tuple[DataFrame, int], how: str = "left") -> DataFrame:
    """rows with _bit: 1 where the bitmap may hold the value of col."""
    made, bits = marks
    slot = F.pmod(F.col(col), F.lit(1 << bits))
    held = rows.withColumn("_slot", slot).withColumn("_bucket", F.shiftright("_slot", WORD_BITS)).join(F.broadcast(made), "_bucket", how)
    # the bytes of a bitmap are in order, so a word's first byte is its highest
    at = F.col("_slot").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    byte = F.shiftright(at, 3).bitwiseAND(3)
    bit = F.getbit(F.get("_bits", F.shiftright(at, 5)), (3 - byte) * 8 + at.bitwiseAND(7))
    return held.withColumn("_bit", F.coalesce(bit, F.lit(0))).drop("_slot", "_bucket", "_bits")


def maybe_in(rows: DataFrame, col: str, marks: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose value may be among those of the bitmap: none of those is lost, few others stay.

    The bitmap's size is bounded, so it is broadcast; an exact join of what is left follows.
    """
    return _marked(rows, col, marks, "inner").where("_bit = 1").drop("_bit")


def surely_out(rows: DataFrame, col: str, marks: tuple[DataFrame, int]) -> DataFrame:
    """The rows that ``maybe_in`` leaves out; their values are surely not among those of the bitmap."""
    return _marked(rows, col, marks).where("_bit = 0").drop("_bit")


def without_ids(rows: DataFrame, gone: DataFrame, col: str) -> DataFrame:
    """Rows of a wide table whose integer id is not in gone (one column, named as col).

    Only rows that may be among them are shuffled; rows with a null id stay. Other columns may have any name.
    """
    gone = staged(gone.select(F.col(col).cast("long").alias("gone")).distinct(), "gone")
    marks = bitmap(gone.select(F.xxhash64("gone").alias("_k")), "_k")
    hidden, back = shielded(rows, gone_id=col)
    held = hidden.withColumn("_k", F.coalesce(F.xxhash64(F.col("gone_id").cast("long")), F.lit(0).cast("long")))
    hit = maybe_in(held, "_k", marks).join(gone, F.col("gone_id") == F.col("gone"), "left_anti")
    return back(surely_out(held, "_k", marks).unionByName(hit))


def crowded(sizes: DataFrame, key: str, crowd: int = CROWD) -> tuple[DataFrame, int] | None:
    """A bitmap, and its bits, of the keys that sizes (staged; key, n) says have more than ``crowd`` rows; None without any."""
    many = staged(sizes.where(F.col("n") > crowd).select(F.xxhash64(key).alias("_c")), "crowded")
    if not (n := many.count()):
        return None
    made, bits = bitmap(many, "_c", bits_for(n))
    return staged(made, "crowded-marks"), bits


def spread_join(
    rows: DataFrame, by_key: DataFrame, marks: tuple[DataFrame, int] | None, key: str, deal_by: str, how: str = "inner", hint: str | None = None
) -> DataFrame:
    """The join (inner or left) of rows with by_key, a table of one row a key.

    The rows of keys that ``crowded`` marks are dealt to ``SALTS`` parts by their column deal_by, so
    that no task gets a whole crowded key.
    """
    hinted = lambda t: t.hint(hint) if hint else t
    if marks is None:
        return rows.join(hinted(by_key), key, how)
    one, every = F.lit(0), F.sequence(F.lit(0), F.lit(SALTS - 1))
    rows, by_key = (_marked(t.withColumn("_c", F.xxhash64(key)), "_c", marks).drop("_c") for t in (rows, by_key))
    dealt = rows.withColumn("_salt", F.when(F.col("_bit") == 1, F.pmod(F.xxhash64(deal_by), F.lit(SALTS)).cast("int")).otherwise(one)).drop("_bit")
    copies = by_key.withColumn("_salt", F.explode(F.when(F.col("_bit") == 1, every).otherwise(F.array(one)))).drop("_bit")
    return dealt.join(hinted(copies), [key, "_salt"], how).drop("_salt")


def packed(values: np.ndarray) -> np.ndarray:
    """Sketches (rows of four 64-bit integers) from rows of LANES integers, of which the low bytes count."""
    return np.ascontiguousarray(values.astype(np.uint8)).view(np.int64)


def least_agreeing(threshold: float) -> int:
    """Sketches of two members that reach the threshold agree in fewer bytes in less than 1 of 10,000 cases."""
    return max(1, math.floor(LANES * threshold - 4.25 * math.sqrt(LANES * threshold * (1 - threshold))))


def agreeing(a: list[str], b: list[str]) -> F.Column:
    """In how many bytes two sketches agree."""
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        z = F.col(x).bitwiseXOR(F.col(y))
        for step in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(LANES) - differ


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a ^ b
    for step in (4, 2, 1):
        z |= z >> np.uint64(step)
    return LANES - np.bitwise_count(z & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.int64)


GROUP = ["key", "i", "j"]


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups of a sorted partition, and where the groups start; a group may span batches."""
    held: list[pd.DataFrame] = []
    last = None

    def cut(pdf: pd.DataFrame) -> np.ndarray:
        group = pdf[GROUP].to_numpy()
        return np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))

    for pdf in batches:
        if not len(pdf):
            continue
        starts = cut(pdf)
        if last is not None and (len(starts) > 1 or tuple(pdf[GROUP].iloc[0]) != last):
            whole = pd.concat([*held, pdf.iloc[: starts[-1]]], ignore_index=True)
            held = [pdf.iloc[starts[-1] :]]
            yield whole, cut(whole)
        elif last is None and len(starts) > 1:
            yield pdf.iloc[: starts[-1]].reset_index(drop=True), starts[:-1]
            held = [pdf.iloc[starts[-1] :]]
        else:
            held.append(pdf)
        last = tuple(pdf[GROUP].iloc[-1])
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, cut(whole)


def _near_members(least: int):
    """The members of groups (key, i, j) whose sketch comes near that of another component's member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(batches):
            sketch = rows[SKETCH].to_numpy().view(np.uint64)
            component, side, other = rows["component"].to_numpy(), rows["side"].to_numpy(), (rows["i"] != rows["j"]).to_numpy()
            near = np.zeros(len(rows), bool)
            until = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
            partners = until - np.arange(len(rows)) - 1
            upto = np.append(0, np.cumsum(partners))
            at = 0
            while at < len(rows):
                stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
                u = np.repeat(np.arange(at, stop), partners[at:stop])
                v = np.arange(upto[stop] - upto[at]) - np.repeat(upto[at:stop] - upto[at], partners[at:stop]) + u + 1
                open_ = (component[u] != component[v]) & (~other[u] | (side[u] != side[v]))
                u, v = u[open_], v[open_]
                close = _agree(sketch[u], sketch[v]) >= least
                near[u[close]] = near[v[close]] = True
                at = stop
            yield rows.loc[near, [*GROUP, "side", "id", "component"]]

    return run


def _spanning(sets: list[np.ndarray], side: np.ndarray, component: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join what alike members of two blocks (or of one) connect beyond their components."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, (low, low + WIDTH))
        held = np.zeros((n, int(column[b - 1]) - low + 1), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        both += held @ held.T
    alike = both >= threshold * (size[:, None] + size[None, :] - both).astype(float)
    alike &= size[:, None] > 0
    if side.any() and not side.all():
        alike &= side[:, None] != side[None, :]
    near = alike | (component[:, None] == component[None, :])
    links, left = [], np.ones(n, bool)
    while left.any():
        first = int(np.argmax(left))
        left[first], todo = False, [first]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(near[u] & left)
            left[new] = False
            todo.extend(new.tolist())
            links.extend((u, v) for v in new.tolist() if component[u] != component[v])
    return links


def _block_links(decode: Callable[[list], list[np.ndarray]], threshold: float):
    """Links inside the groups (key, i, j) of a sorted partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(batches):
            component, side, ids, h = (rows[c].to_numpy() for c in ("component", "side", "id", "h"))
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(rows)), strict=True):
                if (component[a:b] != component[a]).any():
                    out.extend((ids[a + u], ids[a + v]) for u, v in _spanning(decode(h[a:b].tolist()), side[a:b], component[a:b], threshold))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _tested(pairs: DataFrame, sets_of, alike) -> DataFrame:
    """The alike ones of staged pairs (a, b)."""
    sizes = staged(pairs.groupBy("a").agg(F.count("*").alias("n")), "leaders")
    asked = staged(pairs.select("b").union(sizes.select("a")).toDF("id").distinct(), "asked")
    sets = staged(sets_of(asked), "sets")
    of_leads = sets.toDF("a", "x").join(sizes.select("a"), "a", "left_semi")
    return spread_join(pairs.join(sets.toDF("b", "y"), "b"), of_leads, crowded(sizes, "a", FAMILY), "a", "b").where(alike("x", "y")).select("a", "b")


def _screened(pairs: DataFrame, marks: DataFrame, may) -> DataFrame:
    """The staged pairs (a, b, agree) that may be alike by the marks (id, columns) of both."""
    columns = [c for c in marks.columns if c != "id"]
    of = lambda side: marks.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    sizes = staged(pairs.groupBy("a").agg(F.count("*").alias("n")), "screened-sizes")
    both = spread_join(pairs.join(of("b"), "b"), of("a"), crowded(sizes, "a", FAMILY), "a", "b")
    return both.where(may("a_", "b_")).select("a", "b", "agree")


def _open_pairs(dealt: DataFrame, links: DataFrame, sets_of, alike, threshold: float, screen) -> DataFrame:
    """Links inside the groups (key, i, j) of dealt: of pairs of near sketches in different components that the screen lets pass.
    Where these are many a member, each member is tested with its nearest first, and then the pairs that this leaves open."""
    other = dealt.select(*GROUP, *[F.col(c).alias(f"o{c}") for c in ("id", "component", "side", *SKETCH)])
    agree = agreeing(SKETCH, [f"o{c}" for c in SKETCH])
    met = dealt.join(other, GROUP).where("id < oid and component <> ocomponent and (i = j or side <> oside)").withColumn("agree", agree)
    met = met.where(F.col("agree") >= least_agreeing(threshold)).select(F.col("id").alias("a"), F.col("oid").alias("b"), "agree")
    met = staged(met.distinct(), "near-pairs")
    if screen:
        marks_of, may = screen
        sets = staged(sets_of(staged(met.select("a").union(met.select("b")).toDF("id").distinct(), "open-members")), "open-sets")
        sets_of = lambda asked: sets.join(asked, "id", "left_semi")
        met = staged(_screened(met, staged(marks_of(sets), "open-marks"), may), "screened-pairs")
    pairs, members = met.agg(F.count("*"), F.count_distinct("a")).first()
    if pairs <= MANY * members:
        return staged(_tested(met.select("a", "b"), sets_of, alike), "open-links")
    first = staged(met.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("most")).select("a", F.col("most.b").alias("b")), "first-pairs")
    found = staged(_tested(first, sets_of, alike), "open-links")
    now = components(links.unionByName(found))
    rest = met.select("a", "b").join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        rest = rest.join(now.toDF(side, f"c{side}"), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    rest = staged(rest.where("ca <> cb").select("a", "b"), "open-pairs")
    return staged(found.unionByName(_tested(rest, sets_of, alike)), "open-links")


def _open_links(tried: DataFrame, links: DataFrame, sets_of, alike, decode, threshold: float, screen) -> DataFrame | None:
    """Links that leaders left open, from tried (key, id, sketch): each member but the leader of a key."""
    placed = tried.join(components(links), "id", "left").select("key", "id", *SKETCH, F.coalesce("component", "id").alias("component"))
    placed = staged(placed, "placed-keys")
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("one"), F.max("component").alias("two"))
    mixed = staged(mixed.where("one < two").select("key", "n"), "open-keys")
    if mixed.isEmpty():
        return None
    here = spread_join(placed, mixed, crowded(mixed, "key"), "key", "id").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    here = here.withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = here.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", *SKETCH, (F.col("own") > F.col("other")).cast("int").alias("side"))
    if decode is None:
        return _open_pairs(dealt, links, sets_of, alike, threshold, screen)
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    near = dealt.mapInPandas(_near_members(least_agreeing(threshold)), "key long, i int, j int, side int, id long, component long")
    near = staged(near, "near-members")
    asked = staged(near.select("id").distinct(), "asked")
    exact = near.join(sets_of(asked), "id").select(*GROUP, "side", "id", "component", "h").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return staged(exact.mapInPandas(_block_links(decode, threshold), "a long, b long").distinct(), "open-links")


def leader_links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], alike, decode, threshold: float = 0.8, screen=None) -> DataFrame:
    """Verified links (a, b) among members that share a key; their components are those of all alike pairs with a shared key.

    members: staged (id long, keys array<long>, sketch in SKETCH), an id once or more with equal keys.
    sets_of takes distinct ids (id) and returns (id, h) once each, h being what ``alike(x, y)``, a
    Column of the exact test of two, and ``decode``, from a list of h to arrays of distinct integers, read.
    Without decode all of it is DataFrame operations: blocks are joined with each other, and a screen, if
    given, tells pairs that need no exact test: a function from what sets_of returns to (id, columns), and one from two
    prefixes of these columns to a condition that holds for every alike pair.
    """
    rows = members.select(F.explode(F.array_distinct("keys")).alias("key"), "id", *SKETCH)
    shared = rows.groupBy("key").agg(F.min("id").alias("one"), F.max("id").alias("two"), F.count("*").alias("n")).where("one < two")
    shared = staged(shared.select("key", "n"), "shared-keys")
    held = maybe_in(rows, "key", bitmap(shared, "key")).groupBy("key", "id").agg(*[F.first(c).alias(c) for c in SKETCH])
    near = staged(spread_join(held, shared, crowded(shared, "key"), "key", "id"), "near-keys")
    spread = near.groupBy("id").agg(F.sum("n").alias("spread"))
    leads = near.join(spread, "id").groupBy("key").agg(F.max(F.struct("spread", "id", *SKETCH)).alias("lead"), F.count("*").alias("n"))
    led = [f"l{c}" for c in SKETCH]
    leads = staged(leads.select("key", "n", F.col("lead.id").alias("lead"), *[F.col(f"lead.{c}").alias(n) for c, n in zip(SKETCH, led, strict=True)]), "leads")
    tried = spread_join(near.drop("n"), leads.drop("n"), crowded(leads, "key"), "key", "id").where("id <> lead")
    tried = tried.withColumn("close", agreeing(SKETCH, led) >= least_agreeing(threshold))
    tried = staged(tried.select("key", "id", "lead", "close", *SKETCH), "tried")
    pairs = staged(tried.where("close").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    good = _tested(pairs, sets_of, alike)
    good = staged(good, "leader-links")
    more = _open_links(tried, good, sets_of, alike, decode, threshold, screen)
    return good if more is None else staged(good.unionByName(more), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b); a component is named by its least id.

    Least labels travel along links and every label then jumps to its own label, so stars end in
    two rounds and chains in about as many rounds as their length has binary digits. Labels that
    are roots need no jump, so the many that point to one root are not dealt by it.
    """
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    stars = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    stars = staged(stars.select(F.col("a").alias("id"), "n", F.least("a", "b").alias("component")), "labels")
    labels, bits = stars.select("id", "component"), bits_for(stars.count())
    hubs = crowded(stars.select(F.col("id").alias("b"), "n"), "b")
    while True:
        around = spread_join(edges, labels.withColumnRenamed("id", "b"), hubs, "b", "a").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(around, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        inner = labels.where("id <> component")
        marks = bitmap(inner.select(F.xxhash64("id").alias("_k")), "_k", bits)
        moved = _marked(moved.withColumn("_k", F.xxhash64("to")), "_k", marks).drop("_k")
        moved = moved.withColumn("_salt", F.when(F.col("_bit") == 1, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
        jump = inner.select(F.col("id").alias("to"), F.col("component").alias("next"), F.lit(-1).alias("_salt"))
        jumped = moved.join(jump, ["to", "_salt"], "left").select("id", F.least("to", F.coalesce("next", "to")).alias("component"), "was")
        jumped = staged(jumped, "labels")
        labels = jumped.select("id", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
