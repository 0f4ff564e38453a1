"""Operator 2: near-duplicate documents by BagMinHash.

A document is a multiset of five-word shingles (lower case, white space collapsed). Every shingle
carries Poisson processes over its discretised weight: one of rate 1 on [0, 1), one on [1, 2), then
one of rate 2^l on [2^l, 2^(l+1)); a document of weight w uses the levels that begin under w and
takes a point only if its place on the weight axis lies under w. A point falls at a time and into
one of the components, a component keeps its earliest time, and a process stops once its next time
is later than all the components' times. Two documents agree in a component with the probability
of their weighted Jaccard similarity. Sixteen bands of four components give keys (similarity 0.8
shares one in all but 2 of 10,000 cases), and what shares a key is checked by the exact
weighted Jaccard similarity of the multisets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import P, Q, chunks, mixed, scaled, span_hashes
from .common import small_batches, staged, table
from .linking import LANES, SKETCH, bitmap, components, crowded, leader_links, maybe_in, packed, spread_join, without_ids

SHINGLE = 5
BANDS, ROWS = 16, 4


def least_shingles(threshold: float) -> int:
    """Multisets of fewer shingles only reach the threshold when they are equal."""
    return math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1 << 62


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def content_id(norm: str) -> int:
    """A 64-bit identity of a normalised text."""
    return int.from_bytes(hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shingles(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word shingle; a text of one to four words is one shingle."""
    buf = np.frombuffer("\n".join(norms).encode("utf-8", "surrogatepass"), np.uint8)
    breaks = np.flatnonzero((buf == 32) | (buf == 10))
    starts, ends = np.append(0, breaks + 1), np.append(breaks, len(buf))
    doc = np.append(0, np.cumsum(buf[breaks] == 10))
    full = ends > starts
    starts, ends, doc = starts[full], ends[full], doc[full]
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    last = np.searchsorted(doc, doc, "right") - 1
    at = np.arange(len(doc))
    begins = np.append(True, doc[1:] != doc[:-1])
    use = (at + SHINGLE - 1 <= last) | begins
    to = np.minimum(at + SHINGLE - 1, last)[use]
    return doc[use], span_hashes(buf, starts[use], ends[to])


def bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with weights, and each sorted token's occurrence number from 0."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(doc)))
    nth = np.arange(len(doc)) - np.repeat(first, weight)
    return doc[first], h[first], weight, nth


def bag_signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """The earliest time of each of m components, for each document."""
    # hierarchical levels over the weight axis: [0, 1), [1, 2), [2, 4), ...
    at, seeds, lows, rates, tops = [doc], [h], [np.zeros(len(h))], [np.ones(len(h))], [weight]
    low = 1
    while len(h) and (more := weight > low).any():
        at.append(doc[more])
        seeds.append(mixed(h[more] + scaled(low)))
        lows.append(np.full(more.sum(), float(low)))
        rates.append(np.full(more.sum(), float(low)))
        tops.append(weight[more])
        low *= 2
    doc, seed, low_, rate, top = map(np.concatenate, (at, seeds, lows, rates, tops))
    times = np.full(n_docs * m, np.inf)
    x, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        r = mixed(seed + scaled(2 * step))
        x = x - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        s = mixed(r ^ Q)
        component = ((s & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        place = low_ + np.floor((s >> np.uint64(32)).astype(float) * 2.0**-32 * rate)
        taken = place < top
        np.minimum.at(times, doc[taken] * m + component[taken], x[taken])
        latest = times.reshape(n_docs, m).max(axis=1)
        on = x < latest[doc]
        doc, seed, low_, rate, top, x = doc[on], seed[on], low_[on], rate[on], top[on], x[on]
    return times.reshape(n_docs, m)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    key = np.zeros((len(times), bands), np.uint64)
    for r in range(rows):
        key = mixed(key * P + bits[:, :, r])
    return mixed(key + np.arange(bands, dtype=np.uint64) * Q).view(np.int64)


def sketches(times: np.ndarray) -> np.ndarray:
    """A byte of each of the first LANES components (at least so many are needed), packed."""
    return packed(mixed(np.ascontiguousarray(times[:, :LANES]).view(np.uint64) * P))


def _sketch(bands: int, rows: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normal(t) for t in batch.column("text").to_pylist()]
            for a, b in chunks(norms):
                doc, h, weight, nth = bags(*shingles(norms[a:b]))
                size = np.bincount(doc, weight, b - a)
                fit = size[doc] >= least
                times = bag_signatures(doc[fit], h[fit], weight[fit], b - a, bands * rows)
                keys, sketch = band_keys(times, bands, rows), sketches(times)
                keyed = size >= least
                ends = np.append(0, np.cumsum(keyed * bands)).astype(np.int32)
                ids = pa.array([content_id(t) if t else None for t in norms[a:b]], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[keyed].ravel()))
                lanes = [pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(len(SKETCH))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], ids, lists, *lanes], ["doc_id", "id", "keys", *SKETCH])

    return run


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, h): shingles with their occurrence number, so plain Jaccard is weighted Jaccard."""
    for pdf in batches:
        norms = [normal(t) for t in pdf["text"]]
        for a, b in chunks(norms):
            doc, h, weight, nth = bags(*shingles(norms[a:b]))
            doc, h = np.repeat(doc, weight), np.repeat(h, weight)
            each = (mixed(h + nth.astype(np.uint64) * P) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            cuts = np.searchsorted(doc, np.arange(1, b - a))
            ids = [content_id(t) for t in norms[a:b]]
            keep = [k for k, want in enumerate(pdf["id"].iloc[a:b]) if ids[k] == want]
            parts = np.split(each, cuts)
            if keep:
                yield pd.DataFrame({"id": [ids[k] for k in keep], "h": pd.Series([parts[k] for k in keep], dtype=object)})


def group_documents(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) for every row of docs: texts in a chain of similar ones share a group.

    A group is named by its least doc_id. Copies (equal normalised texts) are one text. Null, empty
    and blank texts are never similar to anything and form groups of their own; texts of fewer
    than four shingles only match their copies. Rows with a null id are left out. Rows may repeat
    an id: they are grouped by their texts. Multisets are compared by 32-bit shingle hashes.
    """
    small_batches(docs.sparkSession)
    rows_ = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(rows_.mapInArrow(_sketch(bands, rows, least_shingles(threshold)), "doc_id long, id long, keys array<long>, " + ", ".join(f"{c} long" for c in SKETCH)), "bags")
    # one row a text: its least doc_id stands for it
    texts = staged(signed.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "texts")

    def sets_of(asked: DataFrame) -> DataFrame:
        spots = staged(texts.join(asked, "id"), "asked-docs").select("doc_id", "id")
        found = maybe_in(rows_, "doc_id", bitmap(spots, "doc_id")).join(spots, "doc_id")
        return found.mapInPandas(_expanded, "id long, h array<int>").dropDuplicates(["id"])

    def alike(x: str, y: str) -> F.Column:
        both = F.size(F.array_intersect(x, y))
        return both >= threshold * (F.size(x) + F.size(y) - both)

    linked = components(leader_links(signed.where("size(keys) > 0").select("id", "keys", *SKETCH), sets_of, alike, list, threshold))
    # from texts to groups, and back to the rows of each text
    named = texts.join(linked, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    named = staged(named, "named")
    heads = staged(named.groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")), "heads")
    groups = spread_join(named.select("id", "component"), heads.drop("n"), crowded(heads, "component"), "component", "id").select("id", "group_id")
    placed = spread_join(signed.where("id is not null").select("doc_id", "id"), groups, crowded(texts, "id"), "id", "doc_id").select("doc_id", "group_id")
    return placed.unionByName(signed.where("id is null").select("doc_id", F.col("doc_id").alias("group_id")))


def dedup_documents(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose group keeps another: the least doc_id of a group stays.

    Ids should be unique; rows that share an id stay or go together. Rows with a null id stay.
    """
    gone = group_documents(docs, threshold, id_col=id_col, text_col=text_col).where("doc_id <> group_id").select(F.col("doc_id").alias(id_col))
    return without_ids(docs, gone, id_col)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
