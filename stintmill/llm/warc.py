"""Operator 10: writing WARC archives and reading them back by boundary-chain verification.

Archives are written by Spark's text writer with CRLF CRLF, the end of a WARC record, as its line
separator. Reading, tasks cut the files at every place that looks like the start of a record and
emit (start, successor), the successor from the record's own Content-Length. A payload may hold
bytes that look like a start, so candidates prove nothing: pointers are doubled from the start of
each file, and only what the chain reaches is a record. Pieces cut off by a false start
inside a payload are put back together for the records that lack bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, staged, table
from .linking import bitmap, crowded, maybe_in, spread_join, surely_out

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_REVISIT = 100  # bytes; smaller payloads are always stored
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): null html is an empty payload."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.encode("payload", "UTF-8"), 256).alias("payload_digest")
    )
    narrow = staged(rows.where(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "payload_digest"), "digests")
    shared = staged(narrow.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "shared-digests")
    # one payload may be that of a third of all pages
    copies = spread_join(narrow, shared.drop("n"), crowded(shared, "payload_digest"), "payload_digest", "page_id", hint="merge")
    revisits = staged(copies.where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct(), "revisits")
    # only pages that may be revisits are shuffled; the other payloads stay where they are
    rows = rows.withColumn("_k", F.xxhash64("page_id", "payload_digest"))
    marks = bitmap(revisits.select(F.xxhash64("page_id", "payload_digest").alias("_k")), "_k")
    again = maybe_in(rows, "_k", marks).drop("_k").join(revisits.hint("merge"), ["page_id", "payload_digest"], "left")
    return again.unionByName(surely_out(rows, "_k", marks).drop("_k").withColumn("refers_to", F.lit(None).cast("long")))


def records(pages: DataFrame) -> DataFrame:
    """One string a page: a response or revisit record up to its closing CRLF CRLF."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    none = F.lit("")
    return pages.select(
        F.concat(
            F.lit(MAGIC),
            header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), none), F.lit(">"))),
            header("WARC-Date", F.lit(RECORD_DATE)),
            header("WARC-Target-URI", uri),
            header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
            F.when(
                revisit,
                F.concat(
                    header("WARC-Profile", F.lit(PROFILE)),
                    header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                ),
            ).otherwise(none),
            header("Content-Type", F.lit("text/html; charset=utf-8")),
            header("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
            F.lit("\r\n"),
            F.when(revisit, none).otherwise(F.col("payload")),
        ).alias("value")
    )


def write_warc(pages: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write one record a row of (page_id, url, html) below path, which must not exist yet."""
    out = records(with_digests(pages))
    out.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")) if v}


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece between two record starts, with its place in its block of the file.

    Of a piece that holds its whole record only the digest is handed on; other pieces keep their bytes.
    """
    block, place = None, 0
    for pdf in batches:
        out = []
        for file, start, raw in zip(pdf["file"], pdf["block"], pdf["raw"], strict=True):
            if (file, start) != block:
                block, place = (file, start), 0
            head, gap, _ = raw.partition(END.encode())
            fields = _fields(head.decode("utf-8", "replace")) if gap else {}
            length = int(n) if (n := fields.get("content-length", "")).isdecimal() else -1
            body = len(head) + len(END)
            whole = length >= 0 and len(raw) == body + length + len(END)
            out.append(
                (
                    file,
                    start,
                    place,
                    len(raw),
                    *map(fields.get, ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to")),
                    length,
                    body,
                    hashlib.sha256(raw[body : body + length]).hexdigest() if whole else None,
                    None if whole else raw,
                )
            )
            place += len(raw) + len(MAGIC)
        yield pd.DataFrame(out, columns=_COLUMNS)


_PIECE = (
    "file string, block long, place long, size long, record_id string, type string, uri string, digest string, refers string, "
    "length long, body long, found string, raw binary"
)
_COLUMNS = [c.split()[0] for c in _PIECE.split(", ")]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every possible record of the archives below path: (file, start, successor, ...).

    Spark's text reader cuts the files at record starts, in splits. A piece's offset is the bytes
    of the blocks before its own, plus those before it in its block. A successor is where the
    Content-Length of a candidate says the next record starts; null without one.
    """
    small_batches(spark)
    cut = spark.read.option("lineSep", MAGIC).text(path)
    cut = cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    pieces = staged(cut.mapInPandas(_pieces, _PIECE), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    return (
        pieces.join(blocks.hint("merge"), ["file", "block"])
        .withColumn("start", F.col("offset") + F.col("place") - len(MAGIC))
        .where("start >= 0")  # what precedes the first start of a file
        .withColumn("successor", F.when(F.col("length") >= 0, F.col("start") + len(MAGIC) + F.col("body") + F.col("length") + len(END)))
        .drop("block", "place", "offset")
    )


def reachable(links: DataFrame) -> DataFrame:
    """(file, start) of what the chain of successors reaches from each file's start.

    links: (file, start, successor). Known starts and pointers double in each round: pointers that
    led k records on lead 2k, so a file of n records takes log2 n rounds.
    """
    jump = staged(links.where("successor is not null").select("file", "start", F.col("successor").alias("to")), "jumps")
    known = staged(links.where("start = 0").select("file", "start").distinct(), "known")
    size = known.count()
    while True:
        ahead = known.join(jump.hint("merge"), ["file", "start"]).select("file", F.col("to").alias("start"))
        known = staged(known.unionByName(ahead).distinct(), "known")
        now = known.count()
        if now == size:
            break
        size = now
        on = jump.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jump = staged(jump.join(on.hint("merge"), ["file", "to"]).select("file", "start", F.col("further").alias("to")), "jumps")
    return known.hint("merge").join(links, ["file", "start"], "left_semi")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, uri, type, refers_to, payload_bytes, payload_digest) of the records below path.

    A revisit takes size and digest from the record that it refers to. Records whose bytes do not
    match their own digest raise no error here: ``intact`` is false for them.
    """
    pieces = candidates(spark, path)
    chain = staged(reachable(pieces.select("file", "start", "successor")), "chain")
    real = pieces.join(chain.select("file", "start").hint("merge"), ["file", "start"])
    # records that lack bytes take them from the pieces up to their successor: in file order, a piece
    # belongs to the last record before it
    broken = staged(real.where("found is null").select("file", "start", "successor", "length", "body"), "broken")
    loose = staged(pieces.where("raw is not null").select("file", F.col("start").alias("at"), "raw"), "loose")
    order = Window.partitionBy("file").orderBy("at")
    narrow = loose.select("file", "at").join(broken.withColumn("at", F.col("start")).hint("merge"), ["file", "at"], "left")
    owners = [F.last(c, ignorenulls=True).over(order).alias(c) for c in ("start", "successor", "length", "body")]
    owned = narrow.select("file", "at", *owners).where("at < successor")
    inside = loose.join(owned.hint("merge"), ["file", "at"])
    mended = inside.groupBy("file", "start", "length", "body").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    mended = mended.select("file", "start", _mended().alias("mended"))
    rows = real.join(mended.hint("merge"), ["file", "start"], "left").select(
        _page("record_id").alias("page_id"),
        "uri",
        F.col("type").alias("record_type"),
        _page("refers").alias("refers_to"),
        F.col("length").alias("bytes"),
        F.coalesce("found", "mended").alias("found"),
        F.regexp_replace("digest", "^sha256:", "").alias("said"),
    )
    rows = staged(rows, "records")
    # a response is named by its page and digest; a third of all records may revisit one, so the join is spread
    name = lambda page, digest: F.concat(F.col(page).cast("string"), F.lit(":"), F.col(digest))
    stored = rows.where("record_type = 'response'").select(name("page_id", "found").alias("of"), F.col("bytes").alias("to_bytes"), F.col("found").alias("to_found"))
    stored = stored.where("of is not null").groupBy("of").agg(F.min("to_bytes").alias("to_bytes"), F.min("to_found").alias("to_found"))
    again = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    asks = rows.where(again).withColumn("of", name("refers_to", "said"))
    sizes = staged(asks.groupBy("of").agg(F.count("*").alias("n")), "revisit-sizes")
    asks = spread_join(asks, stored, crowded(sizes, "of"), "of", "page_id", how="left", hint="merge")
    columns = ["page_id", "uri", "record_type", "refers_to"]
    intact = F.col("to_found").isNotNull().alias("intact")
    asks = asks.select(*columns, F.col("to_bytes").alias("payload_bytes"), F.col("to_found").alias("payload_digest"), intact)
    own = rows.where(~again).select(*columns, F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"), (F.col("said") == F.col("found")).alias("intact"))
    return own.unionByName(asks)


def _page(name: str) -> F.Column:
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def _mended() -> F.Column:
    """SHA-256 of a payload whose bytes lie in several pieces, the starts between them put back."""
    joined = f"aggregate(slice(parts, 2, size(parts)), parts[0].raw, (acc, p) -> concat(acc, unhex('{MAGIC.encode().hex()}'), p.raw))"
    return F.expr(f"sha2(substring({joined}, cast(body as int) + 1, cast(length as int)), 256)")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "intact")
