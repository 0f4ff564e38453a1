"""Operator 8: mixing sources to target weights by capped water-filling.

Every source asks for its share of the mix by weight; a source may not give more than
``max_epochs`` times what it holds. Sources over their cap are clamped to it and what they
cannot give is shared again among the rest by weight, until none is above its cap. That
fixed point is a water level: with sources in order of cap / weight, those whose cap lies
under the level are clamped and the others get level x weight, so one ordered running sum
over the table of sources finds what the rounds of clamping find.

A source's target, rounded to whole words, is met exactly: ``target // source size`` whole
repetitions of each document, then one more repetition of documents in seeded hash order until
the words are used up; the document at the end of that order gives a fraction of itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 50_000  # the plan is broadcast up to this many sources (a few MB), and shuffled beyond
BUCKETS_HEX = 3  # 4096 hash buckets a source: the prefix sum runs over buckets, then inside one


def water_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> plus weight and target; one row a source, nulls last.

    Weights repeat over the sources by code point. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("n", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    level = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after),
        )
        .withColumn("open", F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "n", "level")))
        .withColumn("at", F.min("open").over(everything))
    )
    return level.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("at.level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights=(3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 20240817,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: what the mix takes of it, and the columns named in ``carry``.

    Columns: doc_id, source, size (words), source_size, target (words of its source),
    repeats (whole repetitions), part (words of one more, fractional, repetition), taken.

    Null text counts as no words; a null source is a source, weighed last; a null id is hashed
    as the empty string; repeated rows are separate documents, and those equal in id and size
    are interchangeable. An empty table gives no rows. Other columns are ignored.
    Only (id, source, size) is shuffled, and carried columns only in the one bucket of 4096 a
    source in which its last repetition ends; beyond ``BROADCAST_SOURCES`` sources all of it is.
    """
    own = {"doc_id": F.col(id_col), "source": F.col(source_col)}
    extra = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)]
    measured = docs.select(
        *[c.alias(n) for n, c in own.items()], F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *extra
    )
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    hashed = lambda df: df.withColumn("h", h).withColumn("bucket", F.substring("h", 1, BUCKETS_HEX))
    narrow = hashed(staged(measured.select("doc_id", "source", "size"), "mix-sizes"))
    sized = hashed(measured) if carry else narrow
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = water_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("goal", F.floor(F.col("target") + 0.5)).withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0).cast("long"))
    )
    plan = plan.withColumn("need", F.col("goal") - F.col("repeats") * F.col("source_size"))
    # the bucket in which the extra repetition ends, and the words taken before it
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        buckets.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .alias("b")
        .join(plan.select("source", "need").alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .where("before < need and need <= before + words")
        .select(F.col("b.source").alias("source"), F.col("b.bucket").alias("edge"), F.col("b.before").alias("before"))
    )
    plan = (
        plan.alias("p")
        .join(edges.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .select("p.*", "e.edge", "e.before")
    )
    plan = staged(plan, "mix-plan")  # one row a source
    few = plan.count() <= BROADCAST_SOURCES
    rows = (
        sized.alias("d")
        .join((F.broadcast(plan) if few else plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.*", "p.source_size", "p.target", "p.repeats", "p.need", "p.edge", "p.before")
    )
    running = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where("bucket = edge").withColumn(
        "part",
        F.greatest(
            F.lit(0).cast("long"),
            F.least(F.col("size"), F.col("need") - F.col("before") - F.coalesce(F.sum("size").over(running), F.lit(0))),
        ),
    )
    outside = rows.where("edge is null or bucket <> edge").withColumn(
        "part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    return inside.unionByName(outside).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "repeats",
        "part",
        (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"),
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)],
    )


def mixed_texts(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """The mix itself: (doc_id, source, copy, text) and carried columns, one row a repetition.

    The last repetition of a source is its text up to the end of its ``part``-th word. Options are those of mix.
    """
    spaced = F.regexp_extract_all(text_col, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(spaced, 1, F.col("part").cast("int")), "")
    whole = F.array_repeat(F.col(text_col), (F.col("repeats") + (F.col("part") == F.col("size")).cast("int")).cast("int"))
    rest = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(cut)).otherwise(F.array().cast("array<string>"))
    plan = mix(docs, text_col=text_col, carry=(text_col, *carry), **options).where("taken > 0")
    return plan.select("doc_id", "source", *carry, F.posexplode(F.concat(whole, rest)).alias("copy", "text"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats", "part")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('20240817|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS n FROM s),
w AS (SELECT *, [3, 1, 2][((n - 1) % 3) + 1] AS weight, source_size * 2 AS cap FROM n),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
a AS (SELECT arg_min(level, (ratio, n)) AS level FROM l WHERE level < ratio),
t AS (SELECT l.source, source_size,
             least(CAST(cap AS DOUBLE), coalesce(a.level * weight, CAST(cap AS DOUBLE))) AS target FROM l, a),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal,
             CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS repeats FROM t),
p AS (SELECT *, goal - repeats * source_size AS need FROM g),
c AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.repeats,
             greatest(0, least(d.size, p.need - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(repeats * size + part AS BIGINT) AS taken, source,
       CAST(repeats AS BIGINT) AS repeats, CAST(part AS BIGINT) AS part
FROM c
"""
