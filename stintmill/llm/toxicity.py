"""Operator 3: toxicity by class-conditional Kneser-Ney models.

Two language models, one of toxic and one of ordinary text, share their backoff. Each is an
absolute-discounted chain: word after word, then the word by continuation count (in how many
different contexts it was seen), then its opening characters by the same counts, and last a
distribution counted over both classes together. What the discounts take from rare events goes
to the shared levels, and an expression too rare to differ between the classes by more than
sampling error is left to them whole, so it says nothing about the class.
A text's value is the difference of the two log-likelihoods over its number of tokens; a cut and
a slope fitted on labelled rows that the counts never saw turn it into a score.

Training reads a sample of at most about ``max_per_class`` labelled rows of each class and of
``max_chars`` characters of them, whole texts, exact copies once. Everything kept of it is bounded by
that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, table

TOKEN = re.compile(r"\w+")
STEM = 4
START = "\x02"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def held_out(id_col) -> F.Column:
    """True where crc32 of the id as text leaves 0 over 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def sampled_labels(labels: DataFrame, max_per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, toxic, fit) of the labelled rows that may teach, about max_per_class a class.

    Rows with a null id or label teach nothing; an id labelled twice takes the larger label.
    Sampling is by a hash of the id, so reruns agree.
    """
    rows = (
        labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rates = rows.groupBy("toxic").agg(F.least(F.lit(1.0), F.lit(float(max_per_class)) / F.count("*")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return rows.join(F.broadcast(rates), "toxic").where(draw < F.col("rate")).select(
        "doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) > 0).alias("fit")
    )


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word pairs of each class, summed inside a task and handed on before the counter grows large."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        keys = list(seen[0].keys() | seen[1].keys())
        out = pd.DataFrame({"u": [k[0] for k in keys], "w": [k[1] for k in keys], "n0": [seen[0][k] for k in keys], "n1": [seen[1][k] for k in keys]})
        seen[0].clear()
        seen[1].clear()
        return out

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            found = tokens(text)
            seen[toxic].update(zip([START, *found], found))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield flush()
    if seen[0] or seen[1]:
        yield flush()


def count_table(texts: DataFrame) -> DataFrame:
    """(u, w, n0, n1): how often w follows u in ordinary and toxic text. Input: text, toxic."""
    pairs = texts.mapInPandas(_count_pairs, "u string, w string, n0 long, n1 long")
    return pairs.groupBy("u", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _apart(sigmas: float, totals) -> F.Column:
    """Rows whose two counts differ by more than sampling error, given the classes' totals."""
    t0, t1 = (max(1.0, float(t or 0)) for t in totals)
    n, share = F.col("n0") + F.col("n1"), t1 / (t0 + t1)
    return F.abs(F.col("n1") - n * share) >= sigmas * F.sqrt(n * share * (1 - share))


class Model:
    """Log-likelihood ratios (toxic over ordinary), looked up token by token.

    A word that is not listed takes its opening's ratio, and 0 where that is not listed either:
    both classes then back off to the same shared counts. A listed pair adds what it says beyond
    its second word.
    """

    def __init__(self, words: dict, stems: dict, pairs: dict):
        self.words, self.stems, self.pairs = words, stems, pairs
        self.cut: float | None = 0.0  # None: nothing is known of the classes
        self.slope = 1.0

    def value(self, text: str | None) -> float:
        """Length-normalised difference of the two log-likelihoods; 0 for a text without tokens."""
        found = tokens(text)
        if not found:
            return 0.0
        words, stems = self.words, self.stems
        each = sum([v if (v := words.get(t)) is not None else stems.get(t[:STEM], 0.0) for t in found])
        return (each + sum(map(self.pairs.get, zip(found, found[1:]), repeat(0.0)))) / len(found)

    def score(self, text: str | None) -> float:
        if self.cut is None or not text or not TOKEN.search(text):
            return 0.0
        x = self.slope * (self.value(text) - self.cut)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def fit_counts(counts: DataFrame, discount: float, min_count: int, sigmas: float, least: float) -> Model:
    """The model from staged (u, w, n0, n1); only bounded tables reach the driver.

    Events whose counts do not differ between the classes by ``sigmas`` standard errors are
    smoothed whole by the shared counts, so their ratio is 0, as is one below ``least``.
    """
    seen = lambda c: F.count(F.when(F.col(c) > 0, 1))
    by_word = counts.groupBy("w").agg(seen("n0").alias("n0"), seen("n1").alias("n1")).withColumn("s", F.substring("w", 1, STEM))
    by_stem = by_word.groupBy("s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    kept = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0))
    sums = lambda df: df.agg(F.sum("n0"), F.sum("n1"), F.sum(kept("n0")), F.sum(kept("n1"))).first()
    top = lambda df: df.collect()  # noqa: E731 - events of the bounded sample

    def chances(row, total, left, low):
        return [max(row[f"n{c}"] - discount, 0.0) / total[c] + left[c] * low[c] for c in (0, 1)]

    def ratio(p):
        r = math.log(p[1] / p[0])
        return r if abs(r) >= least else 0.0

    def level(m):
        total = [max(1.0, float(m[c] or 0)) for c in (0, 1)]
        return total, [max(1e-6, 1 - (m[2 + c] or 0) / total[c]) for c in (0, 1)]

    of_words, of_stems = level(sums(by_word)), level(sums(by_stem))
    whole = sum(of_words[0])
    enough = F.col("n0") + F.col("n1") >= min_count
    stem_p, stems = {}, {}
    for r in top(by_stem.where(enough & _apart(sigmas, of_stems[0]))):
        stem_p[r.s] = (chances(r, *of_stems, ((r.n0 + r.n1) / whole,) * 2), r.n0 + r.n1)
        stems[r.s] = ratio(stem_p[r.s][0])
    apart = _apart(sigmas, of_words[0])
    listed = counts.sparkSession.createDataFrame([(s, True) for s in stems], "s string, listed boolean")  # openings of the bounded sample
    words, word_p = {}, {}
    for r in top(by_word.where(enough).join(F.broadcast(listed), "s", "left").where(apart | F.col("listed")).withColumn("apart", apart)):
        n = r.n0 + r.n1
        (low, inside) = stem_p.get(r.s, ((n / whole,) * 2, n))
        word_p[r.w] = chances(r, *of_words, [x * n / inside for x in low])
        words[r.w] = ratio(word_p[r.w]) if r.apart else 0.0
    context = counts.groupBy("u").agg(
        F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.sum(kept("n0")).alias("k0"), F.sum(kept("n1")).alias("k1")
    )
    share = F.col("c1") / (F.col("c0") + F.col("c1"))
    off = F.abs(F.col("n1") - (F.col("n0") + F.col("n1")) * share) >= sigmas * F.sqrt((F.col("n0") + F.col("n1")) * share * (1 - share))
    pairs = {}
    for r in top(counts.where(enough).join(context.where("c0 > 0 and c1 > 0"), "u").where(off).select("u", "w", "n0", "n1", "c0", "c1", "k0", "k1")):
        low = word_p.get(r.w, ((r.n0 + r.n1) / whole,) * 2)
        p = chances(r, (r.c0, r.c1), [max(1e-6, 1 - r.k0 / r.c0), max(1e-6, 1 - r.k1 / r.c1)], low)
        if r.w not in words and (more := ratio(p)):
            pairs[r.u, r.w] = more
    return Model(words, stems, pairs)


def calibrate(model: Model, rows: list[tuple[float, int]]) -> None:
    """Cut with the fewest errors (the middle of the widest such gap); slope from the class means.

    Without rows of both classes there is no cut, and every text scores 0: nothing is called toxic unlearned.
    """
    rows = sorted(rows)
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)):
        model.cut = None
        return
    best, wrong = None, ones  # everything called toxic: wrong are the ordinary ones
    errors = len(rows) - ones
    for i in range(len(rows) + 1):
        lo = rows[i - 1][0] if i else rows[0][0] - 1
        hi = rows[i][0] if i < len(rows) else rows[-1][0] + 1
        if hi > lo and (best is None or (errors, lo - hi) < best[:2]):
            best = (errors, lo - hi, (lo + hi) / 2)
        if i < len(rows):
            errors += 1 if rows[i][1] else -1
    model.cut = best[2]
    mean = [sum(v for v, y in rows if y == c) / max(1, wrong if c else len(rows) - wrong) for c in (0, 1)]
    model.slope = 8.0 / max(1e-3, mean[1] - mean[0])


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_per_class: int = 6000,
    discount: float = 0.75,
    min_count: int = 5,
    sigmas: float = 4.0,
    least: float = 1.5,
    max_chars: int = 60_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Models from the labelled rows whose crc32 is not 0 over 5; four fifths count, one fifth calibrates."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = sampled_labels(labels, max_per_class, id_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = staged(texts.where("text is not null").withColumn("size", F.length("text").cast("long")), "toxic-sample")
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    short = texts.select("doc_id", "toxic", "size", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before")).where(F.col("before") < max_chars)  # a few thousand rows
    texts = texts.join(F.broadcast(short.select("doc_id").distinct()), "doc_id", "left_semi")
    fit = texts.where("fit").select("text", "toxic")
    # exact copies teach once: only rows of the sample are grouped, and by hash, not by text
    once = staged(fit.withColumn("k", F.xxhash64("text")).dropDuplicates(["k", "toxic"]).select("text", "toxic"), "toxic-fit")
    model = fit_counts(staged(count_table(once), "toxic-pairs"), discount, min_count, sigmas, least)
    shared = spark.sparkContext.broadcast(model)
    value = F.pandas_udf(lambda s: pd.Series([shared.value.value(t) for t in s], dtype=float), "double")
    rows = texts.where("not fit").select(value("text").alias("v"), "toxic").collect()
    calibrate(model, [(r.v, r.toxic) for r in rows])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs plus ``score`` (0 to 1) of each whole text; null, empty and token-free texts score 0, as does
    every text where training had no rows of both classes.

    A column of docs that is named as the result is replaced. Rows are scored one by one, so copies
    and repeated ids score alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = F.pandas_udf(lambda s: pd.Series([shared.value.score(t) for t in s], dtype=float), "double")
    return docs.withColumn(out_col, scored(F.col(text_col)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
