"""Operator 9: URL filters by gradient-boosted trees on lexical features; DataFrame functions and MLlib only.

Features come from the URL's text alone: lengths, depth, digit ratio, character entropy, counts of
parameters, hyphens and labels, and block rates of host suffix and top-level label. Labels come
from rules and from seed words that stand between separators of a host. A bounded sample of labelled
URLs trains the trees; where no rule fits, the trees decide.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

# The rules of the registered query (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Host words that label a URL for training; they are not features.
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "casino", "click", "free", "pills", "porn", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
FOLDS = 16  # a row's suffix statistics come from the rows of the other folds; a crowded suffix is dealt by fold too
BROADCAST_RATES = 200_000  # rates of suffixes are broadcast up to this many rows (some MB), and joined by a shuffle beyond
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "host_entropy", "params", "hyphens",
    "longest_label", "has_fragment", "has_extension", "https", "suffix_rate", "top_rate",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or the end, A-Z lowered) and path (then up to ? # or the end)."""
    # the match is from the first "://" on; [\s\S] takes line ends inside a URL too
    pattern = r"^(?:(?!://)[\s\S])*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule fits its host and all subdomains when the path starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for own_host, own_path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        rule = F.when(fits, F.lit(own_host + own_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(name: str) -> Column:
    """Bits of entropy of the characters: log2(n) less the mean of log2 of each character's count."""
    counts = f"transform(array_distinct(split({name}, '')), c -> length({name}) - length(replace({name}, c, '')))"
    total = f"aggregate({counts}, 0D, (a, n) -> a + n * log2(greatest(n, 1)))"
    return F.expr(f"if(length({name}) = 0, 0D, log2(length({name})) - {total} / length({name}))")


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path and others) plus the lexical columns and the keys of the suffix statistics."""
    part = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    u = F.coalesce("url", F.lit(""))
    return (
        urls.withColumn("u", u)
        .withColumn("url_length", F.length("u").cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", part(F.rtrim(F.col("path"), F.lit("/")), "/").cast("double"))
        .withColumn("labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("digit_ratio", part(F.col("u"), "0123456789") / F.greatest(F.lit(1), F.length("u")))
        .withColumn("entropy", _entropy("u"))
        .withColumn("host_entropy", _entropy("host"))
        .withColumn("params", (part(F.col("u"), "&") + (F.instr("u", "?") > 0).cast("int")).cast("double"))
        .withColumn("hyphens", part(F.col("host"), "-").cast("double"))
        .withColumn("longest_label", F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double"))
        .withColumn("has_fragment", (F.instr("u", "#") > 0).cast("double"))
        .withColumn("has_extension", F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"))
        .withColumn("https", F.col("u").startswith("https://").cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -2))
        .withColumn("top", F.substring_index("host", ".", -1))
    )


def labelled(urls: DataFrame) -> DataFrame:
    """URLs with a label: 1 (block) or 0 (allow), by rule, else by the host's seed words, else 0 for known rules only.

    A host without a seed word is taken as allowed, as most of the web is.
    """
    word = F.arrays_overlap(F.split("host", r"[.\-_]"), F.array(*map(F.lit, BLOCKED_WORDS)))
    return urls.withColumn("label", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("double")).otherwise(word.cast("double")))


def judge(
    pages: DataFrame,
    rules=RULES,
    max_training: int = 20_000,
    trees: int = 15,
    depth: int = 4,
    smoothing: float = 20.0,
    seed: int = 20240817,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): every URL's verdict, the longest rule's or else the trees'.

    A null URL or one without :// has an empty host and path and is judged by the trees like any
    other. Rows repeat as they come; rows with a null id are judged too. Training takes about
    ``max_training`` rows by a hash of the URL; suffix statistics are taken over all labelled rows of
    the other folds, smoothed towards the overall rate. With one class only, everything not ruled on is
    given that class; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("*", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = labelled(lexical(rows.select("*", rule.alias("rule"), said.alias("said"))))
    rows = staged(rows.drop("url", "u"), "url-features")
    seen = rows.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    if not seen.n:
        return rows.select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("block_score"))
    # a key's block rate as the other folds have it, and ``smoothing`` rows of the overall rate
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(FOLDS)).cast("int"))
    for key, name in (("suffix", "suffix_rate"), ("top", "top_rate")):
        sums = rows.groupBy(key, "fold").agg(F.sum("label").alias("own"), F.count("*").alias("n"))
        others = lambda c: F.sum(c).over(Window.partitionBy(key)) - F.col(c)  # noqa: E731, B023
        rates = sums.select(key, "fold", ((others("own") + smoothing * seen.rate) / (others("n") + smoothing)).alias(name))
        rates = staged(rates, "url-rates")
        rows = rows.join(F.broadcast(rates) if rates.count() <= BROADCAST_RATES else rates, [key, "fold"])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    draw = F.pmod(F.xxhash64("host", "path", "page_id", F.lit(seed)), F.lit(1_000_000))
    sample = staged(ready.where(draw < int(min(1.0, max_training / seen.n) * 1_000_000)).select("features", "label"), "url-sample")
    classes = [r.label for r in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        scored = ready.withColumn("block_score", F.lit(float(classes[0]) if classes else 0.0))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2).fit(sample)
        scored = model.transform(ready).withColumn("block_score", vector_to_array("probability")[1])
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "block_score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
