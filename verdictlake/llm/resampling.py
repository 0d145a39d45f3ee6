"""Importance resampling of documents towards a target text collection, in Spark SQL alone.

Word n-grams are exploded and hashed into a fixed number of buckets. A bucket's gain is the log ratio of its smoothed
shares of the target's and of the documents' features, as an integer; the gains, one row for each bucket, are broadcast to the
exploded features, and a document's weight is the floored mean of its gains. With Gumbel noise drawn from the id, the
highest scores are a draw without replacement.

Ranks come from one sort over all executors: rows are dealt by ranges of the order, sorted inside, and counted by
partition; a row's rank is its place in its partition plus the rows of the partitions before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, lasting, scratch, staged, whole_text

#: What stands between words once A-Z are lower-case letters: all of ASCII but digits and letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResampleConfig:
    """longest: features are runs of 1 to so many words. buckets: of features; gains are broadcast, one row for each. least_words: of
    documents that can be drawn. percent: of these are drawn. seed: of the noise."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def _grams(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, joined by one space."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *(runs(n) for n in range(2, longest + 1))) if longest > 1 else words


def feature_buckets(texts: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """The columns of texts but `text`, n_words and bucket: a row for each feature, one with a null bucket where a text has none."""
    kept = [c for c in texts.columns if c != "text"]
    words = texts.select(*kept, F.array_remove(F.split(whole_text(), BETWEEN_WORDS), "").alias("words"))
    grams = words.select(*kept, F.size("words").alias("n_words"), F.explode_outer(_grams(F.col("words"), config.longest)).alias("gram"))
    # letters are lowered after the words are told apart, which gives the same words: A-Z and a-z are both inside of words
    bucket = F.pmod(F.crc32(ascii_lower(F.col("gram")).cast("binary")), F.lit(config.buckets)).cast("int")
    return grams.select(*kept, "n_words", bucket.alias("bucket"))


def _bucket_counts(texts: DataFrame, name: str, config: ResampleConfig) -> DataFrame:
    return feature_buckets(texts.select("text"), config).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """bucket, gain for each of the buckets: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of its s of the S features of
    docs(text) and t of the T of target(text)."""
    spark = docs.sparkSession
    every = spark.range(config.buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(_bucket_counts(docs, "s", config), "bucket", "left").join(_bucket_counts(target, "t", config), "bucket", "left").na.fill(0, ["s", "t"])
    counts = staged(counts)
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    # without a bucket there is nothing to sum
    all_s, all_t = (float((x or 0) + config.buckets) for x in (total["s"], total["t"]))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(F.lit(1000.0) * F.log((t + 1.0) * F.lit(all_s) / ((s + 1.0) * F.lit(all_t))))
    return counts.select("bucket", gain.cast("long").alias("gain"))


def _floored_mean(total: Column, n: Column) -> Column:
    """total / n rounded down, in integers; 0 where n is 0."""
    divisor = F.greatest(n, F.lit(1))
    return F.coalesce(F.call_function("div", total - F.pmod(total, divisor), divisor), F.lit(0).cast("long"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of seed and id."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((head + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows, staged in order, with their place from 1: a sort by ranges over all executors, the place inside a partition and the rows of the
    partitions before it. Rows that are equal in all of order get their places among themselves in any way."""
    spot = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the row in the lower 33
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", spot))
    part = F.shiftrightunsigned(F.col("_spot"), 33).alias("_part")
    # one row for each partition of the sort
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_before") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("_part", part).join(offsets, "_part").withColumn(name, place).drop("_part", "_spot", "_before")


def resample(docs: DataFrame, target: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs(doc_id, text), towards target(text); rank is null where a
    document isn't drawn.

    Null texts have no features, a document without features weighs 0. Rows that repeat an id are documents of their own with the
    same noise; of equal scores and ids the one with fewer features, then with less weight is first. A null id draws noise as an empty one and comes
    before others among equal scores. An empty target or table is smoothed like any other. Further columns are ignored.
    """
    with scratch(docs.sparkSession):
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        gains = staged(bucket_gains(own, target, config))
        features = feature_buckets(own.withColumn("row", F.monotonically_increasing_id()), config)
        # a document's features stand together, so that the sum before the shuffle leaves a row for each document
        sums = features.join(F.broadcast(gains), "bucket", "left").groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.sum("gain").alias("total"))
        weight = _floored_mean(F.col("total"), F.col("n_features"))
        able = F.col("n_words") >= config.least_words
        scored = staged(sums.select("doc_id", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), config.seed)).alias("score"), able.alias("able")))
        drawn = config.percent * scored.where("able").count() // 100
        order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
        rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
        return lasting(with_places(scored, order).select("doc_id", "n_features", "weight", "score", rank.alias("rank")))
