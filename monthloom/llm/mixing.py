"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source's repetition rate is its target share of all characters over its present share, times `size`. Each document gets
a uniform number from a seeded hash of its id, and its count is the Poisson quantile at that number for its source's rate:
the number of probabilities of the distribution's cumulative sums that it exceeds. A rate above PART is a sum of parts, each
with a number of its own from the hash of id and part, as a sum of Poisson counts is a Poisson count; so the cumulative sums of a
source are a short array whatever its rate, and a document's work is in proportion to its copies. Documents are exploded
by their counts, so the expected mix is the target, and all copies are sorted by a second hash: a global shuffle.

Scale: one combined aggregate over (source); its rows are counted before they are broadcast (SOURCES at most, of some 2 KB), else
the join is on source and a salt. The global order's keys are uniform digests, so a copy's partition is its digest's leading digits
times the number of partitions: no sampling pass, and a hot source spreads over all. That number follows from the characters.

Cases: a null source is a source of its own. Null text counts 0 characters. A source without characters has rate 1, as
its share can't be changed. Repeated rows: each has the same count. A null id hashes as the text 'null'. Weights for absent sources are
left out and the rest scaled to 1. A tiny source has a large rate, any finite number. An empty table gives an empty result. The
columns of docs stay, whatever their names. In details, copy numbers a document's copies within a part of its rate (after the part's
number times 1000, so it is unique), copies is their number in that part.
"""

from __future__ import annotations

from math import ceil, exp, log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SOURCES, SALTS = 4_000, 64
#: Largest rate that is drawn at once; its count is below PART_COPIES but for a probability of 1e-15.
PART, PART_COPIES = 128.0, 1000
#: Characters for a partition of the result.
PARTITION = 64 << 20
OWN = "__mix_"


def uniform(key: Column) -> Column:
    """52 bits of md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities from 0 on, far enough that what is left is below 1e-15; rate is at most PART."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), top),
        F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")),
        lambda a, k: _next(a, k, rate),
        lambda a: a["all"],
    )


def _next(a: Column, k: Column, rate: Column) -> Column:
    log_p = F.when(k == 0, -rate).otherwise(a["log_p"] + F.log(rate) - F.log(k.cast("double")))
    total = a["sum"] + F.exp(log_p)
    return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(a["all"], F.array(total)).alias("all"))


def whole_part() -> list[float]:
    """steps() of a rate of PART."""
    out, log_p, total = [], 0.0, 0.0
    for k in range(ceil(PART + 12 * sqrt(PART) + 40) + 1):
        log_p = -PART if k == 0 else log_p + log(PART) - log(k)
        total += exp(log_p)
        out.append(total)
    return out


def rates(docs: DataFrame, weights: dict[str, float] | None, size: float, source: str, text: str) -> DataFrame:
    """source, rate, chars. weights: target share by source, even if None."""
    by = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    if weights is None:
        wanted = F.lit(1.0)
    else:
        wanted = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("source")], F.lit(0.0))
    by = cut(by.withColumn("w", F.when(F.col("chars") > 0, wanted).otherwise(0.0)))
    whole = by.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    rate = F.when(F.col("chars") == 0, 1.0).when(F.col("w") == 0, 0.0).otherwise(F.col("w") / F.lit(whole.w) * F.lit(whole.chars) / F.col("chars") * size)
    return by.select("source", rate.alias("rate"), "chars")


def copied(rated: DataFrame, seed: str, key: Column) -> DataFrame:
    """rated (with rate and steps) exploded to copies: also copy, count."""
    rate, number = F.col(OWN + "rate"), F.col(OWN + "part")
    last = F.greatest(F.ceil(rate / PART) - 1, F.lit(0)).cast("long")  # parts beyond the first, PART each
    run = 4096
    parts = rated.withColumn(OWN + "last", last).withColumn(OWN + "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(OWN + "last") / run))))
    parts = parts.withColumn(OWN + "part", F.explode(F.sequence(F.col(OWN + "run") * run, F.least(F.col(OWN + "last"), F.col(OWN + "run") * run + (run - 1)))))
    drawn = uniform(F.concat(F.lit(seed + ":n:"), key, F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise("")))
    known = F.when(number > 0, F.lit(whole_part())).otherwise(F.col(OWN + "steps"))
    counted = parts.withColumn(OWN + "u", drawn).withColumn(OWN + "count", F.size(F.filter(known, lambda c: c <= F.col(OWN + "u"))))
    # outer, as a filter on the count before it would draw each number twice
    copies = counted.withColumn(OWN + "nth", F.explode_outer(F.when(F.col(OWN + "count") > 0, F.sequence(F.lit(1), F.col(OWN + "count"))))).where(F.col(OWN + "nth").isNotNull())
    return copies.withColumn(OWN + "copy", number * PART_COPIES + F.col(OWN + "nth")).drop(OWN + "steps", OWN + "u", OWN + "last", OWN + "run", OWN + "part", OWN + "nth")


def shuffled(rows: DataFrame, order: str, partitions: int) -> DataFrame:
    """rows in the order of a column of uniform hexadecimal digests."""
    digits = F.conv(F.substring(order, 1, 7), 16, 10).cast("long")
    return rows.repartitionById(partitions, F.floor(digits * partitions / (1 << 28)).cast("int")).sortWithinPartitions(order)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = "mix", source: str = "source", text: str = "text", doc_id: str = "doc_id", details: bool = False) -> DataFrame:
    """docs repeated to the target mix, in a global random order; with details also copy, copies, rate, position key."""
    known = rates(docs, weights, size, source, text)
    rest = F.col("rate") - PART * F.greatest(F.ceil(F.col("rate") / PART) - 1, F.lit(0))
    steps_of = known.select(F.col("source").alias(OWN + "source"), F.col("rate").alias(OWN + "rate"), F.when(rest > 0, steps(rest)).otherwise(F.array(F.lit(1.0))).alias(OWN + "steps"))
    told = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("chars") * F.col("rate")), F.lit(0.0)).alias("chars")).first()
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    same = F.col(source).eqNullSafe(F.col(OWN + "source"))
    if told.n <= SOURCES:
        rated = docs.join(F.broadcast(steps_of), same)
    else:
        salted = steps_of.withColumn(OWN + "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn(OWN + "salt2", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(OWN + "salt") == F.col(OWN + "salt2"))).drop(OWN + "salt", OWN + "salt2")
    copies = copied(rated.drop(OWN + "source"), seed, key)
    order = F.md5(F.concat(F.lit(seed + ":o:"), key, F.lit(":"), F.col(OWN + "copy").cast("string")).cast("binary"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = shuffled(copies.withColumn(OWN + "order", order), OWN + "order", min(max(least, int(told.chars // PARTITION)), 1 << 15))
    if details:
        return out.select(*docs.columns, F.col(OWN + "copy").cast("int").alias("copy"), F.col(OWN + "count").alias("copies"), F.round(OWN + "rate", 6).alias("rate"), F.col(OWN + "order").alias("position_key"))
    return out.select(*docs.columns)
