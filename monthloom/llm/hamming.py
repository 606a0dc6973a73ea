"""Exact top-k search over binary codes by incremental multi-index hashing, as joins.

A vector's code has a bit for each coordinate, 1 where it is positive. A code is cut into m segments of about log2(codes) - 2
bits. The index is a table by (segment, value) of the codes that have this value there. A query's frontier is the table
of segment values that differ from its own in just r bits; the next one comes from it by flipping one more, higher bit, so
every value is met once and no list of masks is held anywhere. Joined with the index, the frontier gives the codes of
radius r; each is verified by its full distance, and a query keeps its best k + 1 rows.

After radius r over all segments every code within m * (r + 1) - 1 bits has been met. A query whose kth verified distance is
within that is done and leaves the frontier. One that has k rows at distance d needs, at radius r, only the first
d - m * r + 1 segments: a code within d bits has one of those within r or another within r - 1. The search ends when no
query is left, at the widest segment's width at the latest; nothing is answered in any other way.

Scale: such segments make about four codes a value, so a query meets few codes that are not near, and few values without codes. Of rows with
equal codes only the k + 1 with the smallest ids can be in an answer (one more, as a query leaves itself out); they are
picked with a limit before the shuffle. A value that very many codes share is kept in several chunks of about CHUNK codes,
and a probe of it is sent to each, so no task holds it whole; a chunk gives at most k + 1 rows a probe. A query that lies far
from all codes costs up to 2 ** width values a segment, about as many as there are codes.

Cases: a vector that is null, has another length than `bits`, or holds a null or NaN has no code: it is not in the index
and as a query has no rows. Distances that tie are ordered by id. Rows repeated with the same id count once. Fewer than
k other rows: all of them are returned. Empty tables give an empty result.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, map_batches, stored

LEAST_WIDTH, MOST_WIDTH, CHUNK, WORD = 4, 30, 1 << 12, 64


def codes(vectors: DataFrame, vec_id: str, vector: str, bits: int) -> DataFrame:
    """id, code: the code as 64-bit words, first coordinate in the lowest bit; rows without a code are left out."""
    words = -(-bits // WORD)

    def run(batches):
        for b in batches:
            ids, column = b.column("id"), b.column("vector")
            full = [i for i, n in enumerate(column.value_lengths().to_pylist()) if n == bits and ids[i].is_valid]
            flat = column.take(pa.array(full, pa.int64())).flatten()
            at = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, bits)
            whole = ~np.isnan(at).any(axis=1)
            on = np.zeros((int(whole.sum()), words * WORD), bool)
            on[:, :bits] = at[whole] > 0
            code = np.packbits(on, axis=1, bitorder="little").view("<i8").reshape(-1, words)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(full, np.int64)[whole])).cast(pa.int64()), pa.array(code.tolist(), pa.list_(pa.int64()))], ["id", "code"])

    return map_batches(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")), run, "id long, code array<long>")


def segments(bits: int, n: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of each segment for an index of n codes; a segment lies in one word."""
    out = []
    for word in range(-(-bits // WORD)):
        size = min(WORD, bits - word * WORD)
        m = min(size, max(1, -(-size // MOST_WIDTH), round(size / max(LEAST_WIDTH, log2(max(n, 2)) - 2))))
        edges = [size * i // m for i in range(m + 1)]
        out += [(word, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def values(code: str, cuts: list[tuple[int, int, int]]) -> Column:
    """(segment, value, width) of each segment of a code."""
    parts = [F.struct(F.lit(j).alias("segment"), F.shiftrightunsigned(F.get(code, F.lit(word)), at).bitwiseAND(F.lit((1 << width) - 1)).alias("value"), F.lit(width).alias("width")) for j, (word, at, width) in enumerate(cuts)]
    return F.explode(F.array(*parts))


def distance(a: Column, b: Column, words: int) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, words)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


class Index:
    """segment, value, chunk, entries; and the values that have several chunks."""

    def __init__(self, rows: DataFrame, cuts: list[tuple[int, int, int]], words: int):
        self.cuts, self.words = cuts, words
        flat = rows.select("id", "code", values("code", cuts).alias("s")).select("id", "code", "s.segment", "s.value")
        many = flat.groupBy("segment", "value").count().where(F.col("count") > CHUNK)
        self.hot = cut(many.select("segment", "value", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
        self.some_hot = not self.hot.isEmpty()
        dealt = self.dealt(flat, F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
        self.table = stored(dealt.groupBy("segment", "value", "chunk").agg(F.collect_list(F.struct("code", "id")).alias("entries")), "index")

    def dealt(self, rows: DataFrame, places: Column) -> DataFrame:
        """rows with the chunks they go to: those of `places` where a value has several, else chunk 0."""
        if not self.some_hot:
            return rows.withColumn("chunk", F.lit(0))
        return rows.join(self.hot, ["segment", "value"], "left").withColumn("chunk", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(places))).drop("chunks")

    def met(self, probes: DataFrame, k: int) -> DataFrame:
        """query, distance, id: of each chunk that a probe meets the k nearest codes that are not beyond the query's kth."""
        sent = self.dealt(probes.select("query", "kth", "segment", "value"), F.sequence(F.lit(0), F.col("chunks") - 1))
        far = F.transform("entries", lambda e: F.struct(distance(e["code"], F.col("query"), self.words).alias("distance"), e["id"].alias("id")))
        near = F.slice(F.array_sort(F.filter(far, lambda x: F.col("kth").isNull() | (x["distance"] <= F.col("kth")))), 1, k)
        return sent.join(self.table, ["segment", "value", "chunk"]).select("query", F.explode(near).alias("f")).select("query", "f.distance", "f.id")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k first of each query's distinct rows; equal rows share a rank, so the limit also holds before the shuffle."""
    placed = found.withColumn("place", F.dense_rank().over(W.partitionBy("query").orderBy("distance", "id")))
    return placed.where(F.col("place") <= k).drop("place").distinct()


def nearest(rows: DataFrame, queries: DataFrame, k: int, bits: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(query, distance, id) of the k nearest rows of each distinct query code, and its proof: radius, covered, kth distance."""
    words, cuts = -(-bits // WORD), segments(bits, n)
    index, m, widest = Index(rows, cuts, words), len(cuts), max(w for _, _, w in cuts)
    frontier = queries.select(F.col("code").alias("query"), values("code", cuts).alias("s")).select("query", "s.*", F.lit(0).alias("bit"))
    waiting = queries.select(F.col("code").alias("query"), F.lit(None).cast("int").alias("kth"))
    found, proofs = None, None
    for radius in range(widest + 1):
        needed = F.col("kth").isNull() | (F.col("segment") <= F.col("kth") - m * radius)
        frontier = cut(frontier.join(waiting, "query"))
        met = index.met(frontier.where(needed), k)
        last, found = found, cut(best(met if found is None else found.unionByName(met), k))
        discard(last, *([held_frontier] if radius else []))
        held_frontier = frontier
        held = found.groupBy("query").agg(F.count("*").alias("held"), F.max("distance").alias("far"))
        state = waiting.select("query", F.col("kth").alias("before")).join(held, "query", "left")
        covered = F.when(F.lit(radius == widest), bits).when(F.col("before").isNull(), m * (radius + 1) - 1).otherwise(F.least(F.col("before"), F.lit(m * (radius + 1) - 1)))
        state = cut(state.select("query", F.when(F.col("held") >= k, F.col("far")).alias("kth"), covered.alias("covered")))
        proven = (F.col("covered") == bits) | F.coalesce(F.col("kth") <= F.col("covered"), F.lit(False))
        now = state.where(proven).withColumn("radius", F.lit(radius))
        proofs = now if proofs is None else proofs.unionByName(now)
        waiting = state.where(~proven).select("query", "kth")
        if radius == widest or waiting.isEmpty():
            break
        grown = frontier.drop("kth").where(F.col("bit") < F.col("width")).withColumn("flip", F.explode(F.sequence(F.col("bit"), F.col("width") - 1)))
        frontier = grown.select("query", "segment", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, flip)")).alias("value"), "width", (F.col("flip") + 1).alias("bit"))
    return found, proofs.select("query", "radius", "covered", "kth")


def proven_search(vectors: DataFrame, k: int = 10, bits: int = 64, vec_id: str = "vec_id", vector: str = "embedding", query_every: int = 100) -> tuple[DataFrame, DataFrame]:
    """search(), and for each distinct query code what proves its answer: the last radius, the distance it covers, the kth distance."""
    rows = cut(codes(vectors, vec_id, vector, bits).distinct())
    first = cut(rows.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("place") <= k + 1).drop("place"))
    asked = rows.where(F.col("id") % query_every == 0)
    # a query's own row may be among the first, so one more is asked for
    found, proofs = nearest(first, cut(asked.select("code").distinct()), k + 1, bits, first.select("code").distinct().count())
    near = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k + 1 rows a query
    # a code that many queries share is answered once, and its list goes to each by a join split over salts
    salts = asked.groupBy("code").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"))
    lists = near.join(salts, F.col("query") == F.col("code")).drop("query").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    each = asked.join(salts, "code").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).join(lists, ["code", "salt"])
    others = each.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("place", "f"))
    return others.select(F.col("id").alias("query_id"), (F.col("place") + 1).alias("rank"), F.col("f.id").alias("neighbor_id"), F.col("f.distance").cast("int").alias("distance")), proofs


def search(vectors: DataFrame, k: int = 10, bits: int = 64, vec_id: str = "vec_id", vector: str = "embedding", query_every: int = 100) -> DataFrame:
    """query_id, rank, neighbor_id, distance: for each row whose id is divisible by query_every its k nearest other rows."""
    return proven_search(vectors, k, bits, vec_id, vector, query_every)[0]
