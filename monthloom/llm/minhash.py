"""Near-duplicate groups: banded MinHash, sequential Bayesian verification, exact confirmation, components.

1. A map over the texts gives each document its set size, a 128-bit digest of its set of word shingles, and a signature
   of bands * rows minima. Equal sets form a class, with a number of its own and the smallest doc_id as its representative; only
   classes go on, so a group of copies is one row however many rows it has.
2. Each band of a signature is a bucket key. Buckets of two or more give candidates: first each member with the bucket's
   smallest class (a star, linear in the bucket), whatever the bucket's size.
3. A candidate's signatures are compared batch by batch. With m of n values equal and a uniform prior the similarity has
   a Beta(m + 1, n - m + 1) posterior; the pair is pruned once P(similarity >= threshold) is below `miss`.
4. Survivors are confirmed on the full sets of words, and components found.
5. Buckets whose members are still in several components have their pairs across components compared the same way, in
   blocks of bounded size inside numpy, likeliest first, and confirmed on the words. Pairs within one component need no
   comparison, as a further link would change nothing; so a bucket's largest component is dealt against the others only.

Keys that hold many rows (a set with many copies, a lead, a bucket) are salted in every join (common.joined).

At 27 bands of 5 rows a pair with similarity 0.85 fails to share a bucket with probability 2e-7 (2e-5 at 0.8).

Cases: a text that is null or has no words has an empty set, is linked with nothing and kept. Fewer words than a shingle:
the whole sequence is the one shingle. Rows that repeat a doc_id give one row (its largest set; linked as any of them).
Two sets count as equal when the 128-bit digests of their shingles' 64-bit hashes are; all other links are confirmed on words.
Rows with a null doc_id give one row with a null component, kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, Memo, cut, discard, joined, map_batches, mix64, raw_texts, stored
from .graph import components

KEPT_WORDS, CHUNK, BLOCK = 500_000, 1 << 15, 256
#: Shingles of a usual text, and the hashes that a block's comparison holds at once.
LONG, HELD = 2000, 4_000_000
_words = Memo(xxhash.xxh3_64_intdigest, KEPT_WORDS)


@dataclass(frozen=True)
class Rule:
    """Two documents are linked when 100 * intersection >= percent * union of their shingle sets."""

    words: int = 5
    percent: int = 80
    bands: int = 27
    rows: int = 5
    batch: int = 27
    miss: float = 1e-7
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_hashes(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = raw.lower().split()  # bytes: only A-Z change, and only the six ASCII white-space bytes split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


def digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def minima(sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """A signature for each non-empty set; hash functions are xor and odd multiplication on 32 bits."""
    rng = np.random.default_rng(rule.seed)
    xor, odd = rng.integers(0, 1 << 32, rule.hashes, dtype=np.uint32), rng.integers(0, 1 << 32, rule.hashes, dtype=np.uint32) | np.uint32(1)
    out = np.empty((len(sets), rule.hashes), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= CHUNK):
            n += len(sets[hi])
            hi += 1
        h = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        start = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo : hi - 1]])]).astype(np.int64)
        room = np.empty_like(h)
        for k in range(rule.hashes):
            np.bitwise_xor(h, xor[k], out=room)
            np.multiply(room, odd[k], out=room)
            out[lo:hi, k] = np.minimum.reduceat(room, start)
        lo = hi
    return out


def signatures(docs: DataFrame, rule: Rule, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, digest (null: empty set), signature."""

    def run(batches):
        for b in batches:
            sets = [shingle_hashes(x, rule.words) for x in raw_texts(b)]
            full = [s for s in sets if len(s)]
            rows = iter(minima(full, rule) if full else ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_shingles long, digest binary, signature binary")


def band_keys(sig: np.ndarray, rule: Rule) -> np.ndarray:
    """A 64-bit bucket key for each band of each signature."""
    parts = sig.reshape(len(sig), rule.bands, rule.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, rule.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rule.rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def banded(classes: DataFrame, rule: Rule) -> DataFrame:
    """key, band, cls, rep for every band of every class."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(len(b), -1)
            keys = band_keys(sig, rule)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(rule.bands, dtype=np.int32), len(b))), *(pa.array(np.repeat(b.column(c).to_numpy(), rule.bands)) for c in ("cls", "rep"))], ["key", "band", "cls", "rep"])

    return map_batches(classes.select("cls", "rep", "signature"), run, "key long, band int, cls long, rep long")


def least_matches(rule: Rule) -> list[tuple[int, int]]:
    """For each batch end n the smallest m whose posterior P(similarity >= threshold | m of n equal) is at least `miss`.

    For a uniform prior that probability is P(Binomial(n + 1, threshold) <= m).
    """
    t, out = rule.percent / 100, []
    for n in [*range(rule.batch, rule.hashes, rule.batch), rule.hashes]:
        tail, m = 0.0, -1
        while tail < rule.miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def not_pruned(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Which rows of two aligned signature arrays stay; each batch looks only at rows that the ones before left."""
    left, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in least_matches(rule):
        equal = equal + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        stay = equal >= m
        left, equal, done = left[stay], equal[stay], n
    return left


def survivors(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """a, b, da, db: the representatives and digests of the pairs of classes (x, y) that the posterior bound does not prune."""
    sig = classes.select("cls", "digest", "signature")
    lead = pairs.groupBy("x").agg(F.count("*").alias("n"))
    wide = joined(pairs.join(sig.toDF("y", "db", "sb"), "y"), sig.toDF("x", "da", "sa"), "x", ["y"], counts=lead)

    def run(batches):
        for x in batches:
            if len(x):
                sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32).reshape(len(x), -1) for c in ("sa", "sb"))
                keep = pa.array(not_pruned(sa, sb, rule))
                yield pa.RecordBatch.from_arrays([x.column(c).take(keep) for c in ("a", "b", "da", "db")], ["a", "b", "da", "db"])

    return map_batches(wide.select("a", "b", "da", "db", "sa", "sb"), run, "a long, b long, da binary, db binary")


def grouped(batches, keys: int):
    """Row lists of a stream sorted by its first `keys` columns, one for each value; a group is held whole, batches are not."""
    held, now = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:keys] != now:
                yield now, held
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, held


def bodies(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """digest, body (compressed text) of the sets of the documents with these ids. Other texts do not leave the scan but by chance."""
    wanted = KeyFilter.of(ids)

    def read(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            keys = b.column("id").fill_null(-1).to_numpy()
            at = pa.array(np.flatnonzero(wanted.test(keys.view(np.uint64))))
            raws = raw_texts(pa.RecordBatch.from_arrays([b.column("text").take(at)], ["text"]))
            yield pa.RecordBatch.from_arrays([pa.array([digest(shingle_hashes(x, rule.words)) for x in raws], pa.binary()), pa.array([pack(x) for x in raws], pa.binary())], ["digest", "body"])

    return map_batches(docs.select(F.col("doc_id").alias("id"), "text"), read, "digest binary, body binary").dropDuplicates(["digest"])


def dealt_blocks(members: DataFrame) -> DataFrame:
    """members (key, cls, rep, component, n_shingles, ...) with (i, j, block): the pairs of blocks in which each is compared.

    A bucket's largest component is compared with the others but not with itself. Blocks have about BLOCK rows and about
    BLOCK * LONG shingles, so long texts make small blocks.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("long"))
    whole = parts.groupBy("key").agg(F.max_by(F.struct("component", "k", "long"), F.struct("k", "component")).alias("top"), F.sum("k").alias("n"), F.sum("long").alias("long"))
    of = lambda k, long: F.ceil(F.greatest(k, long / LONG) / BLOCK).cast("int")
    sides = whole.select("key", "n", F.col("top.component").alias("main"), of(F.col("n") - F.col("top.k"), F.col("long") - F.col("top.long")).alias("few"), of(F.col("top.k"), F.col("top.long")).alias("many"))
    sides = cut(sides)
    rows = joined(members, sides.drop("n"), "key", ["cls"], counts=sides)
    rest, at = F.col("component") != F.col("main"), F.xxhash64("cls")
    rows = rows.withColumn("block", F.when(rest, F.pmod(at, F.col("few"))).otherwise(F.col("few") + F.pmod(at, F.col("many"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(rest, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "main", "few", "many")


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links across components of buckets (key, band, cls, rep, component), found in blocks.

    A link joins its components within the block, so a block gives fewer links than it has rows, and a document is
    compared no more with those it is already joined to. Sets are compared by hashes, and a link is confirmed on its words.
    """
    blocks = dealt_blocks(joined(members, classes.select("cls", "digest", "n_shingles"), "cls", ["key"]))
    whole = classes.select("digest", "signature").join(bodies(docs, members.select("rep").distinct(), rule), "digest")
    wide = joined(blocks.select("key", "i", "j", "block", "rep", "component", "band", "digest"), whole, "digest", ["key", "i", "j"]).select("key", "i", "j", "block", "rep", "component", "band", "signature", "body")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for (_, i, j), rows in grouped(batches, 3):
            block, rep, part = (np.array([r[c] for r in rows], np.int64) for c in range(3))
            band, sig = rows[0][3], np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), -1)
            bands, sets, links, room = sig.reshape(len(rows), rule.bands, rule.rows), OrderedDict(), [], 0

            def full(x):
                nonlocal room
                if x not in sets:
                    sets[x] = shingle_hashes(unpack(rows[x][5]), rule.words)
                    room += len(sets[x])
                    while room > HELD and len(sets) > 2:
                        room -= len(sets.popitem(last=False)[1])
                return sets[x]

            for x in range(len(rows)):
                # each pair once: within a block the later rows, across blocks those of the other
                ys = np.arange(x + 1, len(rows)) if i == j else np.flatnonzero(block == j) if block[x] == i else np.zeros(0, np.int64)
                ys = ys[part[ys] != part[x]]
                if band and len(ys):  # a pair that shares an earlier band is compared there
                    ys = ys[~(bands[ys, :band] == bands[x, :band]).all(axis=2).any(axis=1)]
                if len(ys):
                    ys = ys[not_pruned(np.broadcast_to(sig[x], (len(ys), sig.shape[1])), sig[ys], rule)]
                for y in ys[np.argsort(-(sig[ys] == sig[x]).sum(axis=1), kind="stable")].tolist():
                    if part[x] != part[y]:
                        p, q = full(x), full(y)
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        if 100 * both >= rule.percent * (len(p) + len(q) - both) and similar(shingle_set(unpack(rows[x][5]), rule.words), shingle_set(unpack(rows[y][5]), rule.words), rule):
                            links.append((rep[x], rep[y]))
                            part[part == part[y]] = part[x]
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return map_batches(wide.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long")


def shingle_set(raw: bytes, n: int) -> set:
    words = raw.lower().split()
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def similar(p: set, q: set, rule: Rule) -> bool:
    both = len(p & q)
    return 100 * both >= rule.percent * (len(p) + len(q) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets (da, db) are linked by their full sets of words. Only texts that occur in a pair leave the scan."""
    pairs = cut(pairs.distinct())
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = bodies(docs, ids, rule)
    wide = joined(pairs.join(texts.toDF("db", "bb"), "db"), texts.toDF("da", "ba"), "da", ["db"], counts=pairs.groupBy("da").agg(F.count("*").alias("n")))

    def run(batches):
        unpack, near = zstandard.ZstdDecompressor().decompress, OrderedDict()

        def whole(key, body):
            if key not in near:
                near[key] = shingle_set(unpack(body), rule.words)
                if len(near) > 64:
                    near.popitem(last=False)
            return near[key]

        for x in batches:
            a, b = x.column("da").to_pylist(), x.column("db").to_pylist()
            keep = []
            for k, (i, j, bi, bj) in enumerate(zip(a, b, x.column("ba").to_pylist(), x.column("bb").to_pylist(), strict=True)):
                if similar(whole(i, bi), whole(j, bj), rule):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("a").take(at), x.column("b").take(at)], ["a", "b"])

    return map_batches(wide.select("a", "b", "da", "db", "ba", "bb"), run, "a long, b long")


def groups(docs: DataFrame, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each doc_id."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(signatures(docs, rule), "signatures")
    real = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # a set has one signature; several classes may have one rep, as an id may have rows of different texts
    by_set = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    classes = stored(by_set.withColumn("cls", F.monotonically_increasing_id()), "classes")
    keys = banded(classes, rule)
    buckets = cut(keys.groupBy("key").agg(F.min("cls").alias("lead"), F.min_by("rep", "cls").alias("lead_rep"), F.count("*").alias("n")).where(F.col("n") > 1))
    members = stored(joined(keys, buckets, "key", ["cls"], counts=buckets), "members")
    stars = cut(members.where(F.col("rep") != F.col("lead_rep")).select(F.col("lead").alias("x"), F.col("cls").alias("y"), F.col("lead_rep").alias("a"), F.col("rep").alias("b")).distinct())
    # a doc_id with rows of different texts is itself a link between their classes
    texts = real.select("doc_id", "digest").distinct()
    several = texts.join(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "doc_id")
    same = several.join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    links = cut(confirmed(survivors(stars, classes, rule), docs, rule).unionByName(same))
    first = cut(components(links))
    parted = members.where("n > 2").select("key", "band", "cls", "rep").join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = cut(parted.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("key", "n"))
    if not open_keys.isEmpty():
        rest = cut(across(cut(joined(parted, open_keys.select("key"), "key", ["cls"], counts=open_keys)), classes, docs, rule))
        if not rest.isEmpty():
            first = cut(components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest)))
    discard(buckets, members, stars, links)
    labels = classes.select("rep", "digest").join(first.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = joined(rows.select("doc_id", "n_shingles", "digest"), labels, "digest", ["doc_id"], "left", counts=classes.select("digest", "n")).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    return named.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OWN = "__minhash_"


def one_of_each(docs: DataFrame, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs for each document that is the first of its group; of rows that repeat its id, the first by their hash.

    Rows without an id are no document's copies by id and stay. All columns stay.
    """
    key = OWN + "id"
    gone = groups(docs, rule, text, doc_id).where("NOT kept").select(F.col("doc_id").alias(key))
    rows = docs.withColumn(key, F.col(doc_id).cast("long"))
    again = cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
    if not again.isEmpty():  # combined before the shuffle, so an id may have any share of the rows
        marked = joined(rows, again.select(key, F.lit(True).alias(OWN + "again")), key, [doc_id, text], "left", counts=again)
        plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
        once = marked.where(OWN + "again").groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*plain)).alias(OWN + "row")).select(OWN + "row.*", key)
        rows = marked.where(F.col(OWN + "again").isNull()).select(*docs.columns, key).unionByName(once)
    return rows.join(gone, key, "left_anti").select(*docs.columns)
