"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Tokens are the words of a lower-cased text and one end token. Counting:

1. A map over the training texts counts words (64-bit hashes) and distinct bigrams (two 40-bit hashes) in memory-bounded
   rounds, and deals them as sorted byte blocks: words by the word's top bits, bigrams by the top bits of the
   bigram's own hash, so that no frequent word or context makes a large shard.
2. Each bigram shard is summed up, written to the shared folder as sorted hash array and counts, and gives for its
   words partial statistics: continuation counts and the numbers of bigrams seen once, twice, or more after a context.
3. Each word shard sums those up with the exact word counts and is written as sorted arrays as well.

Discounts D1, D2, D3+ come from counts of counts, which is all that reaches the driver. With c the counts, and N1+ the numbers
of distinct bigrams: p(w|v) = max(c(vw) - D, 0) / c(v) + g(v) * p(w), p(w) likewise from continuation
counts N1+(.w) and, below, 1 / (V + 1). An unseen context backs off to p(w).

Scoring is a map over all texts: a batch's distinct bigrams and words are looked up in the memory-mapped shards by
binary search, sorted first, so that pages are read in order. Shards in a store without local paths are read whole when first
asked for, and a worker keeps at most HELD bytes of them.

Scale: what is shuffled is packed (about 9 bytes for each distinct bigram of a task). The number of shards is a power of two that
follows from the characters of the training texts, SHARD of them each (up to 65,536 shards; beyond 500 GB they grow). All training texts are counted, none is sampled and no n-gram dropped.

Cases: null and empty texts are the end token alone. Without training rows N = V = 0: the base is log10(1) a token and
the model 1 / (V + 1) a token. Rows with a null id train and are not held out. Repeated rows count each time. Other
columns are not read.
"""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fold, map_batches, mix64, raw_texts, scratch, stored

START, END = 0x5354415254 << 24, 0x454E44 << 40  # cannot be told from a word's hash, but no word is likely to have them
SMALL = np.uint64(24)  # a word's hash in bigrams is its upper 40 bits
ROUND, KEPT_WORDS = 2_500_000, 700_000
SHARD, MOST_BITS, HELD = 8 << 20, 16, 512 << 20
_words = Memo(xxhash.xxh3_64_intdigest, KEPT_WORDS)


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each text's end included, and the places after each end."""
    get, out, n = _words.__getitem__, [], np.empty(len(raws), np.int64)
    for k, raw in enumerate(raws):
        words = raw.lower().split()  # bytes: only A-Z change, and only the six ASCII white-space bytes split
        out.append(np.fromiter(map(get, words), np.uint64, len(words)))
        out.append(np.array([END], np.uint64))
        n[k] = len(words) + 1
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(n)


def contexts(token: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each; a text's first has START."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    if len(ends):
        out[0] = START
        out[ends[:-1]] = START
    return out


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of a bigram of 40-bit word hashes."""
    return mix64((v + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ mix64(w + np.uint64(0x632BE59BD9B4E019)))


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values)


def small_ints(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, after that width."""
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def five_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def packed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpacked(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def shard_bounds(key: np.ndarray, bits: int) -> np.ndarray:
    """Places where each shard of a sorted array begins, and its end."""
    return np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def bigram_block(w: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted by w, each w once with its number of bigrams."""
    order = np.lexsort((v, w))
    w, v, n = w[order], v[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    return packed(five_bytes(w[start]), small_ints(np.diff(np.append(start, len(w)))), five_bytes(v), small_ints(n))


def bigrams_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, runs, v, n = unpacked(raw)
    return np.repeat(from_five(w), ints(runs)), from_five(v), ints(n)


class Round:
    """Counts of what one task has read since it last gave them out."""

    def __init__(self, bits: int):
        self.bits, self.words, self.pairs, self.texts = bits, [], [], 0

    def add(self, raws: list[bytes]) -> None:
        token, ends = tokens(raws)
        if not len(token):
            return
        self.words.append(summed(token, np.ones(len(token), np.int64)))
        w, v = token >> SMALL, contexts(token, ends) >> SMALL
        key, at = np.unique(bigram_key(v, w), return_inverse=True)
        first = np.empty(len(key), np.int64)
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        self.pairs.append((key, w[first], v[first], np.bincount(at, minlength=len(key))))

    def size(self) -> int:
        return sum(len(p[0]) for p in self.pairs)

    def rows(self):
        """(kind, shard, block)"""
        if not self.pairs:
            return
        word, n = summed(*(np.concatenate(x) for x in zip(*self.words, strict=True)))
        self.words = []
        bounds = shard_bounds(word, self.bits)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            at = slice(bounds[s], bounds[s + 1])
            yield 0, s, packed(word[at].astype("<u8").tobytes(), small_ints(n[at]))
        key, w, v, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        self.pairs = []
        order = np.argsort(key, kind="stable")
        key, w, v, n = key[order], w[order], v[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key, w, v = np.add.reduceat(n, start), key[start], w[start], v[start]
        bounds = shard_bounds(key, self.bits)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            at = slice(bounds[s], bounds[s + 1])
            yield 1, s, bigram_block(w[at], v[at], n[at])


def local_path(folder: str) -> str | None:
    """The path of a folder that can be opened as it is, else None."""
    scheme, _, rest = folder.partition("://") if "://" in folder else folder.partition(":") if folder.startswith("file:") else ("file", "", folder)
    return ("/" + rest.lstrip("/")) if scheme == "file" else None


def write_file(folder: str, name: str, body: bytes) -> None:
    """Whole or not at all, whichever attempt of a task is last."""
    if (path := local_path(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(body)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        f.write(body)
    where.move(part, f"{root}/{name}")


def mapped(folder: str, name: str) -> np.ndarray:
    """A written file as memory-mapped bytes; as bytes in memory where it has no local path."""
    if (path := local_path(folder)) is not None:
        at = f"{path}/{name}"
        return np.memmap(at, np.uint8, "r") if os.path.getsize(at) else np.zeros(0, np.uint8)
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def qualified(spark, folder: str) -> str:
    """A folder with its file system's scheme, so that Spark and the workers mean the same one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def file_of(*arrays: np.ndarray) -> bytes:
    """Number of entries, then each array aligned to 8 bytes."""
    out = io.BytesIO()
    out.write(len(arrays[0]).to_bytes(8, "little"))
    for a in arrays:
        out.write(a.tobytes())
        out.write(b"\0" * (-out.tell() % 8))
    return out.getvalue()


def arrays_of(raw: np.ndarray, *kinds: str) -> list[np.ndarray]:
    if not len(raw):
        return [np.zeros(0, k) for k in kinds]
    n, at, out = int(raw[:8].view("<u8")[0]), 8, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(raw[at : at + size].view(k))
        at += size + -size % 8
    return out


BIGRAM, WORD = ("<u8", "<u4"), ("<u8", "<i8", "<u4", "<f4")  # key, count; key, count, continuation count, mass left to lower order


class Table:
    """The shards of one kind, opened when first asked for."""

    def __init__(self, folder: str, kind: str, bits: int, present: frozenset[int], types: tuple[str, ...]):
        self.folder, self.kind, self.bits, self.present, self.types, self.open, self.held = folder, kind, bits, present, types, {}, 0

    def find(self, key: np.ndarray) -> list[np.ndarray]:
        """The values of sorted distinct keys; 0 for those that are missing."""
        out = [np.zeros(len(key), t) for t in self.types[1:]]
        bounds = shard_bounds(key, self.bits)
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            if s not in self.present:
                continue
            if s not in self.open:
                raw = mapped(self.folder, f"{self.kind}-{s}")
                if not isinstance(raw, np.memmap):
                    self.held += len(raw)
                    while self.held > HELD and self.open:
                        self.held -= sum(a.nbytes for a in self.open.pop(next(iter(self.open))))
                self.open[s] = arrays_of(raw, *self.types)
            keys, *values = self.open[s]
            asked = key[bounds[s] : bounds[s + 1]]
            at = np.searchsorted(keys, asked)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == asked)
            for o, v in zip(out, values, strict=True):
                o[bounds[s] + hit] = v[at[hit]]
        return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of entries that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too little to estimate from
    y = n1 / (n1 + 2 * n2)
    d1, d2, d3 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.01), 0.99), min(max(d2, 0.01), 1.99), min(max(d3, 0.01), 2.99)


class Model:
    """What a worker needs: where the shards are and the totals."""

    def __init__(self, folder: str, bits: int, shards: tuple[frozenset[int], frozenset[int]], total: int, words: int, texts: int, kinds: int, cd: tuple, kd: tuple, kmass: float, start_mass: float):
        self.folder, self.bits, self.shards, self.total, self.words, self.texts, self.kinds = folder, bits, shards, total, words, texts, kinds
        self.cd, self.kd, self.kmass, self.start_mass = cd, kd, kmass, start_mass
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self) -> tuple[Table, Table]:
        if self._tables is None:
            self._tables = Table(self.folder, "word", self.bits, self.shards[0], WORD), Table(self.folder, "bigram", self.bits, self.shards[1], BIGRAM)
        return self._tables

    def scores(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base, score of each text."""
        token, ends = tokens(raws)
        if not len(token):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float))
        word, at = np.unique(token, return_inverse=True)
        by_word, by_bigram = self.tables()
        count, cont, mass = (x[at] for x in by_word.find(word))
        v = contexts(token, ends)
        first = v == np.uint64(START)
        before = np.roll(count, 1)
        before[first] = self.texts
        left = np.roll(mass, 1).astype(float)
        left[first] = self.start_mass
        key, place = np.unique(bigram_key(v >> SMALL, token >> SMALL), return_inverse=True)
        both = by_bigram.find(key)[0][place].astype(np.int64)
        d, k = np.array([0.0, *self.cd]), np.array([0.0, *self.kd])
        low = np.full(len(token), 1 / (self.words + 1))
        if self.kinds:
            low = np.maximum(cont - k[np.minimum(cont, 3)], 0) / self.kinds + self.kmass / self.kinds / (self.words + 1)
        some = np.maximum(before, 1)
        p = np.where(before > 0, np.maximum(both - d[np.minimum(both, 3)], 0) / some + left / some * low, low)
        base = np.log10((count + 0.5) / (self.total + 0.5 * (self.words + 1)))
        start = np.concatenate([[0], ends[:-1]])
        return np.diff(ends, prepend=0), np.add.reduceat((count > 0).astype(np.int64), start), np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def fitted(docs: DataFrame) -> Model:
    """Counts docs (text) and writes the model to the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(max(4, (size // SHARD).bit_length()), MOST_BITS)
    folder = qualified(spark, scratch(spark, "kneser-ney"))

    def count(batches):
        held = Round(bits)
        texts = 0
        for b in batches:
            raws = raw_texts(b)
            texts += len(raws)
            for lo in range(0, len(raws), 256):
                held.add(raws[lo : lo + 256])
                if held.size() > ROUND:
                    yield from batch(held.rows())
        yield from batch(held.rows())
        yield from batch([(2, 0, texts.to_bytes(8, "little"))])

    def batch(rows):
        for kind, shard, block in rows:
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([block], pa.binary())], ["kind", "shard", "block"])

    shape = "kind int, shard int, block binary"
    dealt = map_batches(docs.select("text"), count, shape)

    def bigram_shard(key, table):
        kind, shard = key[0].as_py(), key[1].as_py()
        blocks = table.column("block").to_pylist()
        out = []
        if kind == 0:  # words stay packed until their statistics are known
            word, n = summed(*(np.concatenate(x) for x in zip(*((np.frombuffer(a, "<u8"), ints(b)) for a, b in map(unpacked, blocks)), strict=True)))
            out.append((0, shard, packed(word.tobytes(), small_ints(n))))
        elif kind == 2:
            out.append((2, 0, sum(int.from_bytes(b, "little") for b in blocks).to_bytes(8, "little")))
        else:
            w, v, n = (np.concatenate(x) for x in zip(*map(bigrams_of, blocks), strict=True))
            k = bigram_key(v, w)
            order = np.argsort(k, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], k[order][1:] != k[order][:-1]]))
            n, w, v, k = np.add.reduceat(n[order], start), w[order][start], v[order][start], k[order][start]
            write_file(folder, f"bigram-{shard}", file_of(k, np.minimum(n, (1 << 32) - 1).astype("<u4")))
            out.append((3, shard, np.array(counts_of_counts(n), "<i8").tobytes()))
            word = np.concatenate([w, v])
            one, zero = np.ones(len(w), np.int64), np.zeros(len(w), np.int64)
            word, *stats = summed(word, np.concatenate([one, zero]), *(np.concatenate([zero, (np.minimum(n, 3) == i).astype(np.int64)]) for i in (1, 2, 3)))
            bounds = shard_bounds(word << SMALL, bits)
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                at = slice(bounds[s], bounds[s + 1])
                out.append((4, s, packed(five_bytes(word[at]), *(small_ints(x[at]) for x in stats))))
        kinds, shards, bodies = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "shard": pa.array(shards, pa.int32()), "block": pa.array(bodies, pa.binary())})

    partial = stored(dealt.groupBy("kind", "shard").applyInArrow(bigram_shard, shape), "statistics")
    told = partial.where("kind IN (2, 3)").collect()  # two numbers for each shard at most
    texts = sum(int.from_bytes(r.block, "little") for r in told if r.kind == 2)
    pair_counts = sum((np.frombuffer(r.block, "<i8") for r in told if r.kind == 3), np.zeros(4, np.int64))
    cd = discounts(pair_counts.tolist())

    def word_shard(key, table):
        shard = key[0].as_py()
        kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
        exact = [unpacked(b) for k, b in zip(kinds, blocks, strict=True) if k == 0]
        word = np.concatenate([np.frombuffer(a, "<u8") for a, _ in exact]) if exact else np.zeros(0, np.uint64)
        n = np.concatenate([ints(b) for _, b in exact]) if exact else np.zeros(0, np.int64)
        rest = [unpacked(b) for k, b in zip(kinds, blocks, strict=True) if k == 4]
        small = np.concatenate([from_five(x[0]) for x in rest]) if rest else np.zeros(0, np.uint64)
        small, cont, *after = summed(small, *(np.concatenate([ints(x[i]) for x in rest]) if rest else np.zeros(0, np.int64) for i in range(1, 5)))
        mass = sum((a * d for a, d in zip(after, cd, strict=True)), np.zeros(len(small)))
        at = np.searchsorted(small, word >> SMALL)
        at[at == len(small)] = 0
        found = small[at] == word >> SMALL if len(small) else np.zeros(len(word), bool)
        if len(word):
            pick = lambda x: np.where(found, x[at], 0) if len(x) else np.zeros(len(word))
            write_file(folder, f"word-{shard}", file_of(word, n, pick(cont).astype("<u4"), pick(mass).astype("<f4")))
        start = small == np.uint64(START) >> SMALL
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(word)], "total": [int(n.sum())], "kinds": [int(cont.sum())], "coc": [counts_of_counts(cont)], "more": [int((cont > 2).sum())], "start_mass": [float(mass[start].sum())]})

    told_words = partial.where("kind IN (0, 4)").groupBy("shard").applyInArrow(word_shard, "shard int, words long, total long, kinds long, coc array<long>, more long, start_mass double").collect()  # a row for each shard
    coc = np.array([r.coc for r in told_words]).sum(axis=0).tolist() if told_words else [0] * 4
    kd = discounts(coc)
    kmass = kd[0] * coc[0] + kd[1] * coc[1] + kd[2] * sum(r.more for r in told_words)
    present = frozenset(r.shard for r in told_words if r.words), frozenset(r.shard for r in told if r.kind == 3)
    return Model(folder, bits, present, sum(r.total for r in told_words), sum(r.words for r in told_words), texts, sum(r.kinds for r in told_words), cd, kd, kmass, sum(r.start_mass for r in told_words))


def score(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""

    def run(batches):
        for b in batches:
            n, known, base, own = (np.concatenate(x) for x in zip(*(model.scores(raw_texts(b.slice(lo, 256))) for lo in range(0, max(len(b), 1), 256)), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(own), pa.array(10 ** np.minimum(-own / np.maximum(n, 1), 300))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold(doc_id, folds) == held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def trained_and_scored(docs: DataFrame, folds: int = 5, held_out: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    training = docs.where(F.coalesce(fold(doc_id, folds) != held_out, F.lit(True))).select(F.col(text).alias("text"))
    return score(docs, fitted(training), folds, held_out, text, doc_id)
