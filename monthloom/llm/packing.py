"""Packing along a space-filling curve.

A document's token ids are hashed, and each hash is a row of DIMENSIONS uniform numbers: a random projection of the
document's hashed bag of tokens. Their mean, scaled, is squeezed to a grid of 2 ** GRID cells a side, and the cell's place
on the Hilbert curve is the document's key. The curve is cut into stretches of about STRETCH bytes of ids (more beyond STRETCHES of them). A stretch's documents
are sorted by key (ties by a hash of the id, so that a group of copies splits over stretches) and laid end to end; every
1024 tokens are a sequence. What is left at the end of a stretch is laid into sequences whose lengths are powers of two,
so nothing is padded.

Where the curve is cut is decided once, from the stored keys: documents picked by a hash of their key, about PICKED a stretch,
and every (key, hash of id) with a large share of the bytes. The cuts are numbers in the plan, so each action, retry and
session deals the same rows to the same stretch, and a piece depends on its stretch alone, however stretches are dealt to tasks.

Scale: texts become packed ids once, stored in the shared folder; one shuffle moves them; a stretch is packed in one pass
that holds one document and one sequence at a time. Their number follows from the stored bytes. Sequence ids are a stretch's
number and a count, so stretches need not know of each other. The driver gets the picked keys, a bounded number a stretch.

Cases: null and empty texts are the closing id 0 alone. Repeated rows (as after mixing) are packed each, with equal
doc_ids; (sequence_id, offset) tells their pieces apart; where rows of one id fill more than a stretch, they are split by a hash of
the row's number in the stored table. A null id stays null. Very long documents take many sequences. Bytes that are not UTF-8 are
read as U+FFFD, as Spark shows them. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .common import map_batches, mix64, raw_texts, stored

LENGTH, CLOSING = 1024, 0
STRETCH, STRETCHES, PICKED = 8 << 20, 1 << 15, 100
DIMENSIONS, GRID, SPREAD = 4, 15, 6.0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dimensions), as int64; bits * dimensions is at most 62.

    The coordinates are turned to the transposed index from the top bit down (exchange or reflect the lower bits by each
    coordinate's bit), Gray-decoded, and their bits interleaved.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            high = (x[:, d] >> b) & 1 == 1
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> b) & 1
    return out


#: Fixed value: the splitting pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids as the tokenizers library gives them, and projections of documents' hashed vectors of ids.

    A vocabulary whose merges make ids in rising order can be run by tiktoken, which is four times as fast; texts with
    characters outside bytebpe's compared ranges, and other vocabularies, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocab, self.library, self.fast = bytebpe.load(path), Tokenizer.from_file(path), None
        self.library.no_truncation()
        self.library.no_padding()
        made = self.vocab.merged
        if all(a < b for a, b in zip(made, made[1:], strict=False)) and max(self.vocab.of_byte) < made[0]:
            import tiktoken

            back = {c: b for b, c in bytebpe.byte_letters().items()}
            ranks = {bytes(map(back.__getitem__, t)): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.vocab.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.vocab.special)
        n = self.library.get_vocab_size(with_added_tokens=True)
        self.at = mix64(np.arange(1, n + 1)).view(np.int16).reshape(n, DIMENSIONS) / np.float32(1 << 15)

    def ids(self, text: str) -> np.ndarray:
        """With the closing id."""
        if self.fast is not None and bytebpe.UNSAFE.search(text) is None:
            got = self.fast.encode_to_numpy(text, allowed_special="all")
        else:
            got = self.library.encode(text, add_special_tokens=False).ids
        return np.append(np.asarray(got, np.uint32), np.uint32(CLOSING))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and the mean projections of what comes before the closing ids."""
        ids = [self.ids(t) for t in texts]
        means = np.zeros((len(texts), DIMENSIONS))
        for k, x in enumerate(ids):
            if len(x) > 1:
                means[k] = self.at[x[:-1]].mean(axis=0)
        return ids, means


_encoders: dict[str, Encoder] = {}


def cell(mean: np.ndarray) -> np.ndarray:
    """Grid cells of mean projections (n, dimensions)."""
    z = mean * SPREAD
    return np.clip(((1 + z / np.sqrt(1 + z * z)) / 2 * (1 << GRID)).astype(np.int64), 0, (1 << GRID) - 1)


def max_id(vocabulary: str) -> int:
    vocab = bytebpe.load(vocabulary)
    return max([*vocab.merged, *vocab.of_byte, *vocab.special.values()])


def encoded(docs: DataFrame, vocabulary: str, text: str, doc_id: str) -> DataFrame:
    """doc_id, key, ids (little-endian, of 16 bits where the vocabulary allows)."""

    width = 2 if max_id(vocabulary) < 1 << 16 else 4

    def run(batches):
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        for b in batches:
            raws, ids, means = raw_texts(b), [], np.zeros((len(b), DIMENSIONS))
            for lo in range(0, len(raws), 64):
                some = raws[lo : lo + 64]
                got, means[lo : lo + len(some)] = encoder.encode([x.decode(errors="replace") for x in some])
                ids += [x.astype(f"<u{width}").tobytes() for x in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(hilbert(cell(means), GRID)), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, key long, ids binary")


class Pieces:
    """Rows of PIECES, given out in batches."""

    def __init__(self):
        self.rows = []

    def add(self, doc, start: int, ids: np.ndarray, whole: int, sequence: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, sequence, offset))

    def given(self, least: int):
        if len(self.rows) >= max(least, 1):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
            self.rows = []


class Stretch:
    """Lays one stretch's documents end to end."""

    def __init__(self, number: int, out: Pieces):
        self.sequence, self.offset, self.held, self.out = number << 40, 0, [], out

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + LENGTH - self.offset]
            self.held.append((doc, start, part, len(ids)))
            start, self.offset = start + len(part), self.offset + len(part)
            if self.offset == LENGTH:
                self.lay(LENGTH)

    def lay(self, room: int) -> None:
        """Fills a sequence of so many tokens from what is held."""
        at = 0
        while at < room:
            doc, start, ids, whole = self.held.pop(0)
            now = ids[: room - at]
            self.out.add(doc, start, now, whole, self.sequence, at)
            at += len(now)
            if len(now) < len(ids):
                self.held.insert(0, (doc, start + len(now), ids[len(now) :], whole))
        self.sequence, self.offset = self.sequence + 1, self.offset - room

    def close(self) -> None:
        while self.offset:  # sequences of falling powers of two
            self.lay(1 << (self.offset.bit_length() - 1))


def laid(batches, width: int):
    """Pieces of the documents of whole stretches, in order."""
    out, stretch, now = Pieces(), None, None
    for b in batches:
        for number, doc, raw in zip(*(b.column(c).to_pylist() for c in ("stretch", "doc_id", "ids")), strict=True):
            if number != now:
                if stretch is not None:
                    stretch.close()
                stretch, now = Stretch(number, out), number
            stretch.add(doc, np.frombuffer(raw, f"<u{width}"))
            yield from out.given(10_000)
    if stretch is not None:
        stretch.close()
    yield from out.given(1)


def curve_cuts(rows: DataFrame, stretch: int, picked: int) -> list[tuple[int, int, int]]:
    """(key, tie, mark) at which stretches end, from rows (key, tie, bytes): about so many bytes each."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    stretch = max(stretch, -(-total.b // STRETCHES))
    n = max(1, -(-total.b // stretch))
    if n == 1:
        return []
    rate = min(1.0, picked * n / total.n)
    by = rows.groupBy("key", "tie").agg(F.sum("bytes").alias("b"))
    large = F.col("b") > stretch / 8  # fewer than 8 a stretch
    low = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 20)) < int(rate * (1 << 20))
    got = sorted((r.key, r.tie, r.b if r.large else r.b / rate) for r in by.where(large | low).select("key", "tie", "b", large.alias("large")).collect())
    step, done, cuts = sum(b for _, _, b in got) / n, 0.0, []
    for key, tie, b in got:
        while len(cuts) < n - 1 and done + b >= step * (len(cuts) + 1):
            share = (step * (len(cuts) + 1) - done) / b
            cuts.append((key, tie, int(share * (1 << 62)) if b > step / 8 else 0))
        done += b
    return cuts


def stretch_of(cuts: list[tuple[int, int, int]]):
    """The number of cuts at or before a row's (key, tie, mark), by halving."""
    if not cuts:
        return F.lit(0)
    keys, ties, marks = (F.lit(np.array(x, np.int64)) for x in zip(*cuts, strict=True))

    def halved(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        k, t, m = (F.get(x, mid) for x in (keys, ties, marks))
        past = (k < F.col("key")) | (k == F.col("key")) & ((t < F.col("tie")) | (t == F.col("tie")) & (m <= F.col("mark")))
        more = a["lo"] < a["hi"]
        return F.struct(F.when(more & past, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(more & ~past, mid).otherwise(a["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halved, lambda a: a["lo"])


def pack(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", stretch: int = STRETCH) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    coded = encoded(docs, vocabulary, text, doc_id).select("doc_id", "key", "ids", F.xxhash64("doc_id").alias("tie"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 62)).alias("mark"), F.length("ids").cast("long").alias("bytes"))
    rows = stored(coded, "encoded")
    cuts = curve_cuts(rows.select("key", "tie", "bytes"), stretch, PICKED)
    dealt = rows.select("doc_id", "key", "tie", "ids", stretch_of(cuts).alias("stretch")).repartitionById(len(cuts) + 1, F.col("stretch"))
    ordered = dealt.sortWithinPartitions("stretch", "key", "tie", "doc_id", "ids").select("stretch", "doc_id", "ids")
    return map_batches(ordered, partial(laid, width=2 if max_id(vocabulary) < 1 << 16 else 4), PIECES)
