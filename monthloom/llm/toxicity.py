"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings of 3 to 6 letters, hashed. A score is sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over
the distinct terms of a whole text, so a pair of terms, such as an insult with a group's name, has a weight of its own.

Learning: at most SAMPLE labelled rows, the first by a hash of the id. On them each hashed term's presence is counted by class.
Terms come in for what they tell alone, the FEATURES with the largest gap between the classes, and for what they tell together:
of the SCREENED terms that vary most between documents, the pairs whose joint presence departs from what the two tell alone,
PAIRS of them at most. So an interaction of terms that are as common in either class is learned too. Other terms share
bucket 0 weight: none. The machine is fitted by AdaGrad on the logistic loss. All that is gathered on the driver is bounded by these.

Scale: the sample's ids are broadcast (at most SAMPLE longs); texts are never shuffled. Scoring is a map over the scan.

Cases: null and empty texts have no terms and get the score of w0. Labels that repeat an id count once, the toxic one
first; rows without a toxic label or id don't teach; an id with several texts teaches by one of them, the least by its terms. Without labelled rows, or with one class only, the score is that
class's share (0 without any). Repeated rows give repeated rows. A null id is not held out. Other columns are not read
by scoring and stay in filtering.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, fold, map_batches, raw_texts
from .licenses import words_of

SAMPLE, FEATURES, SCREENED, PAIRS, BUCKETS, FACTORS = 24_000, 1024, 1024, 256, 1 << 20, 8
BEGINNINGS = (3, 4, 5, 6)
KEPT_WORDS = 400_000


def terms(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings. A cut may fall into a letter of several bytes, the same way for every word."""
    return [xxhash.xxh32_intdigest(word) % BUCKETS, *(xxhash.xxh32_intdigest(word[:n], seed=n) % BUCKETS for n in BEGINNINGS if len(word) >= n)]


_all_terms = Memo(terms, KEPT_WORDS // 4)


@dataclass
class Machine:
    """bucket -> feature, and the weights by feature."""

    features: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, present: list[set[int]]) -> np.ndarray:
        out = np.full(len(present), self.w0)
        for k, s in enumerate(present):
            if s:
                at = np.fromiter(s, np.int64, len(s))
                v = self.v[at]
                out[k] += self.w[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    def present(self, raws: list[bytes], memo: Memo) -> list[set[int]]:
        get = memo.__getitem__
        return [set().union(*filter(None, map(get, set(words_of(x))))) for x in raws]

    def memo(self) -> Memo:
        of = self.features.get
        return Memo(lambda word: tuple(f for t in terms(word) if (f := of(t)) is not None), KEPT_WORDS)


def labelled_sample(labels: DataFrame, size: int, folds: int, held_out: int) -> DataFrame:
    """doc_id, toxic of at most `size` labelled documents outside the held-out fold."""
    seen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return seen.where(fold("doc_id", folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def telling(sample: DataFrame, features: int, screened: int) -> tuple[list[int], list[int]]:
    """The buckets whose presence differs most between the classes, and those that vary most; at least 4 documents hold each."""

    def run(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for toxic, raw in zip(b.column("toxic").to_pylist(), raw_texts(b), strict=True):
                found = set().union(*map(_all_terms.__getitem__, set(words_of(raw))))
                n[1 if toxic else 0, np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "clean", "toxic"])

    counts = map_batches(sample.select("toxic", "text"), run, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where("clean + toxic >= 4").withColumn("n", F.col("clean") + F.col("toxic"))
    total = sample.agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(F.col("toxic") != 0, 1)).alias("toxic")).first()
    share = total.toxic / max(total.clean + total.toxic, 1)
    gap = F.abs(F.col("toxic") - share * F.col("n")) / F.sqrt("n")
    varied = F.abs(F.col("n") - (total.clean + total.toxic) / 2)
    first = [r.bucket for r in counts.orderBy(gap.desc(), "bucket").limit(features).collect()]
    return first, [r.bucket for r in counts.orderBy(varied, "bucket").limit(screened).collect()]


def renumbered(x: list[np.ndarray], terms: list[int]) -> list[np.ndarray]:
    """Each row's terms as places in `terms`; others are left out."""
    place = np.full(max([0, *terms, *(int(s.max()) for s in x if len(s))]) + 1, -1, np.int32)
    place[terms] = np.arange(len(terms))
    return [(at := place[s])[at >= 0] for s in x]


def together(x: list[np.ndarray], y: np.ndarray, terms: list[int], pairs: int, least: int = 8, far: float = 4.5) -> list[int]:
    """The terms of the `pairs` pairs that are farthest, in deviations, from what their two terms tell alone; at least `least` rows hold both."""
    if not len(y) or not terms:
        return []
    r = (y - y.mean()).astype(np.float32)
    both, told = np.zeros((len(terms), len(terms)), np.float32), np.zeros((len(terms), len(terms)), np.float32)
    for lo in range(0, len(x), 1024):
        dense = np.zeros((len(x[lo : lo + 1024]), len(terms)), np.float32)
        for k, s in enumerate(renumbered(x[lo : lo + 1024], terms)):
            dense[k, s] = 1
        both += dense.T @ dense
        told += dense.T @ (dense * r[lo : lo + 1024, None])
    alone = told.diagonal() / np.maximum(both.diagonal(), 1)
    z = np.abs(told - both * (alone[:, None] + alone[None, :])) / np.sqrt(np.maximum(both, 1) * max(float((r**2).mean()), 1e-9))
    z[(both < least) | np.tri(len(terms), dtype=bool)] = 0
    z[both > 0.95 * np.minimum(both.diagonal()[:, None], both.diagonal()[None, :])] = 0  # a word and its beginning
    top = np.argsort(-z, axis=None, kind="stable")[:pairs]
    return list(dict.fromkeys(terms[i] for at in top[z.ravel()[top] > far].tolist() for i in divmod(at, len(terms))))


def fitted(x: list[np.ndarray], y: np.ndarray, features: dict[int, int], updates: int = 3000, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss over shuffled batches, about `updates` of them; x: features present in each row."""
    rng, d = np.random.default_rng(seed), max(len(features), 1)
    share = (y.sum() + 1e-9) / (len(y) + 1e-9) if len(y) else 0.0
    machine = Machine(features, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(d), rng.normal(0, 0.01, (d, FACTORS)))
    if not len(y) or share in (0.0, 1.0) or y.min() == y.max():
        machine.v[:] = 0
        return machine
    g0, gw, gv = 1e-8, np.full(d, 1e-8), np.full((d, FACTORS), 1e-8)
    size = 128
    for _ in range(-(-updates // -(-len(y) // size))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), size):
            rows = order[lo : lo + size]
            dense = np.zeros((len(rows), d))
            for k, r in enumerate(rows):
                dense[k, x[r]] = 1
            xv = dense @ machine.v
            z = machine.w0 + dense @ machine.w + 0.5 * ((xv**2).sum(axis=1) - dense @ (machine.v**2).sum(axis=1))
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) / len(rows)
            d0, dw = e.sum(), dense.T @ e + decay * machine.w
            dv = dense.T @ (e[:, None] * xv) - machine.v * (dense.T @ e)[:, None] + decay * machine.v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            machine.w0 -= rate * d0 / np.sqrt(g0)
            machine.w -= rate * dw / np.sqrt(gw)
            machine.v -= 0.2 * rate * dv / np.sqrt(gv)
    return machine


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, folds: int = 4, held_out: int = 2) -> Machine:
    chosen = labelled_sample(labels, sample, folds, held_out)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    first, varied = telling(rows, FEATURES, SCREENED)
    screen = Machine({t: i for i, t in enumerate(dict.fromkeys([*first, *varied]))}, 0.0, np.zeros(0), np.zeros((0, FACTORS)))

    def run(batches):
        memo = screen.memo()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic").cast(pa.int32()), pa.array([np.array(sorted(s), "<u2").tobytes() for s in screen.present(raw_texts(b), memo)], pa.binary())], ["doc_id", "toxic", "present"])

    # at most `sample` rows; of rows that repeat an id the one whose terms come first
    got = map_batches(rows.select("doc_id", "toxic", "text"), run, "doc_id long, toxic int, present binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("present").alias("present"))
    found = sorted((r.doc_id, 1.0 if r.toxic else 0.0, bytes(r.present)) for r in got.toLocalIterator())
    x, y = [np.frombuffer(p, "<u2") for *_, p in found], np.array([t for _, t, _ in found])
    place = screen.features
    kept = list(dict.fromkeys([*(place[t] for t in first), *together(x, y, [place[t] for t in varied], PAIRS)]))
    bucket = list(place)
    return fitted(renumbered(x, kept), y, {bucket[f]: i for i, f in enumerate(kept)})


def scores(docs: DataFrame, machine: Machine, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id", folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches):
        memo = machine.memo()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(machine.score(machine.present(raw_texts(b), memo)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(fold(doc_id, folds) == held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""

    def run(batches):
        memo = machine.memo()
        for b in batches:
            yield b.filter(pa.array(machine.score(machine.present(raw_texts(b, text), memo)) < threshold))

    return map_batches(docs, run, docs.schema)
