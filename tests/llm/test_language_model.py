"""The Kneser-Ney model against a plain version on words, and its edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from monthloom.llm import lm


def plain(rows, folds=5, held_out=1):
    """doc_id -> (n_tokens, n_known, N, base, score) from dictionaries of words."""
    texts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    train = [ws for i, ws in texts if i is None or zlib.crc32(str(i).encode()) % folds != held_out]
    c = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip(["<s>", *ws], ws, strict=False))
    total, v = sum(c.values()), len(c)
    cont, after, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), n in pairs.items():
        cont[b] += 1
        after[a][min(n, 3) - 1] += 1
        before[a] += n
    cd = lm.discounts([sum(n == i for n in pairs.values()) for i in (1, 2, 3, 4)])
    coc = [sum(n == i for n in cont.values()) for i in (1, 2, 3, 4)]
    kd, kinds = lm.discounts(coc), sum(cont.values())
    kmass = kd[0] * coc[0] + kd[1] * coc[1] + kd[2] * sum(n > 2 for n in cont.values())
    out = []
    for i, ws in texts:
        base = score = 0.0
        for a, b in zip(["<s>", *ws], ws, strict=False):
            base += math.log10((c[b] + 0.5) / (total + 0.5 * (v + 1)))
            low = 1 / (v + 1)
            if kinds:
                k = cont[b]
                low = max(k - (kd[min(k, 3) - 1] if k else 0), 0) / kinds + kmass / kinds / (v + 1)
            p = low
            if before[a]:
                n = pairs[a, b]
                p = max(n - (cd[min(n, 3) - 1] if n else 0), 0) / before[a] + sum(x * y for x, y in zip(after[a], cd, strict=True)) / before[a] * low
            score += math.log10(p)
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), total, base, score))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.trained_and_scored(docs).collect()), key=str)
    want = sorted(((x[0] is None, *x) for x in plain(rows)), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)
    return got


def test_against_plain_model_on_whole_table(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd_rows(spark):
    check(spark, [(0, None), (1, ""), (2, "A a\x0bA  x"), (3, "A a\x0bA  x"), (3, "a b c"), (None, "a b"), (7, "z " * 3000), (8, "a b c d"), (9, "É é")])


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.trained_and_scored(docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.trained_and_scored(spark.createDataFrame([(held, "a b", 1.0)], "doc_id long, text string, score double")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b b", "c a b d", "d d a b"]
    model = lm.fitted(spark.createDataFrame([(t,) for t in texts], "text string"))
    word = {w: lm.tokens([w.encode()])[0][0] for w in "abcd"}
    assert model.words == 5 and len(word) == 5 - 1
    # one word after 'a': the end, each known word, and the share of the one unknown
    first = 10 ** model.scores([b"a"])[3][0]  # p(a|<s>) p(end|a)
    single = {w: 10 ** (model.scores([f"a {w}".encode()])[3][0]) for w in ["a", "b", "c", "d", "zz"]}
    ends = {w: 10 ** (model.scores([w.encode()])[3][0]) for w in ["a"]}
    start = plain_start(model)
    assert start == pytest.approx(1, abs=1e-6)
    assert 0 < first < 1 and all(0 < p < 1 for p in (*single.values(), *ends.values()))


def plain_start(model):
    """Sum over a first word w of p(w|<s>), by dividing a two-token text's score by that of the rest."""
    import numpy as np

    from monthloom.llm.lm import END, SMALL, START, bigram_key

    by_word, by_bigram = model.tables()
    words = np.unique(np.concatenate([lm.tokens([b"a b c d zz"])[0]]))
    count, cont, _ = by_word.find(words)
    key = bigram_key(np.full(len(words), START, np.uint64) >> SMALL, words >> SMALL)
    order = np.argsort(key)
    both = np.empty(len(words), np.int64)
    both[order] = by_bigram.find(key[order])[0]
    d, k = np.array([0.0, *model.cd]), np.array([0.0, *model.kd])
    low = np.maximum(cont - k[np.minimum(cont, 3)], 0) / model.kinds + model.kmass / model.kinds / (model.words + 1)
    assert END in words
    return float((np.maximum(both - d[np.minimum(both, 3)], 0) / model.texts + model.start_mass / model.texts * low).sum())


def test_better_than_base_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm.trained_and_scored(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got.s > got.b
