"""Every operator on rows with nulls, repeats, empty and very long texts: columns with clashing names change nothing."""

import pytest
from pyspark.sql import functions as F

from monthloom.llm import hamming, licenses, lm, media, minhash, mixing, packing, tokens, toxicity, urls
from monthloom.llm.queries import vocabulary

CLASHING = ["id", "rep", "key", "digest", "set", "n", "band", "component", "component_id", "n_shingles", "kept", "signature", "body", "label", "labels", "score", "predicted", "toxic", "copy", "copies", "rate", "start", "length", "offset", "sequence_id",
            "n_tokens", "n_bytes", "held_out", "word", "w", "v", "host", "path", "rule", "bad", "domain", "suffix", "code", "segment", "rank", "distance", "chunk", "position_key", "__gone"]
TEXTS = [None, "", " ", "a", "a a a a a a", "insult group one two three four five", "insult group one two three four five", "under the mit license é", "x" * 200_000, "word other " * 30_000, "\x00\x7f\ud7ff end"]
ROWS = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or "")) for i, t in enumerate(TEXTS)]
DOCS = [*ROWS, ROWS[5], ROWS[4], (None, "a b c d e f", None, None, None), (None, None, None, None, None)]
LABELS = [(5, 1, 1), (6, 0, 1), (3, 0, 0), (4, None, 0), (None, 1, 1), (9, 0, None)]


def toxic(docs):
    marks = docs.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return toxicity.scores(docs, toxicity.learned(docs, marks))


def left(docs):
    marks = docs.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return toxicity.without_toxic(docs, toxicity.learned(docs, marks)).select("doc_id", "text")


OPERATORS = {
    "tokens": lambda d: tokens.count_tokens(d, vocabulary()), "groups": minhash.groups, "first of each": lambda d: minhash.one_of_each(d).select("doc_id", "text"), "toxic": toxic, "without toxic": left, "media": media.stored_media,
    "model": lm.trained_and_scored, "mix": lambda d: mixing.mix(d).select("doc_id", "text", "lang", "source", "n_chars"), "licenses": licenses.scan,
    "packing": lambda d: packing.pack(d, vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("length"), F.max("doc_tokens").alias("doc_tokens")),
}


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents_with_clashing_columns(docs, name):
    own = OPERATORS[name](docs)
    more = OPERATORS[name](docs.withColumns({c: F.lit("own") for c in CLASHING}))
    assert rows(own) == rows(more)
    if name not in ("mix", "without toxic", "first of each"):
        ids = {r.doc_id for r in own.collect()}
        assert ids == {i for i, *_ in DOCS}
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_vectors_with_clashing_columns(spark):
    vectors = [(i, [float((i * k) % 7 - 3) for k in range(64)], 1) for i in range(0, 320, 4)] + [(None, [1.0] * 64, 1), (900, None, None), (1000, [], 0), (4, [float(4 * k % 7 - 3) for k in range(64)], 1), (1100, [None] * 64, 0)]
    plain = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    assert rows(hamming.search(plain)) == rows(hamming.search(plain.drop("label").withColumns({c: F.lit("own") for c in CLASHING})))
    assert hamming.search(plain.limit(0)).count() == 0


def test_pages_with_clashing_columns(spark):
    urls_ = [None, "", "http://", "x://" + "a." * 5000 + "net/en/", "http://a.example.net/en/1", "http://a.example.net/en/1", "http://q.org/fr/", "://", "http://host/?x"]
    pages = spark.createDataFrame([*enumerate(urls_), (None, "http://b.com/"), (4, "http://a.example.net/en/1")], "page_id long, url string")
    outcomes = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (6, None)], "page_id long, bad int")
    own = urls.judge(pages, outcomes)
    assert own.count() == len(urls_) + 2
    assert rows(own) == rows(urls.judge(pages.withColumns({c: F.lit("own") for c in CLASHING}), outcomes.withColumn("host", F.lit("h"))))
    assert urls.judge(pages.limit(0), outcomes).count() == 0
