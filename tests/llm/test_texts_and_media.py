"""Toxicity by held-out accuracy, media by round trip, mixing by its distribution, and the pipeline's stages."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from monthloom.llm import media, minhash, mixing, toxicity


def labelled(n, seed=3):
    """Texts with an insult, a group's name, both or neither: only both are toxic."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["insultword"] * a + ["groupname"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    return rows, labels


def test_interaction_that_a_linear_score_misses(spark):
    rows, labels = labelled(3000)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, toxicity.learned(docs, marks)).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([(r.predicted == 1) == bool(y) for r, y in held]) > 0.97


def test_toxicity_odd_rows(spark):
    rows, labels = labelled(400)
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "insultword groupname"), (7, "again " * 20000)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.scores(docs, toxicity.learned(docs, marks)).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = toxicity.learned(docs, marks.where("doc_id < 0"))
    assert {r.predicted for r in toxicity.scores(docs, none).collect()} == {0}
    assert toxicity.scores(docs.limit(0), none).count() == 0


def test_filter_keeps_columns(spark):
    rows, labels = labelled(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    model = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in toxicity.scores(docs, model).where("predicted = 0").collect()}


def plain_cuts(payload):
    """The gear hash byte by byte."""
    out, start, h = [], 0, 0
    ends = []
    for i, b in enumerate(payload):
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        if h < 1 << (32 - media.BITS):
            ends.append(i + 1)
    for at in ends:
        while at - start > media.MOST:
            start += media.MOST
            out.append(start)
        if at - start >= media.LEAST and at < len(payload):
            out.append(at)
            start = at
    while len(payload) - start > media.MOST:
        start += media.MOST
        out.append(start)
    return [*out, len(payload)]


def test_cuts_equal_a_rolling_hash():
    rng = random.Random(1)
    for n in (1, 31, 32, 33, 576, 5000, 60000):
        payload = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        assert media.cuts(payload) == plain_cuts(payload)
    assert media.cuts(b"a" * 40000) == plain_cuts(b"a" * 40000)


def test_media_round_trip(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = docs + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "x" * 576), (10**7 + 3, "é" * 40000), (10**7 + 4, "é" * 40000), (10**7 + 5, "é" * 39999 + "e"), (None, "no id"), (docs[0][0], docs[0][1])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, object int, feature string")
    got = media.stored_media(table).collect()
    by_text = defaultdict(set)
    want = Counter()
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.stored_media(table.limit(0)).count() == 0


def test_equal_passages_are_stored_once(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(3000))
    rows = [(i, " ".join(word() for _ in range(300)) + " " + shared) for i in range(20)]
    held, chunks = media.store(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    kept = held.selectExpr("sum(octet_length(inline)) AS n").first().n + chunks.selectExpr("sum(octet_length(body)) AS n").first().n
    assert kept < sum(len(t) for _, t in rows) / 4


def test_damaged_chunk_is_found():
    parts = media.chunks(media.payload_of(b"some text " * 400))
    form, bodies = media.manifest(parts), dict(parts)
    assert media.rebuilt(form, bodies) == media.payload_of(b"some text " * 400)
    bodies[parts[0][0]] = parts[0][1][:-1] + b"!"
    with pytest.raises(ValueError):
        media.rebuilt(form, bodies)


def test_poisson_counts(spark):
    rows = [(i, "x" * 50, "hot" if i % 3 else f"s{i % 5}") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, {"hot": 0.5, "s0": 0.5}, details=True).collect()
    by = Counter(r.source for r in got)
    assert set(by) == {"hot", "s0"} and abs(by["hot"] - by["s0"]) < 0.05 * sum(by.values()) and abs(sum(by.values()) - 20000) < 900
    per = Counter(r.doc_id for r in got if r.source == "hot")
    rate = next(r.rate for r in got if r.source == "hot")
    n = sum(1 for r in rows if r[2] == "hot")
    zero = 1 - len(per) / n
    assert zero == pytest.approx(np.exp(-rate), abs=0.02)
    assert [r.position_key for r in got] == sorted(r.position_key for r in got)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "a", None), (2, "", "empty"), (3, "text", "x")], "doc_id long, text string, source string").withColumn("copy", F.lit(5)).withColumn("rate", F.lit(1))
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect())[1] % 2 == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    few = mixing.SOURCES
    try:  # the salted join gives the same rows
        want = sorted(map(str, mixing.mix(docs, details=True).collect()))
        mixing.SOURCES = 0
        assert sorted(map(str, mixing.mix(docs, details=True).collect())) == want
    finally:
        mixing.SOURCES = few


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    assert clean.columns == docs.columns and clean.count() <= docs.count()
    marked = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0")
    lost = docs.join(clean, "doc_id", "left_anti").join(marked, "doc_id").count()
    assert lost <= 0.02 * marked.count()
    one = corpus_pipeline.drop_near_duplicates(spark, clean, sf).cache()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    from test_search_and_groups import brute_groups

    keep = {i for i, _, c in brute_groups(rows, 5, 80) if i == c}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == keep
    mixed = corpus_pipeline.mix_sources(spark, one, sf)
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.pack_sequences(spark, mixed, sf).collect()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert Counter(r.doc_id for r in pieces if r.start == 0) == copies
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)
    assert isinstance(minhash.Rule(), minhash.Rule)
