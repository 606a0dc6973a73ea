"""What the methods promise beyond their rows: proofs, repeatability, interactions, any rate, repeated rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from monthloom.llm import common, hamming, lm, media, minhash, mixing, packing, queries, toxicity, urls
from monthloom.llm.queries import vocabulary


def random_codes(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, x) for i, x in enumerate((rng.integers(0, 2, (n, 64)) * 2 - 1).astype(float).tolist())], "vec_id long, embedding array<float>")


def test_every_search_is_proven_by_its_radius(spark, sf):
    for vectors in (spark.read.parquet(f"{sf}/embeddings.parquet"), random_codes(spark, 4000)):
        answers, proofs = hamming.proven_search(vectors, k=10)
        told = proofs.collect()
        asked = vectors.where("vec_id % 100 = 0").count()
        assert len(told) == asked and len({tuple(r.query) for r in told}) == asked
        assert all(r.kth is not None and r.kth <= r.covered and r.covered < 64 for r in told)
        far = {r.query_id: r.distance for r in answers.where("rank = 10").collect()}
        assert len(far) == asked


def test_segments_follow_the_number_of_codes():
    for bits, n in ((64, 2), (64, 10_000), (64, 10**9), (128, 10**6), (20, 50)):
        cuts = hamming.segments(bits, n)
        assert sum(w for *_, w in cuts) == bits and max(w for *_, w in cuts) <= hamming.MOST_WIDTH
    assert len(hamming.segments(64, 10**6)) < len(hamming.segments(64, 1000))


def test_codes_of_other_lengths_and_far_queries(spark):
    rng = np.random.default_rng(5)
    for bits in (20, 70):
        codes = rng.integers(0, 2, (300, bits))
        codes[0] = 1 - codes[1:].mean(axis=0).round()
        rows = [(i, (x * 2.0 - 1).tolist()) for i, x in enumerate(codes)]
        got = defaultdict(list)
        for r in hamming.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, bits=bits).collect():
            got[r.query_id].append((r.rank, r.distance, r.neighbor_id))
        for q in (0, 100, 200):
            want = sorted((int((codes[q] != codes[i]).sum()), i) for i in range(300) if i != q)[:4]
            assert [(d, i) for _, d, i in sorted(got[q])] == want


def test_a_value_of_many_codes_is_met_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CHUNK", 16)
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2, (400, 64))
    codes[:, :32] = codes[0, :32]  # half of each code is the same
    rows = [(i, (x * 2.0 - 1).tolist()) for i, x in enumerate(codes)]
    got = defaultdict(list)
    for r in hamming.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got[r.query_id].append((r.rank, r.distance, r.neighbor_id))
    for q in (0, 100, 200, 300):
        want = sorted((int((codes[q] != codes[i]).sum()), i) for i in range(400) if i != q)[:5]
        assert [(d, i) for _, d, i in sorted(got[q])] == want


def test_packing_is_the_same_in_every_action(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "city", "river"]) for _ in range(rng.randrange(12)))) for i in range(6000)]
    rows += [(i, "one text in very many copies of it") for i in range(6000, 9000)] + [(7, "a row that comes again")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, vocabulary(), stretch=4000)
    first, second = ([tuple(r) for r in pieces.collect()] for _ in range(2))
    again = [tuple(r) for r in packing.pack(docs, vocabulary(), stretch=4000).collect()]
    assert sorted(first) == sorted(second) == sorted(again)
    by_stretch, by_sequence = Counter(), defaultdict(list)
    for _, _, length, _, _, sequence, offset in first:
        by_stretch[sequence >> 40] += length
        by_sequence[sequence].append((offset, length))
    assert len(by_stretch) > 10 and max(by_stretch.values()) < 4 * np.mean(list(by_stretch.values()))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end & (end - 1) == 0 and end <= packing.LENGTH
    short = Counter(sequence >> 40 for sequence, parts in by_sequence.items() if sum(n for _, n in parts) < packing.LENGTH)
    assert max(short.values()) <= 10
    assert Counter(r[0] for r in first if r[1] == 0) == Counter(i for i, _ in rows)


def test_exactly_one_of_two_words(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([f"w{rng.randrange(20000)}" for _ in range(30)] + ["insultword"] * a + ["groupname"] * b)))
        labels.append((i, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    held = [got[i].predicted == y for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 1400 and np.mean(held) > 0.95


def test_machine_score_equals_a_double_loop():
    rng = np.random.default_rng(2)
    model = toxicity.Machine({b: b for b in range(40)}, -0.3, rng.normal(0, 0.5, 40), rng.normal(0, 0.4, (40, toxicity.FACTORS)))
    sets = [set(rng.choice(40, rng.integers(0, 12), replace=False).tolist()) for _ in range(50)]
    for s, got in zip(sets, model.score(sets), strict=True):
        x = sorted(s)
        z = model.w0 + sum(model.w[i] for i in x) + sum(model.v[x[i]] @ model.v[x[j]] for i in range(len(x)) for j in range(i + 1, len(x)))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_a_tiny_source_is_repeated_many_times(spark):
    docs = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 40_000, "large"), (3, None, "none")], "doc_id long, text string, source string")
    got = mixing.mix(docs, details=True)
    per = {r.source: r for r in got.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("position_key").alias("keys"), F.max("rate").alias("rate")).collect()}
    assert per["tiny"].n == per["tiny"].keys and abs(per["tiny"].n - per["tiny"].rate) < 6 * per["tiny"].rate ** 0.5
    keys = [r.position_key for r in got.select("position_key").collect()]
    assert keys == sorted(keys)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_part_counts_are_poisson(spark):
    """Counts of a rate of several parts against its mean and variance."""
    rate = 2.5 * mixing.PART
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(rate).alias(mixing.OWN + "rate"))
    rated = docs.withColumn(mixing.OWN + "steps", mixing.steps(F.lit(rate - 2 * mixing.PART)))
    n = np.array([r.n for r in mixing.copied(rated, "s", F.col("doc_id").cast("string")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()])
    assert len(n) == 2000 and abs(n.mean() - rate) < 2 and abs(n.var() / rate - 1) < 0.15


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words stand in this line", "z"), (3, "yet another text has the id", "z"), (None, "a b c d e f g", "n")]
    left = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(r.doc_id for r in left) == {1: 1, 3: 1, None: 1}
    again = minhash.one_of_each(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(str, left)) == sorted(map(str, again))


@pytest.mark.parametrize("turn", [1, -1])
def test_ids_with_two_texts_in_both_orders(spark, turn):
    from test_search_and_groups import family

    (a,), (b,) = family(21, 1, 120, 2), family(22, 1, 120, 2)
    rows = [(5, a), (5, b), (8, a + " new end"), (9, "begun anew " + b), (11, "something else that stands alone here")][::turn]
    got = {r.doc_id: r.component_id for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Rule(words=3, percent=85)).collect()}
    assert got == {5: 5, 8: 5, 9: 5, 11: 11}


def test_a_bound_blocks_hosts_on_the_whole_table(spark, sf):
    got = queries.op4_url_reputation(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bad = pages.groupBy(urls.host_and_path(F.col("url"))[0].alias("host")).agg(F.avg(urls.names_a_vice(F.col("html"))).alias("share"), F.count("*").alias("n"))
    by_method = got.where("rule IS NULL").join(bad, "host")
    assert by_method.where("verdict = 'block'").count() > 0
    assert by_method.where("verdict = 'block' AND share < 0.5").count() == 0 and by_method.where("verdict = 'allow' AND share > 0.9 AND n >= 10").count() == 0


def test_suffixes_of_several_labels(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.z.gov.k",), ("co.uk",), ("1.2.3.4:80",), ("s.a.b.c.d",)], "host string")
    suffix, domain = urls.suffix_and_domain(F.col("host"), ("co.uk", "b.c.d", "gov.k"))
    assert [tuple(r) for r in hosts.select(suffix, domain).collect()] == [("co.uk", "b.co.uk"), ("gov.k", "z.gov.k"), ("co.uk", "co.uk"), ("1.2.3.4:80", "1.2.3.4:80"), ("b.c.d", "a.b.c.d")]


def test_media_hashes_are_of_the_stored_container(spark):
    import hashlib

    rows = [(i, "a passage that comes again and again " * 200 + f" own words {i * 7919} " * (i % 5)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held, _ = media.store(docs, "text", "doc_id")
    want = {r.doc_id: (len(r.form) + len(r.inline), hashlib.sha256(bytes(r.form) + bytes(r.inline)).hexdigest()) for r in held.collect()}
    assert {r.doc_id: (r.media_bytes, r.media_sha256) for r in media.stored_media(docs).collect()} == want


def test_hot_keys_are_salted(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 4900, F.col("id") % 50).cast("long").alias("k"), F.col("id").alias("v"))
    one = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        got = common.joined(rows, one, "k", ["v"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(one, "k", how).collect()))


def test_stored_tables_are_deleted(spark):
    with common.cleared(spark):
        kept = common.stored(spark.range(5), "kept")
        path = kept.scratch_path
        assert kept.count() == 5
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_model_files_without_a_local_path(tmp_path, monkeypatch):
    lm.write_file(f"file://{tmp_path}/m", "word-0", lm.file_of(np.arange(5, dtype="<u8"), np.arange(5, dtype="<u4")))
    here = lm.mapped(f"file://{tmp_path}/m", "word-0")
    assert isinstance(here, np.memmap)
    monkeypatch.setattr(lm, "local_path", lambda folder: None)
    assert lm.mapped(f"file://{tmp_path}/m", "word-0").tobytes() == here.tobytes()


def test_pipeline_of_odd_tables(spark, tmp_path):
    texts = [None, "", "a b c d e f", "a b c d e f", "plain words of a text", "x " * 30_000]
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1), (None, "no id at all", None, None, None)]
    marks = spark.createDataFrame([(i, None, 0) for i in range(6)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, part in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"copy": F.lit(1), "key": F.lit("k")})
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() > 0) == bool(part)
