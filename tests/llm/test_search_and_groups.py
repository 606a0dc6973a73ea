"""Hamming search, near-duplicate groups, components, license scans and URL verdicts against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from monthloom.llm import hamming, licenses, minhash, urls
from monthloom.llm.common import KeyFilter
from monthloom.llm.graph import components


def brute_nearest(rows, k, every=100):
    bits = {i: tuple(x > 0 for x in v) for i, v in rows if i is not None and v is not None and len(v) == 64 and not any(x is None or x != x for x in v)}
    out = {}
    for q in bits:
        if q % every == 0:
            far = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits if i != q)
            out[q] = [(d, i) for d, i in far[:k]]
    return out


def searched(spark, rows, k):
    got = {}
    for r in hamming.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    return {q: [(d, i) for _, d, i in sorted(xs)] for q, xs in got.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_hamming_search_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=64)
    rows = [(i, (centre + rng.normal(size=64) * (0.3 if i % 3 else 2)).tolist()) for i in range(700)]
    rows += [(i, centre.tolist()) for i in range(700, 950)]  # a code that a third of the rows share
    rows += [(None, centre.tolist()), (951, None), (952, [1.0]), (953, [None] * 64), (1000, [float("nan")] * 64), (100, rows[100][1])]
    assert searched(spark, rows, 7) == brute_nearest(rows, 7)


def test_hamming_small_tables(spark):
    assert searched(spark, [(1, [1.0] * 64)], 3) == {}
    assert searched(spark, [(0, [1.0] * 64), (1, [-1.0] * 64)], 3) == {0: [(64, 1)]}
    assert hamming.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def brute_groups(rows, words, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            s = minhash.shingle_set((text or "").encode(), words)
            sets[i] = max(sets.get(i, set()), s, key=len)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        p, q = sets[a], sets[b]
        both = len(p & q)
        if p and q and 100 * both >= percent * (len(p) + len(q) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def grouped(spark, rows, rule):
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, key int" if rows and len(rows[0]) > 2 else "doc_id long, text string"), rule).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)


def family(seed, n, size, changes):
    """n texts that differ from one text by a few words each."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("rule", [minhash.Rule(words=3, percent=85), minhash.Rule()])
def test_groups_equal_brute_force(spark, rule):
    texts = [*family(1, 60, 120, 5), *family(2, 40, 80, 4), *family(3, 30, 200, 12), *["same text in many copies here"] * 50, None, "", " \t\n", "one", "ONE", "two words", "Two  Words", "é é é é", "É é é é"]
    rng = random.Random(9)
    ids = rng.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts, strict=True))
    assert grouped(spark, rows, rule) == brute_groups(rows, rule.words, rule.percent)


def test_blocks_join_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rule = minhash.Rule(words=3, percent=85, bands=64, rows=2)
    rows = list(enumerate(family(4, 90, 100, 9)))
    assert grouped(spark, rows, rule) == brute_groups(rows, 3, 85)


def test_groups_of_odd_tables(spark):
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "a b c d e f", 1, 2), (5, "a b c d e f", 1, 2), (3, "a b c d e f", 0, 0), (None, "a b c d e f", 0, 0), (None, None, 0, 0), (8, "x " * 20000, 0, 0)]
    assert grouped(spark, rows, minhash.Rule()) == [(3, 2, 3), (5, 2, 3), (8, 1, 8)]
    left = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, key int"))
    assert left.columns == ["doc_id", "text", "n_shingles", "key"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 3), (False, 8), (True, 0), (True, 0)]


def test_an_id_with_two_texts_is_linked_by_each(spark):
    (a, near_a, *_), (b, near_b, *_) = family(11, 3, 120, 2), family(12, 3, 120, 2)
    rows = [(1, a), (1, b), (2, near_a + " end"), (3, near_b + " end"), (4, a), (0, b + " more"), (9, "one other text")]
    assert [(i, c) for i, _, c in grouped(spark, rows, minhash.Rule(words=3, percent=80))] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (9, 9)]


def test_posterior_bound_keeps_similar_pairs():
    rule = minhash.Rule(words=3, percent=85)
    rng = np.random.default_rng(0)
    n = 20000
    a = rng.integers(0, 1 << 32, (n, rule.hashes), dtype=np.uint32)
    same = rng.random((n, rule.hashes)) < 0.85
    b = np.where(same, a, a ^ np.uint32(1))
    assert len(minhash.not_pruned(a, b, rule)) >= n - 2
    far = np.where(rng.random((n, rule.hashes)) < 0.3, a, a ^ np.uint32(1))
    assert len(minhash.not_pruned(a, far, rule)) < n / 1000


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7000, 7000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(got.values()) == {0, 1000} and len(got) == 201 + 300


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 30000, 3).selectExpr("xxhash64(id) AS k")
    f = KeyFilter.of(keys)
    there = np.array([r.k for r in keys.collect()], np.int64)
    assert f.test(there.view(np.uint64)).all()
    assert f.test(np.random.default_rng(1).integers(0, 1 << 63, 10000).astype(np.uint64)).mean() < 0.02
    empty = KeyFilter.of(keys.where("k IS NULL"))
    assert not empty.test(there.view(np.uint64)).any()


def brute_license(raw, percent):
    """Every block of every template counted out."""
    words = licenses.words_of(raw)
    places, base, labels = [], set(), set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    best = 0.0
    for label, ts in licenses.TEMPLATES.items():
        for t in ts:
            line = licenses.words_of(t.encode())
            need, short = set(line), len(set(line)) < licenses.SHORT
            size = len(line) + (1 if short else math.ceil((100 - percent) * len(line) / 100))
            for at in [i for i, w in enumerate(words) if w in need]:
                block = words[at : at + size]
                share = len(need & set(block))
                if (len(need) - share > 1 if short else 100 * share < percent * len(need)) or not need & licenses.NAMES <= set(block) or (licenses.KIN - need) & set(block[: len(line)]):
                    continue
                if short:
                    kept = [line[:i] + line[i + 1 :] for i, w in enumerate(line) if w not in licenses.NAMES]
                    if not any(any(list(block[i] for i in pick) == k for pick in combinations(range(len(block)), len(k))) for k in kept):
                        continue
                labels.add(label)
                best = max(best, share / len(need))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best


def damaged(rng, text, share):
    """A text with a share of its words changed, left out or doubled."""
    out = []
    for w in text.split():
        out += [w] if rng.random() > share else rng.choice([[], ["other"], [w, "more"]])
    return " ".join(out)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_license_scan_equals_brute_force(spark, sf, percent):
    rng = random.Random(percent)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 5000]
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    odd = [None, "", "MIT", "Under the MIT-License, under the mit license; apache license\nversion 2", "cc by nc " * 500, "x " * 50 + " ".join(lines) + " y" * 77, "licence under the mit licenses", "Ünder the mit license é", " ".join(lines)[:2000], "permission is hereby granted free of charge to any one obtaining a copy of this software and associated documentation files"]
    odd += [damaged(rng, t, share) for t in lines for share in (0.05, 0.15, 0.3)] + [" ".join(rng.sample(t.split(), len(t.split()))) for t in lines] + [" ".join(t.split()[: len(t.split()) // 2]) for t in lines]
    rows = docs + [(10**7 + i, t) for i, t in enumerate(odd)] + [(None, "cc by nc")]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(brute_license((text or "").encode(), percent)), (i, text and text[:80])
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, labels string")).count() == 0


def test_license_filters_reject_before_counting():
    rng = random.Random(1)
    known = [licenses.Template(label, t, {}, 80) for label, ts in licenses.TEMPLATES.items() for t in ts]
    tally = Counter()
    for t in known:
        line = list(t.words)
        for size in (2, t.need // 2, t.need):
            words = [b"q"] * 300 + rng.sample(line, min(size, len(line))) + [b"q"] * 300
            t.best(words, [i for i, w in enumerate(words) if w in t.prefix], tally)
        t.best(line[:2], [i for i, w in enumerate(line[:2]) if w in t.prefix], tally)
    assert all(len(t.prefix) > 1 for t in known)
    assert tally["length"] > 0 and tally["position"] > tally["counted"] > 0


def test_plain_sentences_have_no_license(spark):
    lines = ["the license was released mit students under review", "we work under a 4 year plan licensed by cc and nc partners", "public terms of the free foundation are general and published under a license of its own", "permission is granted to any person with a copy of the files",
             "the software is provided to the authors in connection with an action of contract", "version 3 of the public general plan is licensed work under this city"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.labels) for r in got if r.labels] == []


#: A reworded statement of each template, and texts of none.
REWORDED = [
    ("licensed under gnu affero general public license version 3", "agpl-3"), ("licensed under apache license version 2", "apache-2"),
    ("you may not use this file except in compliance with the licence you might obtain a copy of this licence at", "apache-2"),
    ("you may not use this file except in compliance with its license you can obtain one copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without changes are permitted provided that the following conditions are met", "bsd"),
    ("this text is licensed under a creative commons attribution 4 0 international license", "cc-by"), ("available under cc by nc 4", "cc-by-nc"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this program is licensed under the gnu general public license version 3", "gpl-3"),
    ("it under the terms of the gnu general public license as issued by the free software foundation", "gpl-3"),
    ("permission to use copy modify and or distribute the software for any purpose with or without fee is hereby granted", "isc"), ("released under a mit license", "mit"),
    ("permission is hereby granted free of charge to any one obtaining a copy of this software and associated documentation files", "mit"),
    ("this source code file is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under the gnu general public license version 3", ""), ("licensed under a creative commons attribution 4 0 international license", ""),
    ("einheit mit einer licensed under the apache license version 2 0", "apache-2"), ("released under the bsd license", ""), ("licensed under cc by 4", ""), ("licensed under the apache license version 1", ""),
]


def test_reworded_licenses_have_their_labels(spark, tmp_path):
    from monthloom.llm import queries

    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REWORDED)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.labels for r in queries.op10_license_scan(spark, str(tmp_path)).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(REWORDED)] == REWORDED


def test_url_parts_rules_and_reputation(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://b.net", "b.net", "", None, "allow"), ("https://b.net/", "b.net", "/", "net/", "block"),
        ("x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"), ("x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("x://q.org/fr/?a", "q.org", "/fr/", "org/fr/", "allow"),
        (None, "", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"), ("a://b.net?x=://c/", "b.net", "", None, "allow"), ("a://://x", ":", "//x", None, "allow"), ("x://net/en/", "net", "/en/", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, *_) in enumerate(cases)] + [(None, "x://y.com/", "h")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: tuple(c[1:]) for i, c in enumerate(cases)}
    assert got[None][3] == "allow" and len(got) == len(cases) + 1


def test_bad_hosts_are_blocked_and_unlabelled_hosts_shrink_to_their_domain(spark):
    rows, outcomes = [], []
    for i in range(400):
        rows.append((i, f"http://good{i % 10}.com/{i}"))
        outcomes.append((i, int(i % 20 == 0)))
    for i in range(400, 600):
        rows.append((i, f"http://h{i % 4}.spam.com/{i}"))
        outcomes.append((i, int(i % 10 != 0)))
    rows += [(1000, "http://new.spam.com/"), (1001, "http://other.com/")]
    outcomes += [(0, 0), (None, 1), (1000, None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert all(got[i].verdict == "allow" for i in range(400)) and all(got[i].verdict == "block" for i in range(400, 600))
    assert got[1000].bad_rate > 0.7 > 0.4 > got[1001].bad_rate and got[1001].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
