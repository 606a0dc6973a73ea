"""Token counts and packing against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

from monthloom.llm import bytebpe, packing, tokens  # noqa: E402
from monthloom.llm.common import Memo  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)
ODD = ["", " ", "a", "  two  spaces \n\n", "it's we'll x_y __ 12ab", "é ß ²½ \x1c x", "日本語 テスト 한국", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "x" * 5000, "ab" * 3000 + " " * 700, "😀😀 zwj 👩‍👩‍👧", "  \x85 \xa0 nbsp", "Ⅷ ५ ٣"]


def test_split_agrees_with_library_on_every_fast_character():
    library, vocab = ByteLevel(add_prefix_space=False), bytebpe.load(PATH)
    for i in (i for i in range(0x10000) if not 0xD800 <= i < 0xE000):
        c = chr(i)
        text = f"a{c}b {c}{c}1 {c} !{c}?{c}\n {c} '{c}s"
        if bytebpe.UNSAFE.search(text) is None:
            assert vocab.pieces(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], hex(i)
            assert ENCODER.ids(text).tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 0], hex(i)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcdeTH '_1.\n ", max_size=80)))
def test_count_and_ids_of_any_text(text):
    vocab = bytebpe.load(PATH)
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert tokens.text_length(vocab, Memo(lambda p: tokens.merged_length(vocab, p.encode()), 1000), text) == len(ids)
    (got,), mean = ENCODER.encode([text])
    assert got.tolist() == [*ids, 0] and np.isfinite(mean).all()


def test_counts_of_whole_table_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, None), (5, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    want = sorted(((-1 if r.doc_id is None else r.doc_id), len((r.text or "").encode()), len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect())
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(rows, PATH).collect())
    assert got == want
    assert tokens.count_tokens(rows.limit(0), PATH).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "some text", 7, "x")], "doc_id long, text string, n_tokens int, key string")
    assert tokens.count_tokens(rows, PATH).first().n_tokens == 2
    assert packing.pack(rows, PATH).first().doc_tokens == 3


def packed_whole(rows, want):
    """Every id in one piece, sequences gapless and full or of a power of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert docs.keys() == want.keys()
    for k, parts in docs.items():
        at, ids = 0, np.array(want[k], "<u4")
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_of_whole_table_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.unionByName(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(ODD)] + [(5_000_000, None)], "doc_id long, text string"))
    want = {r.doc_id: [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 0] for r in rows.collect()}
    packed_whole(packing.pack(rows, PATH).collect(), want)
    assert packing.pack(rows.limit(0), PATH).count() == 0


def test_packing_repeated_and_null_rows(spark):
    rows = spark.createDataFrame([(1, "same text")] * 5 + [(None, "no id"), (None, None)], "doc_id long, text string")
    got = packing.pack(rows, PATH).collect()
    assert sum(r.length for r in got) == 5 * 3 + 3 + 1
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(1 << bits * dims))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_have_equal_keys_and_languages_part(spark, sf):
    encoder = packing.Encoder(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 500").collect()
    key = packing.hilbert(packing.cell(encoder.encode([r.text for r in docs])[1]), packing.GRID)
    order = [docs[i].lang for i in np.argsort(key, kind="stable")]
    together = sum(a == b for a, b in zip(order, order[1:], strict=False)) / (len(order) - 1)
    share = sum((order.count(x) / len(order)) ** 2 for x in set(order))
    assert together > share + 0.1
