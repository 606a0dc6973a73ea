"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol a byte. A heap holds the adjacent pairs that have a merge rule, by rank and then place; the
lowest is popped and merged, its neighbours in the linked list make new pairs. Every merge takes one symbol away, so the
count is the initial symbols less the merges and no identifiers are made. A very long piece costs n log n.

Scale: a map over the scan, no shuffle. Each worker keeps counts of pieces it has met, a bounded number of them.

Cases: null text and empty text have 0 bytes and 0 tokens; repeated rows give repeated rows; a null doc_id stays null;
an empty table gives an empty result; other columns of the input are not read. Bytes that are not UTF-8 count
as they are and are read as U+FFFD.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .common import Memo, map_batches, raw_texts

PLACE = 32  # bits for the place in a heap entry
KEPT_PIECES = 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_memos: dict[str, Memo] = {}


def merged_length(vocab: bytebpe.ByteBpe, piece: bytes) -> int:
    """Number of tokens of one piece."""
    n = len(piece)
    if n < 2:
        return n
    shift, rank_of, merged = vocab.SHIFT, vocab.rank.get, vocab.merged
    ids = [vocab.of_byte[b] for b in piece]
    heap = [r << PLACE | i for i in range(n - 1) if (r := rank_of(ids[i] << shift | ids[i + 1])) is not None]
    heapify(heap)
    after, before, live = [*range(1, n + 1)], [*range(-1, n - 1)], n
    while heap:
        top = heappop(heap)
        i = top & ((1 << PLACE) - 1)
        j = after[i]
        if ids[i] < 0 or j >= n or rank_of(ids[i] << shift | ids[j]) != top >> PLACE:
            continue  # the pair that stood here has been merged meanwhile
        now = ids[i] = merged[top >> PLACE]
        ids[j] = -1
        live -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(now << shift | ids[k])) is not None:
                heappush(heap, r << PLACE | i)
        p = before[i]
        if p >= 0 and (r := rank_of(ids[p] << shift | now)) is not None:
            heappush(heap, r << PLACE | p)
    return live


def text_length(vocab: bytebpe.ByteBpe, memo: Memo, text: str) -> int:
    """Number of tokens of one text; an added token's string counts as one token wherever it stands."""
    get = memo.__getitem__
    if vocab.split_special is None or not any(s in text for s in vocab.special):
        return sum(map(get, vocab.pieces(text)))
    parts = vocab.split_special.split(text)
    return sum(1 if k % 2 else sum(map(get, vocab.pieces(part))) for k, part in enumerate(parts))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs by the vocabulary file, which every executor can open."""

    def run(batches):
        vocab = bytebpe.load(vocabulary)
        memo = _memos.setdefault(vocabulary, Memo(lambda piece: merged_length(vocab, piece.encode()), KEPT_PIECES))
        for b in batches:
            raw = raw_texts(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(map(len, raw), pa.int64(), size=len(raw)), pa.array((text_length(vocab, memo, x.decode(errors="replace")) for x in raw), pa.int64(), size=len(raw))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, SCHEMA)
