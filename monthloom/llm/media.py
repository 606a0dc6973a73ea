"""Media columns: payloads cut by content, chunks stored once, media rebuilt from ordered chunk lists and verified.

A text's UTF-8 bytes are filled up with 255 to a positive multiple of 576. A gear hash rolls over the payload (each byte
shifts the hash left and adds a table value, so 32 bytes count); a chunk ends where the top bits are zero, after LEAST
bytes and before MOST. Equal passages therefore give equal chunks wherever they stand.

The stored form of a payload is its container: a manifest (magic, payload length, number of chunks, and each chunk's length
and digest in order) and, after it, those of its chunks that occur nowhere else. A chunk that occurs in several places lies once in
the chunk table, found by joins on the digest. media_bytes and media_sha256 are those of the container's bytes. Containers with chunks
elsewhere get them by a join and are put together in order; all are read back from storage before anything is computed,
and every chunk digest and the length are checked.

Scale: digests are counted by a combined aggregate; those that repeat go into a filter of bounded size, with no false negative (a
chunk that passes by chance is stored in the chunk table, no harm; when far more than 60 million digests repeat, most do, and the
chunk table holds most chunks). Only chunks that pass it, and containers that need them, are ever shuffled. Payloads that occur many
times are rebuilt once and joined back by a key; chunks and payloads with many users are salted in the joins.

Cases: null and empty texts are 576 bytes of 255. Equal texts give equal values. Repeated rows give repeated rows. A null id stays.
Very long texts are one container row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut, joined, map_batches, raw_texts, stored
from .minhash import grouped

UNIT, FILL, MAGIC = 576, b"\xff", b"CDM1"
LEAST, BITS, MOST = 256, 10, 8192
DIGEST = 16
READ = "object binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gear(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear()


def payload_of(raw: bytes) -> bytes:
    return raw + FILL * (-len(raw) % UNIT if raw else UNIT)


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks, the last is the payload's. The rolling hash of all places at once, by doubling its reach."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for reach in (1, 2, 4, 8, 16):
        if len(h) > reach:
            h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    out, start, n = [], 0, len(payload)
    for at in (np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1).tolist():
        while at - start > MOST:
            start += MOST
            out.append(start)
        if at - start >= LEAST and at < n:
            out.append(at)
            start = at
    while n - start > MOST:
        start += MOST
        out.append(start)
    out.append(n)
    return out


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    out, start = [], 0
    for end in cuts(payload):
        body = payload[start:end]
        out.append((hashlib.blake2b(body, digest_size=DIGEST).digest(), body))
        start = end
    return out


def manifest(parts: list[tuple[bytes, bytes]]) -> bytes:
    return MAGIC + struct.pack("<QI", sum(len(b) for _, b in parts), len(parts)) + b"".join(struct.pack("<I", len(b)) + d for d, b in parts)


def listed(form: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """Payload length and (length, digest) of each chunk."""
    size, n = struct.unpack_from("<QI", form, 4)
    at = 16
    out = []
    for _ in range(n):
        out.append((struct.unpack_from("<I", form, at)[0], form[at + 4 : at + 4 + DIGEST]))
        at += 4 + DIGEST
    return size, out


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def rebuilt(form: bytes, bodies: dict[bytes, bytes]) -> bytes:
    size, parts = listed(form)
    out = b"".join(bodies[d] for _, d in parts)
    if form[:4] != MAGIC or len(out) != size or any(hashlib.blake2b(b, digest_size=DIGEST).digest() != d for d, b in bodies.items()):
        raise ValueError("stored media do not match their manifest")
    return out


def feature(payload: bytes, n_chunks: int) -> str:
    """Samples' mean, deviation and entropy, and the share of steps that cross the middle; the chunks' number."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    high = x >= 128
    return f"mean={x.mean():.4f};sd={x.std():.4f};entropy={max(0.0, -(p * np.log2(p)).sum()):.4f};crossings={np.count_nonzero(high[1:] != high[:-1]) / len(x):.4f};chunks={n_chunks}"


def described(form: bytes, inline: bytes, payload: bytes) -> tuple:
    """Columns of READ after the object; form and inline are the container as it is stored."""
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form) + len(inline), hashlib.sha256(form + inline).hexdigest(), feature(payload, len(listed(form)[1]))


def store(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Containers (doc_id, n_bytes, object, form, inline: own chunks joined, elsewhere: digests), and the chunk table (digest, body)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def digests(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(d) for x in raw_texts(b) for d, _ in chunks(payload_of(x))], pa.int64())], ["key"])

    repeated = KeyFilter.of(stored(map_batches(docs.select("text"), digests, "key long").groupBy("key").count().where("count > 1").select("key"), "repeated"))

    def known(batches):
        for b in batches:
            all_parts = [chunks(payload_of(x)) for x in raw_texts(b)]
            keys = np.array([key_of(d) for parts in all_parts for d, _ in parts], np.int64).view(np.uint64)
            yield b, all_parts, iter(repeated.test(keys).tolist())

    def containers(batches):
        for b, all_parts, shared in known(batches):
            forms = [manifest(parts) for parts in all_parts]
            inline, elsewhere = [], []
            for parts in all_parts:
                flags = [next(shared) for _ in parts]
                inline.append(b"".join(body for (_, body), f in zip(parts, flags, strict=True) if not f))
                elsewhere.append(list(dict.fromkeys(d for (d, _), f in zip(parts, flags, strict=True) if f)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in raw_texts(b)], pa.int64()), pa.array([hashlib.blake2b(f, digest_size=DIGEST).digest() for f in forms], pa.binary()), pa.array(forms, pa.binary()), pa.array(inline, pa.binary()), pa.array(elsewhere, pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "object", "form", "inline", "elsewhere"],
            )

    def bodies(batches):
        seen: set[bytes] = set()
        for _, all_parts, shared in known(batches):
            some = [(d, body) for parts in all_parts for d, body in parts if next(shared) and not (d in seen or seen.add(d))]
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.binary()), pa.array([x for _, x in some], pa.binary())], ["digest", "body"])

    held = stored(map_batches(docs, containers, "doc_id long, n_bytes long, object binary, form binary, inline binary, elsewhere array<binary>"), "containers")
    shared = stored(map_batches(docs.select("text"), bodies, "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body")), "chunks")
    return held, shared


def pieces_by_digest(form: bytes, inline: bytes, elsewhere: set[bytes]) -> dict[bytes, bytes]:
    """A container's own chunks."""
    out, at = {}, 0
    for n, d in listed(form)[1]:
        if d not in elsewhere:
            out[d] = inline[at : at + n]
            at += n
    return out


def read_back(held: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What described() has: by row of the containers that are whole, and by object of the others."""
    schema = READ.replace("object binary", "doc_id long, n_bytes long")

    def whole(batches):
        for b in batches:
            out = [described(f, x, rebuilt(f, pieces_by_digest(f, x, set()))) for f, x in zip(b.column("form").to_pylist(), b.column("inline").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *_columns(out)], [x.split()[0] for x in schema.split(", ")])

    alone = map_batches(held.where(F.size("elsewhere") == 0).select("doc_id", "n_bytes", "form", "inline"), whole, schema)
    objects = held.where(F.size("elsewhere") > 0).groupBy("object").agg(F.first(F.struct("form", "inline", "elsewhere")).alias("c")).select("object", "c.*")
    asked = held.where(F.size("elsewhere") > 0).select("object", F.explode("elsewhere").alias("digest")).distinct()
    got = joined(cut(asked), shared, "digest", ["object"]).select("object", "digest", "body", F.lit(None).cast("binary").alias("inline"))
    own = objects.select("object", F.lit(None).cast("binary").alias("digest"), F.col("form").alias("body"), "inline")
    rows = own.unionByName(got).repartition("object").sortWithinPartitions("object", F.col("digest").asc_nulls_first())

    def assembled(batches):
        for (key,), rows in grouped(batches, 1):
            _, form, inline = rows[0]
            bodies = {d: body for d, body, _ in rows[1:]}
            bodies |= pieces_by_digest(form, inline, set(bodies))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), *_columns([described(form, inline, rebuilt(form, bodies))])], [x.split()[0] for x in READ.split(", ")])

    return alone, map_batches(rows.select("object", "digest", "body", "inline"), assembled, READ)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]


def stored_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row."""
    held, shared = store(docs, text, doc_id)
    alone, by_object = read_back(held, shared)
    rest = joined(held.where(F.size("elsewhere") > 0).select("doc_id", "n_bytes", "object"), by_object, "object", ["doc_id", "n_bytes"]).drop("object")
    return alone.unionByName(rest)
