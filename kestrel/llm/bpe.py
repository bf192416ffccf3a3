"""BPE encoding and decoding through a distinct-word table.

1. Split: Spark splits texts into words at ASCII white space.  A chunk is a run of
   documents of one task; its row holds its distinct words, dealt into buckets by a
   hash of the word, and each document as positions into them.  Rows are written once.
2. Encode: the words of all chunks meet bucket by bucket, and each distinct word is
   encoded once.  A word arrives once per chunk, not once per occurrence, so the
   commonest words are no hot keys.  A bucket's words stream through its task, which
   holds its distinct words; the number of buckets follows the bytes of the texts.
3. Join back: each chunk's words return with their ids, and its documents - read by
   bucket of the table, not shuffled - look their ids up by position.
4. Decode: ids join the id-to-piece table by position.  The table's size is the
   vocabulary's, a parameter, so it goes to every task as one constant array in the plan
   (a row joined to each document would be copied with it, and a join of exploded ids
   would shuffle every token).

Words and ids travel packed and compressed, one row per chunk and bucket: a row for
each word of each chunk, or each occurrence, would be several times the input.

Cutting at ASCII white space first is exact for tokenizers that split at white
space and drop it, whose added tokens hold none and strip none: normalisation never
composes across a space.  :func:`check_tokenizer` refuses others.

Defined results: null text is empty and has no ids; empty and white-space texts
have no ids and decode to nothing; ids may repeat and be null, every row is
answered; a very long text is a chunk of its own, which one task holds; other
columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm.rows import SPACE, small_batches
from kestrel.storage import Scratch, materialize, scratch

#: Words of one chunk at most, unless one document has more: bounds a worker's memory.
CHUNK_WORDS = 1_500_000
#: Distinct words encoded in one call.
ENCODE_WORDS = 8_000
#: Bytes of text for each bucket of words, at most.
BUCKET_BYTES = 16 << 20
#: White space that words are split at.
SPACES = " \t\n\x0b\x0c\r"


def check_tokenizer(spec: str) -> None:
    """Raise unless words between white space may be encoded and decoded one by one."""
    t = json.loads(spec)
    steps = t["pre_tokenizer"]["pretokenizers"] if t["pre_tokenizer"]["type"] == "Sequence" else [t["pre_tokenizer"]]
    drops = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)
    plain = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in t["added_tokens"])
    prefix = any(s.get("add_prefix_space") for s in steps)
    if not drops or not plain or prefix or t["decoder"] is not None or t["post_processor"] is not None:
        raise ValueError("this tokenizer's ids depend on more than the words between white space")


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as compressed bytes of equal weight side by side."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


class _Chunk:
    """Documents gathered by one task."""

    def __init__(self) -> None:
        self.ids: list = []
        self.words: list[pa.Array] = []
        self.sizes: list[int] = []
        self.total = 0

    def add(self, key, words: pa.Array) -> None:
        self.ids.append(key)
        self.words.append(words)
        self.sizes.append(len(words))
        self.total += len(words)

    def row(self, number: int, id_type: pa.DataType, buckets: int) -> pa.RecordBatch:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        flat = coded.indices.to_numpy(zero_copy_only=False)
        bucket = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % buckets
        table = pa.table({"bucket": bucket, "word": pa.array(words, pa.binary())})
        order = pc.sort_indices(table, sort_keys=[("bucket", "ascending"), ("word", "ascending")]).to_numpy()
        counts = np.bincount(flat, minlength=len(words))[order]
        # Frequent words get small codes, which compress better; counts alone restore them.
        code = np.empty(len(words), dtype=np.uint32)
        code[order[np.argsort(-counts, kind="stable")]] = np.arange(len(words), dtype=np.uint32)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        packs = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = [words[k] for k in order[edges[b] : edges[b + 1]].tolist()]
            data = b"\n".join(own)  # words hold no line feed
            packs.append({"bucket": b, "size": len(data), "words": pa.compress(data, codec="zstd", asbytes=True)})
        sizes = np.array(self.sizes, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.ids], pa.list_(id_type)),
                pa.array([_pack(sizes)], pa.binary()),
                pa.array([_pack(code[flat])], pa.binary()),
                pa.array([_pack(counts)], pa.binary()),
                pa.array([len(words)], pa.int64()),
                pa.array([packs], PACKS),
            ],
            names=["chunk", "ids", "sizes", "codes", "counts", "distinct", "packs"],
        )


PACKS = pa.list_(pa.struct([("bucket", pa.int32()), ("size", pa.int64()), ("words", pa.binary())]))


def words(text: Column) -> Column:
    """Words of a text, at ASCII white space; none of a null or blank one."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def chunked(docs: DataFrame, id_col: str, text_col: str, out: Scratch, parts: int, buckets: int) -> DataFrame:
    """Table of chunks, one row each, bucketed by chunk."""
    small_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"), F.spark_partition_id().cast("long").alias("part")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, serial, part, id_type = _Chunk(), 0, 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for row in range(batch.num_rows):
                part = batch.column(2)[row].as_py()
                own = batch.column(1)[row].values
                if chunk.ids and chunk.total + len(own) > CHUNK_WORDS:
                    yield chunk.row((part << 24) + serial, id_type, buckets)
                    chunk, serial = _Chunk(), serial + 1
                chunk.add(batch.column(0)[row].as_py(), own)
        if chunk.ids:
            yield chunk.row((part << 24) + serial, id_type, buckets)

    schema = (
        f"chunk long, ids array<{given.schema['id'].dataType.simpleString()}>, sizes binary, codes binary, "
        "counts binary, distinct long, packs array<struct<bucket: int, size: long, words: binary>>"
    )
    return out.table(given.mapInArrow(run, schema), "chunk", parts, "chunks")


@lru_cache(maxsize=1)
def _tokenizer(spec: str) -> Tokenizer:
    """Parsed once in a worker."""
    return Tokenizer.from_str(spec)


def encoded_words(chunks: DataFrame, spec: str) -> DataFrame:
    """(chunk, bucket, n, total, lengths, ids): every distinct word of a bucket encoded once.

    ``ids`` are the packed ids of the chunk's words of that bucket, in word order.
    """
    packs = chunks.select("chunk", F.explode("packs").alias("p")).select("chunk", "p.*")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec)
        known: dict[bytes, bytes] = {}
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("chunk", "bucket", "n", "total", "lengths", "ids")}
            for chunk, size, data in zip(*(batch.column(c) for c in ("chunk", "size", "words")), strict=True):
                own = pa.decompress(data.as_py(), size.as_py(), codec="zstd", asbytes=True).split(b"\n")
                new = [w for w in own if w not in known]
                for at in range(0, len(new), ENCODE_WORDS):
                    part = new[at : at + ENCODE_WORDS]
                    found = tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)
                    known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(part, found, strict=True))
                ids = [known[w] for w in own]
                flat = np.frombuffer(b"".join(ids), np.uint32)
                lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
                row = (chunk.as_py(), key[0].as_py(), len(ids), len(flat), _pack(lengths), _pack(flat))
                for to, v in zip(out.values(), row, strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = "chunk long, bucket int, n long, total long, lengths binary, ids binary"
    return packs.groupBy("bucket").applyInArrow(run, schema)


def pieces(spec: str) -> list[str]:
    """Piece of every id, in order: the tokenizer's vocabulary, a table of fixed size."""
    t = Tokenizer.from_str(spec)
    return [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]


def _take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of data[s : s + n]."""
    ends = np.cumsum(sizes)
    step = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    some = sizes > 0
    starts, sizes, ends = starts[some], sizes[some], ends[some]
    if not len(ends):
        return data[:0]
    step[0] = starts[0]
    step[ends[:-1]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return data[np.cumsum(step)]


def _chunk_documents(chunks: pa.Table, words: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
    """(id, token ids) of every document of the chunk given, joined back by position."""
    words = words.sort_by("bucket")
    packed = [words.column(c).to_pylist() for c in ("n", "total", "lengths", "ids")]
    size, flat = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for n, total, lengths, ids in zip(*packed, strict=True):
        size.append(_unpack(lengths, n).astype(np.int64))
        flat.append(_unpack(ids, total))
    size, flat = np.concatenate(size), np.concatenate(flat)
    start = np.cumsum(size) - size
    for row in range(chunks.num_rows):
        get = {c: chunks.column(c)[row] for c in chunks.column_names}
        counts = _unpack(get["counts"].as_py(), get["distinct"].as_py()).astype(np.int64)
        word = np.argsort(-counts, kind="stable")  # of each code
        ids = get["ids"].as_py()
        sizes = _unpack(get["sizes"].as_py(), len(ids)).tolist()
        codes = _unpack(get["codes"].as_py(), sum(sizes))
        at = 0
        for i, n in zip(ids, sizes, strict=True):
            mine = word[codes[at : at + n]]
            at += n
            yield i, _take(flat, start[mine], size[mine])


def _encoded(docs: DataFrame, spec: str, id_col: str, text_col: str, out: Scratch) -> DataFrame:
    """(id, ids, bytes) of every row, not yet run; ``bytes`` are the ids, little-endian."""
    check_tokenizer(spec)
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunked(docs, id_col, text_col, out, parts, max(2 * parts, -(-size // BUCKET_BYTES)))
    own = encoded_words(chunks, spec)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, ids = zip(*_chunk_documents(left, right), strict=True)
        values = np.concatenate([*ids, np.empty(0, np.uint32)]).astype("<i4")
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
        whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends * 4), pa.py_buffer(values)])
        return pa.table({"id": pa.array(key, left.column("ids").type.value_type), "ids": whole, "bytes": data})

    left = chunks.drop("packs").groupBy("chunk")
    return left.cogroup(own.groupBy("chunk")).applyInArrow(run, f"id {kind}, ids array<int>, bytes binary")


def _spec(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    with scratch(docs.sparkSession) as out:
        found = _encoded(docs, _spec(tokenizer), id_col, text_col, out)
        return materialize(found.select(F.col("id").alias(id_col), "ids"), "encoded")[0]


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids: each joins the id-to-piece table by position, in the JVM."""
    spec = _spec(tokenizer)
    check_tokenizer(spec)
    table = F.from_json(F.lit(json.dumps(pieces(spec))), "array<string>")  # folded to a constant before the plan runs
    text = F.array_join(F.transform(ids_col, lambda i: F.element_at(table, (i + 1).cast("int"))), " ")
    return encoded.withColumn(out_col, text)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``: its ids, and those decoded again."""
    with scratch(docs.sparkSession) as out:
        found = _encoded(docs.select("doc_id", "text"), _spec(tokenizer), "doc_id", "text", out)
        back = decode(found, tokenizer, "ids", "back")
        return materialize(
            back.select(
                F.col("id").alias("doc_id"),
                F.size("ids").cast("long").alias("n_tokens"),
                F.sha2("bytes", 256).alias("ids_sha256"),
                F.sha2("back", 256).alias("decoded_sha256"),
            ),
            "bpe",
        )[0]
