"""Token-id files: a concatenated id array whose document boundaries are Elias-Fano encoded.

A file holds consecutive documents in ascending id order, those without an id first. Layout, little-endian: 8 bytes
magic; documents, documents without an id, ids (unsigned 64-bit); the smallest document id (signed 64-bit); id width, low
bits of the ends, low bits of the document ids, a pad of 5 bytes; the ends; the document ids less the smallest; the ids.
Ends and document ids are ascending sequences: their low bits, packed; their high bits in unary; the position of every
SAMPLE-th set bit of these (unsigned 32-bit). Bit arrays are padded to whole 64-bit words. One select on the unary bits
finds a document's end, another one its id; no table of 64 bits per document is kept or made.

Files are rows of a Parquet table, so any store that Spark writes to will do and a lost executor's files are written
again as a whole. A document of 2**29 ids or more is an error; Spark has no texts of that size.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.bpe import Chunks, default_pattern, packed, slices
from corpusforge.llm.common import save, text_of, worker_state

MAGIC = b"CFTOKEN2"
HEADER = struct.Struct("<8sQQQqBBB5x")
SAMPLE = 64
#: Ids after which a file is closed.
FILE_IDS = 1 << 20
END_ID = 2


def _words(bits: np.ndarray) -> bytes:
    data = np.packbits(bits, bitorder="little").tobytes()
    return data + bytes(-len(data) % 8)


def _low_bits(n: int, most: int) -> int:
    return max(0, (most // max(n, 1)).bit_length() - 1)


class Ascending:
    """An ascending sequence of n integers from 0, Elias-Fano encoded, read at any places at once."""

    @staticmethod
    def pack(values: np.ndarray, low: int) -> bytes:
        values = values.astype(np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        lows = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        unary = np.zeros(n + (most >> low) + 1, dtype=np.uint8)
        unary[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        samples = np.flatnonzero(unary)[::SAMPLE].astype("<u4")
        sizes = struct.pack("<Q", len(unary))
        return b"".join([sizes, _words(lows.astype(np.uint8).ravel()), _words(unary), samples.tobytes() + bytes(4 * (len(samples) % 2))])

    def __init__(self, take: Callable[[int], memoryview], n: int, low: int):
        self.low = low
        bits = lambda k: np.frombuffer(take((k + 63) // 64 * 8), dtype="<u8")
        length = struct.unpack("<Q", take(8))[0]
        self._lows = np.append(bits(n * low), np.uint64(0))
        self._unary = bits(length)
        samples = (n + SAMPLE - 1) // SAMPLE
        self._samples = np.frombuffer(take(4 * (samples + samples % 2)), dtype="<u4")

    def select(self, places: np.ndarray) -> np.ndarray:
        """Positions of those set bits: from the samples before them word by word, then by halves of the word."""
        start, left = self._samples[places // SAMPLE].astype(np.int64), (places % SAMPLE).astype(np.int64)
        word = start >> 6
        bits = self._unary[word] & (np.uint64(2**64 - 1) << (start & 63).astype(np.uint64))
        while len(on := np.flatnonzero(left >= (counts := np.bitwise_count(bits)))):
            left[on] -= counts[on]
            word[on] += 1
            bits[on] = self._unary[word[on]]
        position = word << 6
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            above = left >= below
            left -= np.where(above, below, 0)
            position += np.where(above, half, 0)
            bits = np.where(above, bits >> np.uint64(half), bits)
        return position

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        """The integers at those places, unsigned 64-bit."""
        high = (self.select(places) - places).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bit = places * self.low
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        over = np.where(shift > 0, self._lows[word + 1] << (np.uint64(64) - np.maximum(shift, 1).astype(np.uint64)), np.uint64(0))
        return high | (self._lows[word] >> shift | over) & np.uint64((1 << self.low) - 1)


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents that end before the positions `ends` (ascending) of ids; doc_ids ascend, None first."""
    n, total = len(doc_ids), len(ids)
    nulls = next((i for i, d in enumerate(doc_ids) if d is not None), n)
    rest = doc_ids[nulls:]
    if None in rest or rest != sorted(rest):
        raise ValueError("document ids must ascend")
    base = rest[0] if rest else 0
    named = np.array([d - base for d in rest], dtype=np.uint64)
    width = 2 if not total or ids.max() < 1 << 16 else 4
    low, low_ids = _low_bits(n, total), _low_bits(n - nulls, int(named[-1]) if len(named) else 0)
    header = HEADER.pack(MAGIC, n, nulls, total, base, width, low, low_ids)
    return b"".join([header, Ascending.pack(np.asarray(ends), low), Ascending.pack(named, low_ids), ids.astype(f"<u{width}").tobytes()])


class TokenFile:
    """Random access to a packed file."""

    def __init__(self, data):
        view, at = memoryview(data), HEADER.size

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size : at]

        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        _, self.n, self.nulls, self.total, self._base, width, low, low_ids = HEADER.unpack_from(view)
        self._ends = Ascending(take, self.n, low)
        self._ids = Ascending(take, self.n - self.nulls, low_ids)
        self.ids = np.frombuffer(take(width * self.total), dtype=f"<u{width}")

    def doc_ids(self, places: np.ndarray) -> list[int | None]:
        named = iter(self._ids[places[places >= self.nulls] - self.nulls].tolist())
        return [None if i < self.nulls else self._base + next(named) for i in places.tolist()]

    def doc_id(self, i: int) -> int | None:
        return self.doc_ids(np.array([i]))[0]

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where those documents start and end in ids."""
        starts = np.zeros(len(places), dtype=np.int64)
        later = places > 0
        starts[later] = self._ends[places[later] - 1].astype(np.int64)
        return starts, self._ends[places].astype(np.int64)

    def end(self, i: int) -> int:
        return int(self._ends[np.array([i])][0]) if i >= 0 else 0

    def ends(self) -> np.ndarray:
        return self._ends[np.arange(self.n)].astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        (start,), (end,) = self.bounds(np.array([i]))
        return self.ids[start:end]


def _worker(path: str, pattern: str, added_tokens: bool) -> Callable[[pa.Array], pa.Array]:
    """This Python worker's tokenizer: texts -> binary cells of ids. Pieces of the vocabulary's own pattern are encoded
    once each, as long as the memo has them."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added_tokens

        def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            values, counts = [], []
            for i in range(0, len(pieces), 20_000):
                ids = [e.ids for e in tokenizer.encode_batch_fast(pieces[i : i + 20_000], add_special_tokens=False)]
                values.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32))
                counts += map(len, ids)
            return np.concatenate(values), np.array(counts, dtype=np.int64)

        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()} if added_tokens else {}
        # Tokens that are found wherever they stand, and as they stand, cut a text in two; with others it stays whole.
        cuts = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for _, t in added.values())
        longest = sorted(added, key=len, reverse=True)
        split = re.compile("|".join(f"({re.escape(c)})" for c in longest)).split if added else None
        chunks, marks = Chunks(pattern, encode_pieces), {c: struct.pack("<I", i) for c, (i, _) in added.items()}

        def with_added(text: str) -> bytes:
            if not cuts:
                return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            segments = [s for s in split(text) if s]
            values = iter(chunks.encode([s for s in segments if s not in marks]))
            return b"".join(marks[s] if s in marks else next(values) for s in segments)

        def encode(texts: pa.Array) -> pa.Array:
            having = np.zeros(len(texts), dtype=bool)
            for content in added:
                having |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
            if not having.any():
                return packed(*chunks.encode_array(texts))
            found = packed(*chunks.encode_array(pc.if_else(pa.array(having), "", texts))).to_pylist()
            for i in np.flatnonzero(having):
                found[i] = with_added(texts[i].as_py())
            return pa.array(found, pa.binary())

        return encode

    return worker_state(("token files", path, pattern, added_tokens), make)


def write_files(docs: DataFrame, path: str, pattern: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS, text: str = "text", doc_id: str = "doc_id", added_tokens: bool = True) -> DataFrame:
    """Token files of docs as a written table: part, seq, n_docs, n_ids, data; (part, seq) is ascending doc_id order.

    path: a tokenizer file of the tokenizers library whose pre-tokenizer is `pattern`. Every document ends with end_id.
    Null texts are empty; null doc_ids come first; rows of equal id are ordered by a hash of their text. An empty
    table gives no files. Other columns are ignored. added_tokens: the file's added tokens get their own ids where a text
    has them, as the library does by itself; if False, they are text like any other.
    """
    pattern = pattern or default_pattern()

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), dtype="<u4")
            ends = np.cumsum([len(x) // 4 for _, x in held])
            row = [[part], [seq], [len(held)], [len(ids)], [pack([d for d, _ in held], ends, ids)]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "n_docs", "n_ids", "data"])

        encode, end = _worker(path, pattern, added_tokens), struct.pack("<I", end_id)
        for rows in slices(batches, size=6_000_000):
            for d, ids in zip(rows["doc_id"].to_pylist(), encode(rows["text"]).to_pylist()):
                held.append((d, ids + end))
                size += len(ids) // 4 + 1
                if size >= file_ids:
                    yield close()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return save(ordered.select("doc_id", "text").mapInArrow(run, "part int, seq int, n_docs long, n_ids long, data binary"), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files; start: ids of all documents before it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file = TokenFile(batch["data"][i].as_buffer())
                places = np.arange(file.n)
                starts, ends = file.bounds(places)
                ids = file.ids.astype("<u4", copy=False)
                columns = [
                    pa.array(np.full(file.n, batch["part"][i].as_py(), dtype=np.int32)),
                    pa.array(np.full(file.n, batch["seq"][i].as_py(), dtype=np.int32)),
                    pa.array(file.doc_ids(places), pa.int64()),
                    pa.array(starts),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ]
                yield pa.record_batch(columns, names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    # Sums by part first, so no task sees more than the parts, or one part's files.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("file_start")).join(parts, "part")
    found = files.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("file_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
