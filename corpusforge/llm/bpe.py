"""Byte-level BPE: splitting texts into pieces, encoding pieces by DuckDB recursive queries, decoding by ordered
aggregation.

A chunk is a run of white space and the run of other characters after it. The pattern never goes from other characters
on to white space, so chunks split on their own give the pieces of the whole text. Chunks are cut as Arrow arrays, equal
ones of a block are looked up once, and a memo, bounded in bytes, keeps chunks and pieces between blocks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import give_back, text_of, worker_state

#: Bytes of a memo before it is cut down to what the last block needed.
MEMO_BYTES = 40_000_000
#: Bytes of pieces in one recursive query, and of ids in one decoding query.
PIECE_BATCH = 200_000
DECODE_BATCH = 500_000
#: Words of more bytes may contract several pairs in a round.
LONG_WORD = 64

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Bytes that may end a character that isn't white space, and second last bytes of other than ASCII white space.
_SOLID = (np.arange(256) > 32) & (np.arange(256) != 127)
_UNSURE = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A])


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each string starts in them and the last one ends; null is empty."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return values[ends[0] : ends[-1]], ends - ends[0]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values one after another, and where each ends."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return values[places], ends


def _chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where white space follows another character, and where a text starts. After characters of which it isn't sure
    that they are no white space there is no cut, which only makes a longer chunk."""
    cuts = np.flatnonzero(_SPACE[data[1:]] & _SOLID[data[:-1]]) + 1
    wide = data[cuts - 1] >= 0x80
    if wide.any():
        cuts = np.delete(cuts, np.flatnonzero(wide)[_UNSURE[data[cuts[wide] - 2]]])
    marks = np.zeros(len(data) + 1, dtype=bool)
    marks[cuts] = True
    marks[bounds] = True
    return np.flatnonzero(marks[:-1])


class Chunks:
    """Encodes texts chunk by chunk. encode_pieces: new pieces -> their values (unsigned 32-bit) one after another, and
    how many each has; a text's value is the concatenation of its pieces' values."""

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.split = regex.compile(pattern).findall
        self.encode_pieces = encode_pieces
        self.keys = pa.array([], pa.string())
        self.values = np.zeros(0, dtype=np.uint32)
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def _size(self) -> int:
        return self.keys.nbytes + 4 * len(self.values) + 16 * len(self.keys)

    def _shrink(self) -> None:
        for rows in (self.used, self.used[:0]):
            self.keys = pc.take(self.keys, pa.array(rows))
            self.values, ends = gather(self.values, self.starts[rows], self.lengths[rows])
            self.lengths = self.lengths[rows]
            self.starts = ends - self.lengths
            if self._size() <= MEMO_BYTES // 2:
                break

    def _add(self, keys: pa.Array, values: np.ndarray, lengths: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.values = np.concatenate([self.values, values])

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Where the memo has each word; -1: nowhere."""
        return pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy().astype(np.int64)

    def _learn(self, chunks: pa.Array) -> np.ndarray:
        """Memo rows of chunks that it doesn't have. A piece is a chunk too, with itself as its only piece."""
        texts = chunks.to_pylist()
        found = [None if c.isalpha() or (c[0] == " " and c[1:].isalpha()) else self.split(c) for c in texts]
        pieces = pa.array([p for c, f in zip(texts, found) for p in ((c,) if f is None else f)], pa.string()).dictionary_encode()
        rows = self._rows(pieces.dictionary)
        fresh = np.flatnonzero(rows < 0)
        rows[fresh] = len(self.keys) + np.arange(len(fresh))
        if len(fresh):
            words = pieces.dictionary.take(pa.array(fresh))
            self._add(words, *self.encode_pieces(words.to_pylist()))
        owned = rows[pieces.indices.to_numpy()]
        counts = np.array([1 if f is None else len(f) for f in found], dtype=np.int64)
        firsts = np.cumsum(counts) - counts
        result, one, many = np.zeros(len(texts), dtype=np.int64), counts == 1, np.flatnonzero(counts != 1)
        result[one] = owned[firsts[one]]
        if len(many):
            members, _ = gather(owned, firsts[many], counts[many])
            values, _ = gather(self.values, self.starts[members], self.lengths[members])
            sizes = np.add.reduceat(np.append(self.lengths[members], 0), np.cumsum(counts[many]) - counts[many]) * (counts[many] > 0)
            result[many] = len(self.keys) + np.arange(len(many))
            self._add(chunks.take(pa.array(many)), values, sizes)
        return result

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts one after another, and where each text's values end."""
        if self._size() > MEMO_BYTES:
            self._shrink()
        data, bounds = utf8(texts)
        if not len(data):
            return self.values[:0], np.zeros(len(texts), dtype=np.int64)
        starts = _chunk_starts(data, bounds)
        offsets = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        rows = self._rows(chunks.dictionary)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn(chunks.dictionary.take(pa.array(new)))
        each, self.used = rows[chunks.indices.to_numpy()], rows
        values, ends = gather(self.values, self.starts[each], self.lengths[each])
        return values, np.append(0, ends)[np.searchsorted(starts, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        values, ends = self.encode_array(pa.array(texts, pa.string()))
        return [values[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


#: A row is a token at a position of a word. Each round joins neighbouring tokens with the merge table and contracts, in
#: each word, the leftmost pair of the smallest rank: the pair's token takes the left one's place, the right one is gone
#: (-1). Only the newest state of a position is kept, and words without a pair are left out of further rounds.
RECURSIVE = """
WITH RECURSIVE state(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM positions
  UNION ALL
  (WITH alive AS (
    SELECT w, pos, tok, lead(tok) OVER o AS nxt, lead(pos) OVER o AS npos FROM state WHERE tok >= 0 WINDOW o AS (PARTITION BY w ORDER BY pos)),
  best AS (
    SELECT p.w, min((m.r::BIGINT << 31) + p.pos) AS k, arg_min(p.npos, (m.r::BIGINT << 31) + p.pos) AS npos, CAST(k >> 31 AS INTEGER) AS r, k & 2147483647 AS pos
    FROM alive p JOIN merges m ON m.a = p.tok AND m.b = p.nxt GROUP BY p.w){further}
  SELECT a.w, a.pos, CASE WHEN a.pos = b.pos THEN b.r WHEN a.pos = b.npos THEN -1 ELSE {other} END FROM alive a JOIN best b ON a.w = b.w {marked}))
SELECT w, tok FROM state WHERE tok >= 0 ORDER BY w, pos
"""

#: Long words contract further pairs of that rank in the same round, unless their token starts or ends one of a smaller
#: rank (alone), which would then come first. That gives the same ids in fewer rounds.
FURTHER = """,
  low AS (
    SELECT p.w, p.pos, p.npos, m.r, lag(p.npos) OVER (PARTITION BY p.w ORDER BY p.pos) AS before
    FROM alive p JOIN merges m ON m.a = p.tok AND m.b = p.nxt JOIN best b ON b.w = p.w AND b.r = m.r WHERE NOT m.alone),
  runs AS (SELECT *, count(*) FILTER (before IS DISTINCT FROM pos) OVER (PARTITION BY w ORDER BY pos) AS run FROM low),
  taken AS (SELECT w, pos, npos, r FROM runs QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 1),
  more AS (SELECT w, pos, r AS tok FROM taken UNION ALL SELECT w, npos, -1 FROM taken)"""

SHORT_WORDS = RECURSIVE.format(further="", other="a.tok", marked="")
LONG_WORDS = RECURSIVE.format(further=FURTHER, other="coalesce(more.tok, a.tok)", marked="LEFT JOIN more ON a.w = more.w AND a.pos = more.pos")


class MergeTable:
    """The merge table of a vocabulary in an in-memory DuckDB of one thread that writes nothing to a local folder."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, dtype=np.int32) for x in zip(*merges))
        early = np.zeros(max(ranks.values()) + 1, dtype=bool)
        early[a[r < a]] = early[b[r < b]] = True
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self._create("merges", pa.table({"a": a, "b": b, "r": r, "alone": early[r]}))
        vocabulary = pa.table({"id": np.array(list(ranks.values()), dtype=np.int64), "latin": [t.decode("latin-1") for t in ranks]})
        self._create("vocabulary", vocabulary)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)

    def _create(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _positions(self, words: list[bytes]) -> pa.Table:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        positions = np.arange(len(data)) - np.repeat(starts, lengths)
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": positions.astype(np.int32), "tok": self.byte_ids[data]})

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.db.register("positions", self._positions(words))
        found = self.db.execute(LONG_WORDS if max(map(len, words)) > LONG_WORD else SHORT_WORDS).fetchnumpy()
        self.db.unregister("positions")
        return found["tok"].astype(np.uint32), np.bincount(found["w"], minlength=len(words))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has. A piece that is a token is that token."""
        words = [piece.encode("utf-8") for piece in pieces]
        values = [np.array([self.ranks.get(word, 0) for word in words], dtype=np.uint32)]
        starts, lengths = np.arange(len(words)), np.ones(len(words), dtype=np.int64)
        # Words of like length share a query, so that few rounds are run for a single long one.
        open_ = sorted((i for i, word in enumerate(words) if word not in self.ranks), key=lambda i: len(words[i]))
        at, size = 0, len(words)
        while at < len(open_):
            start, room = at, PIECE_BATCH
            while at < len(open_) and (at == start or room >= len(words[open_[at]])):
                room -= len(words[open_[at]])
                at += 1
            ids, counts = self._contract([words[i] for i in open_[start:at]])
            starts[open_[start:at]], lengths[open_[start:at]] = size + np.cumsum(counts) - counts, counts
            values.append(ids)
            size += len(ids)
        return gather(np.concatenate(values), starts, lengths)[0], lengths

    def decode(self, documents: list[bytes] | list[np.ndarray]) -> list[bytes]:
        """The bytes of each document's ids (packed, or an array), aggregated in the order of positions. An unknown id
        raises."""
        decoded: list[bytes] = []
        while len(decoded) < len(documents):
            group, room = [], DECODE_BATCH
            for ids in documents[len(decoded) :]:
                group.append(np.frombuffer(ids, dtype="<u4"))
                room -= group[-1].nbytes
                if room < 0:
                    break
            lengths = [len(ids) for ids in group]
            ids = np.concatenate(group).astype(np.int64)
            rows = pa.table({"d": np.repeat(np.arange(len(group)), lengths), "pos": np.arange(len(ids)), "id": ids})
            self.db.register("ids", rows)
            found = self.db.execute(
                "SELECT d, string_agg(latin, '' ORDER BY pos) AS latin, count(*) AS n FROM ids JOIN vocabulary USING (id) GROUP BY d"
            ).fetchall()
            self.db.unregister("ids")
            by_document = {d: (latin.encode("latin-1"), n) for d, latin, n in found}
            for d, n in enumerate(lengths):
                data, known = by_document.get(d, (b"", 0))
                if known != n:
                    raise ValueError("ids that the vocabulary does not have")
                decoded.append(data)
        return decoded


def worker(path: str, pattern: str) -> tuple[MergeTable, Chunks]:
    """This Python worker's merge table and memo, kept between tasks."""

    def make():
        merges = MergeTable(read_ranks(path))
        return merges, Chunks(pattern, merges.encode_pieces)

    return worker_state(("bpe", path, pattern), make)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with a few million bytes of text, or a single longer text."""
    for batch in batches:
        _, bounds = utf8(batch[column])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices and their texts."""
    for part in slices(batches, column):
        yield part, part[column].to_pylist()


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells of unsigned 32-bit integers, little-endian; ends: where each cell ends in values."""
    if len(values) >= 1 << 29:
        raise ValueError("a text of 2**29 ids or more")
    offsets = (np.append(0, ends) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<u4"))])


def _columns(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of each whole text, in input order.

    path: ranks of a byte-level vocabulary, a file that every executor has. pattern must not go from other characters on
    to white space. Null and empty texts have no ids. Repeated rows and null doc_ids give a row each; an empty table gives
    none. Other columns are ignored. A piece without white space of n letters needs up to n rounds over n rows.
    """
    pattern = pattern or default_pattern()

    def run(batches):
        _, chunks = worker(path, pattern)
        for part in slices(batches):
            yield pa.record_batch([part["doc_id"], packed(*chunks.encode_array(part["text"]))], names=["doc_id", "ids"])

    return _columns(docs, text, doc_id).mapInArrow(run, "doc_id long, ids binary")


def encode_rows(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens (long) and ids (binary, as encode gives them) for it, in the order of docs.

    Columns of docs that are called n_tokens or ids are replaced; all others stay as they are, whatever their names.
    """
    pattern = pattern or default_pattern()
    others = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]

    def run(batches):
        _, chunks = worker(path, pattern)
        for part in slices(batches):
            values, ends = chunks.encode_array(part["text"])
            counts = pa.array(np.diff(ends, prepend=0).astype(np.int64))
            yield pa.record_batch([*part["row"].flatten()[: len(others)], counts, packed(values, ends)], names=[*others, "n_tokens", "ids"])

    row = F.struct(*others) if others else F.struct(F.lit(0))
    schema = docs.select(*others).schema.add("n_tokens", "long").add("ids", "binary")
    return docs.select(row.alias("row"), text_of(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, data (binary) for rows doc_id, ids as encode gives them; null ids count as none."""
    pattern = pattern or default_pattern()

    def run(batches):
        merges, _ = worker(path, pattern)
        for batch in batches:
            data = merges.decode([ids or b"" for ids in batch["ids"].to_pylist()])
            yield pa.record_batch([batch["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded again in one pass."""
    pattern = pattern or default_pattern()

    def run(batches):
        merges, chunks = worker(path, pattern)
        for part in slices(batches):
            values, ends = chunks.encode_array(part["text"])
            ids = [values[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
            columns = [
                part["doc_id"],
                pa.array(np.diff(ends, prepend=0).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in merges.decode(ids)], pa.string()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _columns(docs, text, doc_id).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
