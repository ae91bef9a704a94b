"""Edit-aware token counts.

Each document keeps a segment tree over blocks of pre-tokens, with characters, tokens and pre-tokens as subtree sums. The
trees are a table: an edit reads its document's tree, re-splits and re-encodes only the blocks that it touches and a few
around them, from a boundary that it cannot move to the first block boundary that the new text meets again, and updates
the sums above them. Whatever the batch of edits, untouched blocks are never encoded anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.bpe import Chunks, default_pattern, packed, read_ranks, slices
from corpusforge.llm.common import save, text_of, worker_state

#: Pre-tokens of a block of a new tree; a block of MOST_IN_BLOCK or more is cut into new ones.
BLOCK = 16
MOST_IN_BLOCK = 8 * BLOCK
#: Pre-tokens between an edit and the boundary before it from which the text is split again.
CONTEXT = 4


class Counter:
    """Splits text into pre-tokens and counts characters and tokens of each."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.count = lambda piece: len(encoding.encode_ordinary(piece))

        def measure(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.array([(len(p), self.count(p)) for p in pieces], dtype=np.uint32).reshape(-1, 2)
            return sizes.ravel(), np.full(len(pieces), 2, dtype=np.int64)

        self.chunks = Chunks(pattern, measure)

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) rows of all pre-tokens of all texts, and where each text's rows end."""
        sizes, ends = self.chunks.encode_array(texts)
        return sizes.reshape(-1, 2).astype(np.int64), ends // 2

    def blocks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens, pre-tokens) rows of all blocks of all texts, and where each text's rows end."""
        sizes, ends = self.measure(texts)
        pieces = np.diff(ends, prepend=0)
        counts = -(-pieces // BLOCK)
        stops = np.cumsum(counts)
        inner = np.arange(counts.sum()) - np.repeat(stops - counts, counts)
        first = np.repeat(ends - pieces, counts) + inner * BLOCK
        sums = np.add.reduceat(sizes, first, axis=0) if len(first) else sizes[:0]
        return np.concatenate([sums, np.minimum(np.repeat(ends, counts) - first, BLOCK)[:, None]], axis=1), stops


class TokenTree:
    """A document's tree: sums[k] is the sum of sums[2k] and sums[2k + 1], and block i is at width + i; of each the
    columns are characters, tokens, pre-tokens. Blocks without characters are gaps that edits left."""

    def __init__(self, counter: Counter, text: str, blocks: np.ndarray | None = None):
        self.counter, self.text_, self.reencoded = counter, text, 0
        self._build(counter.blocks(pa.array([text]))[0] if blocks is None else blocks)

    def _build(self, blocks: np.ndarray) -> None:
        self.n = len(blocks)
        self.width = 1 << max(0, (self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 3), dtype=np.int64)
        self.sums[self.width : self.width + self.n] = blocks
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def blocks(self) -> np.ndarray:
        rows = self.sums[self.width : self.width + self.n]
        return rows[rows[:, 0] > 0]

    characters = property(lambda self: int(self.sums[1, 0]))
    tokens = property(lambda self: int(self.sums[1, 1]))
    pieces = property(lambda self: int(self.sums[1, 2]))

    def text(self) -> str:
        return self.text_

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at`, and where it starts; the last one with characters for the end."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.sums[k, 0] and self.sums[k + 1, 0]:
                start += int(self.sums[k, 0])
                k += 1
        return k - self.width, start

    def _set(self, i: int, row) -> None:
        k = self.width + i
        self.sums[k] = row
        while k > 1:
            k //= 2
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace `length` characters from `start`; both are cut to the document."""
        start = min(max(start, 0), self.characters)
        stop = min(max(start + length, start), self.characters)
        leaf = lambda i: self.sums[self.width + i]
        first, base = self._find(max(start - 1, 0))
        # Back by whole blocks of CONTEXT pre-tokens in all, some of which aren't white space: what an edit changes behind
        # these isn't looked at when what stands before them is split.
        behind = 0
        while first and behind < CONTEXT:
            first -= 1
            base -= int(leaf(first)[0])
            behind += int(leaf(first)[2])
        last, last_start = self._find(stop)
        if last < first:
            last, last_start = first, base
        end = last_start + int(leaf(last)[0])
        old, shift = self.text_, len(replacement) - (stop - start)
        text = old[:start] + replacement + old[stop:]
        at, pieces, after = base, [], first
        while True:
            # To the end of the block after the last one, so that the boundary between them is seen as it would be.
            ahead, further = last + 1, end
            while ahead < self.n and further == end:
                further += int(leaf(ahead)[0])
                ahead += 1
            if further == end:
                pieces += self.counter.pattern.findall(text, at)
                break
            met = False
            for match in self.counter.pattern.finditer(text, at, further + shift):
                if match.start() >= end + shift:
                    met = match.start() == end + shift
                    break
                pieces.append(match.group())
                at = match.end()
            if met:
                break
            # The last two pre-tokens may change when more of the text is seen.
            for piece in pieces[-2:]:
                at -= len(piece)
            del pieces[-2:]
            last, end = ahead - 1, further
        self.text_ = text
        self.reencoded += len(pieces)
        sizes = np.array([(len(p), self.counter.count(p), 1) for p in pieces], dtype=np.int64).reshape(-1, 3)
        if len(pieces) >= MOST_IN_BLOCK:
            cut = np.add.reduceat(sizes, np.arange(0, len(sizes), BLOCK), axis=0)
            rows = self.sums[self.width : self.width + self.n]
            self._build(np.concatenate([rows[:first], cut, rows[last + 1 :]]))
            return
        for i in range(first + 1, last + 1):
            self._set(i, 0)
        if self.n == 0:
            self._build(sizes.sum(axis=0, keepdims=True))
        else:
            self._set(first, sizes.sum(axis=0))


def _worker(path: str, pattern: str) -> Counter:
    return worker_state(("token counts", path, pattern), lambda: Counter(path, pattern))


TREES = "doc_id long, text string, blocks binary, n_tokens long"


def trees(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, blocks, n_tokens of every whole text, as a written table that `edited` reads.

    blocks: characters, tokens and pre-tokens of each block as unsigned 32-bit integers; the sums above them follow. path:
    ranks of a byte-level vocabulary. A null text is empty. Repeated rows and null doc_ids give a row each; an empty table
    gives none. keep: further columns of the table, made of docs; others are ignored.
    """
    pattern, keep = pattern or default_pattern(), keep or {}
    names = [*keep]

    def run(batches):
        counter = _worker(path, pattern)
        for part in slices(batches):
            blocks, ends = counter.blocks(part["text"])
            before = np.append(0, np.cumsum(blocks[:, 1]))[np.append(0, ends)]
            columns = [part["doc_id"], part["text"], packed(blocks.ravel(), ends * 3), pa.array(np.diff(before))]
            yield pa.record_batch([*columns, *[part[c] for c in names]], names=["doc_id", "text", "blocks", "n_tokens", *names])

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), *[v.alias(c) for c, v in keep.items()])
    schema = ", ".join([TREES, *[f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in keep]])
    return save(columns.mapInArrow(run, schema), "trees")


def edited(rows: DataFrame, edits: Column, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, text, blocks, n_tokens after edits of rows that have these columns (a table of trees, joined with a table of
    edits if they come as one), and n_tokens_before, pieces, pieces_reencoded, n_chars.

    edits: array<struct<start: int, length: int, replacement: string>>, applied one after another, each on the text as the
    ones before left it; null: none. start and length are cut to the text; null parts count as 0 and "". path and pattern
    are those that the trees were made with. The result can be written as the next table of trees.
    """
    pattern = pattern or default_pattern()

    def run(batches):
        counter = _worker(path, pattern)
        for part in slices(batches):
            found = []
            for text, data, before, todo in zip(part["text"].to_pylist(), part["blocks"], part["n_tokens"].to_pylist(), part["edits"].to_pylist()):
                blocks = np.frombuffer(data.as_buffer(), dtype="<u4").reshape(-1, 3)
                if not todo:
                    sums = blocks.sum(axis=0, dtype=np.int64).tolist()
                    found.append((text, data.as_py(), before, before, sums[2], 0, sums[0]))
                    continue
                tree = TokenTree(counter, text, blocks)
                for e in todo:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                found.append((tree.text(), tree.blocks.astype("<u4").tobytes(), tree.tokens, before, tree.pieces, tree.reencoded, tree.characters))
            text, blocks, *numbers = zip(*found)
            columns = [part["doc_id"], pa.array(text, pa.string()), pa.array(blocks, pa.binary()), *[pa.array(c, pa.int64()) for c in numbers]]
            yield pa.record_batch(columns, names=["doc_id", "text", "blocks", "n_tokens", "n_tokens_before", "pieces", "pieces_reencoded", "n_chars"])

    columns = rows.select("doc_id", "text", "blocks", "n_tokens", edits.alias("edits"))
    return columns.mapInArrow(run, f"{TREES}, n_tokens_before long, pieces long, pieces_reencoded long, n_chars long")


def counts_after_edits(docs: DataFrame, edits: Column, path: str, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, pieces, pieces_reencoded, n_chars_edited of every whole text: the trees of docs
    are written as a table, which is read again with the edits. edits: as for `edited`, an expression of docs."""
    table = trees(docs, path, pattern, text, doc_id, {"edits": edits})
    return edited(table, F.col("edits"), path, pattern).select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "pieces", "pieces_reencoded",
        F.col("n_chars").alias("n_chars_edited"),
    )
