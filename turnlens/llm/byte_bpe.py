"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

A pre-token's bytes are the leaves of a segment tree. A leaf holds the rank of the pair that the
symbol starting there forms with its right neighbour, joined with its position, so that the root is
always the leftmost pair of the lowest rank. A merge changes at most three leaves (the merged symbol,
the one it swallowed, its left neighbour), each updated along one path to the root. Short pre-tokens
of a batch are merged together: their trees are the rows of one numpy matrix. Long ones are merged
one by one in a tree of their own, in n log n steps.

Null and empty texts give no ids and no bytes. Whole texts are encoded, whatever their length.
Repeated rows are encoded each for itself; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import bounded_batches, text_or_empty

#: Pre-tokens of up to this many bytes are merged as rows of a matrix, longer ones one by one.
ROW_BYTES = 64
#: Rows of one matrix; bounds the memory of one step.
ROWS = 20_000
#: Characters encoded together, and distinct pre-tokens remembered by a worker (speed only).
STEP_CHARS = 1_000_000
MEMORY = 300_000
#: Ranks and positions share one 64-bit number: the position in the lower bits.
POS_BITS = 31
NONE = 1 << 62


class ByteBpe:
    """Encoder and decoder of a rank file (one line per token: base64 bytes, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(self.tokens) + 1
        # rank of a pair: that of its joined bytes, for every way to cut a token into two tokens
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                left, right = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        sizes = np.zeros(self.width, dtype=np.int64)
        for r, t in self.tokens.items():
            sizes[r] = len(t)
        self.sizes, self.offsets = sizes, np.r_[0, np.cumsum(sizes)][:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(self.width)), dtype=np.uint8)
        self.seen: dict[str, bytes] = {}

    # -- encoding -----------------------------------------------------------------------------

    def _leaf(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, (self.made[at] << POS_BITS) | pos, NONE)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to ``width`` bytes; ``width`` is a power of two."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        column = np.arange(width)
        inside = column < sizes[:, None]
        symbol = np.full((n, width), -1, dtype=np.int64)
        symbol[inside] = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(column + 1, (n, 1))    # start of the next symbol; the size means none
        before = np.tile(column - 1, (n, 1))   # start of the one before; -1 means none
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        opens = np.flatnonzero((column < sizes[:, None] - 1).ravel())
        flat = symbol.ravel()
        row, col = opens // width, opens % width
        tree[row, width + col] = self._leaf(flat[opens], flat[opens + 1], col)
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2], out=tree[:, level:2 * level])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        mask = (1 << POS_BITS) - 1
        while len(live):
            root = tree[live, 1]
            pos, merged = root & mask, root >> POS_BITS
            gone = after[live, pos]
            nxt = after[live, gone]
            symbol[live, pos], symbol[live, gone] = merged, -1
            after[live, pos] = nxt
            has_next = nxt < sizes[live]
            before[live[has_next], nxt[has_next]] = pos[has_next]
            prev = before[live, pos]
            has_prev = prev >= 0
            leaf = np.full(len(live), NONE)
            leaf[has_next] = self._leaf(merged[has_next], symbol[live[has_next], nxt[has_next]], pos[has_next])
            tree[live, width + pos] = leaf
            tree[live, width + gone] = NONE
            owner, left = live[has_prev], prev[has_prev]
            tree[owner, width + left] = self._leaf(symbol[owner, left], merged[has_prev], left)
            rows, at = np.r_[live, live, owner], np.r_[pos, gone, left] + width
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            live = live[tree[live, 1] < NONE]
        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def _merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece, by a tree of its own."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        symbol = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        tree = np.full(2 * width, NONE, dtype=np.int64)
        tree[width:width + n - 1] = self._leaf(symbol[:-1], symbol[1:], np.arange(n - 1))
        level = width // 2
        while level:
            tree[level:2 * level] = np.minimum(tree[2 * level:4 * level:2], tree[2 * level + 1:4 * level:2])
            level //= 2
        tree, symbol = tree.tolist(), symbol.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, size, mask = self.pairs, self.width, (1 << POS_BITS) - 1

        def put(pos: int, value: int) -> None:
            at = width + pos
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                value = value if value < other else other
                if tree[at] == value:
                    return
                tree[at] = value

        while tree[1] < NONE:
            pos, merged = tree[1] & mask, tree[1] >> POS_BITS
            gone = after[pos]
            nxt = after[gone]
            symbol[pos], symbol[gone], after[pos] = merged, -1, nxt
            put(gone, NONE)
            rank = None
            if nxt < n:
                before[nxt] = pos
                rank = pairs.get(merged * size + symbol[nxt])
            put(pos, NONE if rank is None else rank << POS_BITS | pos)
            prev = before[pos]
            if prev >= 0:
                rank = pairs.get(symbol[prev] * size + merged)
                put(prev, NONE if rank is None else rank << POS_BITS | prev)
        return np.array([s for s in symbol if s >= 0], dtype="<u4").tobytes()

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each non-empty pre-token."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "replace") for w in words]
        for i, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > ROW_BYTES:
                out[i] = self._merge_long(piece)
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in groups.items():
            for a in range(0, len(members), ROWS):
                part = members[a:a + ROWS]
                for i, ids in zip(part, self._merge_rows([raw[i] for i in part], width)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, 32 bits."""
        out, lists, waiting = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            lists.append((i, self.pattern.findall(text)))
            waiting += len(text)
            if waiting >= STEP_CHARS:
                self._join(out, lists)
                lists, waiting = [], 0
        self._join(out, lists)
        return out

    def _join(self, out: list[bytes], lists: list[tuple[int, list[str]]]) -> None:
        if len(self.seen) > MEMORY:
            self.seen.clear()
        new: set[str] = set()
        for _, words in lists:
            new.update(words)
        fresh = [w for w in new if w not in self.seen]
        if fresh:
            self.seen.update(zip(fresh, self.merge(fresh)))
        get = self.seen.__getitem__
        for i, words in lists:
            out[i] = b"".join(map(get, words))

    # -- decoding -----------------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids (little-endian, 32 bits) stand for."""
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(at):
            return b""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.offsets[at] - (ends - sizes), sizes)
        return self.bytes[where].tobytes()


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(name: str) -> ByteBpe:
    """The coder for a public rank file, loaded once per Python worker."""
    if name not in _LOADED:
        import public_tokenizers
        _LOADED[name] = ByteBpe(public_tokenizers.path(name), public_tokenizers.PATTERN)
    return _LOADED[name]


def encode_texts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (binary, little-endian unsigned 32-bit) of every row."""
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(vocab)
        for b in batches:
            ids = coder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(encode, f"id {kind}, ids binary").select(F.col("id").alias(id_col), "ids")


def decode_ids(encoded: DataFrame, vocab: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, decoded`` (binary) of every row of ``id_col, ids``."""
    bounded_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(vocab)
        for b in batches:
            raw = [coder.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids") \
        .mapInArrow(decode, f"id {kind}, decoded binary").select(F.col("id").alias(id_col), "decoded")


def round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded from the ids.

    ``with_ids`` adds ``ids`` (binary, little-endian unsigned 32-bit).
    """
    bounded_batches(docs.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(vocab)
        for b in batches:
            ids = coder.encode(b.column(1).to_pylist())
            columns = {"id": b.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                       "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                       "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids],
                                                  pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(both, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                          + ", ids binary" * with_ids) \
        .withColumnRenamed("id", id_col)
