"""N-gram Jaccard self-join by a token-group matrix; connected classes of similar documents.

A document's set holds the hashes of its distinct n-word shingles. Two documents link when
``100 * intersection >= percent * union``. Equal sets are one node, so copies cost nothing more.

Matrix tokens. Two linked sets of at most M shingles differ in at most ``H = 2 M (100 - percent) /
(100 + percent)`` shingles. Hash the shingles into H + 1 + z cells: at least z + 1 cells agree. The
content of a cell is one token; a set has a fraction of its shingles as tokens, and a passage that
many documents share makes few common tokens, since a cell mixes it with the rest. So linked sets
share at least ``need`` tokens: z + 1 less the empty cells, which make no token. Cells depend on M,
so sizes are cut into bands of ratio 100 / percent; linked sets are in the same or in neighbouring
bands, and each set has the tokens of both pairings it can take part in.

Groups. Tokens that only one node has are dropped, and nodes that keep fewer than ``need``. Every
node is checked against the smallest node (hub) of its tokens, and links to hubs give first classes.
What remains open are tokens whose nodes are in different classes: their nodes are partitioned into
groups of similar sets (same hub, whole classes together, bounded number of shingles). The matrix
joins tokens with groups: a node is sent to a group only if the group's tokens hold ``need`` of the
node's. There the union of the group's sets bounds the overlap: with fewer than ``percent`` of the
node's shingles in the union no member can link, and the group stays closed. Open groups are
verified exactly, skipping pairs that are already in one class.

Links. To count links, the nodes of all tokens take part, whatever their class, and every pair of a
group and the nodes sent to it is verified. Pairs are never rows: a task adds up what each node links
with in its group. This work grows with the pairs of different similar sets, that of classes does not.

The number of rows never grows with the pairs of a group of copies: hubs give one row per node and
token, the matrix one per node and group. Every link between different classes is found, so classes
are exact. Shingles and sets are known by hashes of 64 bits; tokens by 48 bits, of which chance
matches only cost work.

Words are split at ASCII white space after A-Z is lower-cased. Null texts and texts without words
have an empty set and link with nothing; texts of fewer than n words are one shingle. Rows with a
null id take part, but a class is named by the smallest id in it that is not null (null if there is
none). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import bitmap_of, bounded_batches, in_bitmap, stored, text_or_empty
from turnlens.llm.components import connected

#: Shingles of a group, and of the nodes sent to it at once: bounds a task's memory.
GROUP_SHINGLES = 500_000
#: Tokens of a bucket in which repeated tokens are found, and tokens packed into one row per bucket.
BUCKET_TOKENS, PACK_TOKENS = 500_000, 500_000
#: Bits of a token, and bytes of a token and of a node in a pack.
TOKEN_BITS, TOKEN_BYTES, NODE_BYTES = 48, 6, 5
#: Bytes of a text whose words are hashed at once (more than a word's), and of a word that is hashed by its letters' places.
PIECE_BYTES, WORD_BYTES = 1 << 20, 256
#: Cells of a pairing whose borders a worker remembers (speed only).
CELLS = 10_000

#: A-Z lower-cased, ASCII white space as a blank.
LOWER = bytes(32 if x in b"\t\n\v\f\r" else x + 32 if 65 <= x <= 90 else x for x in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit function of an array of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


#: A number for each byte (none for the blank), and a factor for each place in a word.
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])
LETTERS[32] = 0
PLACES = np.cumprod(np.full(WORD_BYTES, MIX[0] | np.uint64(3)))


def piece_words(piece: bytes) -> np.ndarray:
    """Hashes of the words of a piece of text, in order; words are split at blanks."""
    raw = np.frombuffer(piece, dtype=np.uint8)
    inside = raw != 32
    begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    raw = raw[begin[0]:]  # each word and the blanks after it; blanks add nothing
    begin = begin - begin[0]
    sizes = np.diff(begin, append=len(raw))
    place = np.arange(len(raw)) - np.repeat(begin, sizes)
    hashes = np.add.reduceat(LETTERS[raw] * PLACES[np.minimum(place, WORD_BYTES - 1)], begin)
    for i in np.flatnonzero(sizes > WORD_BYTES).tolist():
        word = raw[begin[i]:begin[i] + sizes[i]].tobytes().rstrip(b" ")
        if len(word) > WORD_BYTES:
            hashes[i] = xxhash.xxh64_intdigest(word)
    return hashes


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in order: a sum over its bytes and their places, or of a long word xxHash.

    Long texts are cut into pieces at blanks; a piece without a blank is one long word.
    """
    raw = text.encode("utf-8", "replace").translate(LOWER)
    out, at = [], 0
    while len(raw) - at > PIECE_BYTES:
        end = raw.rfind(b" ", at, at + PIECE_BYTES)
        if end >= 0:
            out.append(piece_words(raw[at:end]))
        else:
            end = raw.find(b" ", at)
            end = len(raw) if end < 0 else end
            out.append(np.array([xxhash.xxh64_intdigest(raw[at:end])], dtype=np.uint64))
        at = end + 1
    return np.concatenate([*out, piece_words(raw[at:])])


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    h = mixed(word_hashes(text))
    if not len(h):
        return h
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * MIX[0] + h[k:len(h) - size + 1 + k]
    out = np.sort(mixed(out))
    return out[np.r_[True, out[1:] != out[:-1]]]


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Bands:
    """Size bands and the cells of each pairing of neighbouring bands."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]
        self.borders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, -(-self.edges[-1] * 100 // self.percent)))
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def cells(self, pairing: int) -> tuple[int, int]:
        """Cells for sets of the bands ``pairing - 1`` and ``pairing``, and how many more than H + 1; 0: only equal sets link."""
        while len(self.edges) < pairing + 2:
            self.band(self.edges[-1])
        most = self.edges[pairing + 1] - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        more = 1 + differ // 10
        return (differ + 1 + more, more) if differ else (0, 0)

    def cut(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The first hash (upper 32 bits) of each cell, and a number for each cell."""
        if (known := self.borders.get(cells)) is not None:
            return known
        # cell = high * cells >> 32
        first = -(-(np.arange(cells + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int64) // cells)
        made = first.astype(np.uint64), np.arange(cells, dtype=np.uint64) * MIX[0]
        if cells <= CELLS:
            self.borders[cells] = made
        return made

    def tokens(self, shingles: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Matrix tokens of a sorted set, and how many of them a linked set shares at least.

        The lowest bit of a token is that of its pairing's number; the two pairings of a set differ in it.
        """
        out, need = [np.zeros(0, dtype=np.uint64)], [1, 1]
        if not len(shingles):
            return out[0], need
        band = self.band(len(shingles))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles))])
            high = shingles >> np.uint64(32)
            for pairing in (band, band + 1):
                cells, more = self.cells(pairing)
                if not cells:
                    continue
                first, number = self.cut(cells)
                at = np.searchsorted(high, first)
                content = sums[at[1:]] - sums[at[:-1]]
                token = mixed(mixed(content + number) + np.uint64(pairing) * MIX[1] + np.uint64(cells))
                token = token >> np.uint64(64 - TOKEN_BITS)
                token = (token & ~np.uint64(1)) | np.uint64(pairing & 1)
                full = at[1:] > at[:-1]
                empty = int((~full).sum())
                # with too many empty cells the empty ones count too, here and in a linked set that also has too many
                out.append(token if empty > more else token[full])
                need[pairing & 1] = 1 if empty > more else more + 1 - empty
        return np.concatenate(out), need


def lists_of(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.uint64).view(np.int64)))


def narrow(numbers: np.ndarray, size: int) -> bytes:
    """The lower ``size`` bytes of each number."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def widen(raw: bytes, size: int) -> np.ndarray:
    """Numbers of ``size`` bytes each."""
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def document_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, node, tokens, need`` of every row; ``node`` is the hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for b in batches:
            sets = [shingle_set(t, n) for t in b.column(1).to_pylist()]
            marks = [bands.tokens(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_hash, sets), pa.int64()),
                 pa.array([narrow(t, TOKEN_BYTES) for t, _ in marks], pa.binary()),
                 pa.array([need for _, need in marks], pa.list_(pa.int32()))],
                names=["id", "n_shingles", "node", "tokens", "need"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, n_shingles bigint, node bigint, tokens binary, need array<int>")


def batch_tokens(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch, and how many each row has."""
    raw = tokens.to_pylist()
    return widen(b"".join(raw), TOKEN_BYTES), np.array([len(x) // TOKEN_BYTES for x in raw], dtype=np.int64)


def repeated_tokens(sets: DataFrame, buckets: int) -> DataFrame:
    """``hash``: tokens of at least two nodes.

    Tokens travel packed: each worker sends one row per bucket with each of its tokens and a node that
    has it, so a token that very many nodes share is one entry per worker's pack.
    """

    def summary(tokens: np.ndarray, nodes: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(tokens, kind="stable")
        tokens, nodes, several = tokens[order], nodes[order], several[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        low, high = np.minimum.reduceat(nodes, first), np.maximum.reduceat(nodes, first)
        return tokens[first], low, (low != high) | np.logical_or.reduceat(several, first)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            flat, counts = batch_tokens(b.column(1))
            nodes = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << 8 * NODE_BYTES) - 1)
            waiting.append((flat, np.repeat(nodes, counts)))
            size += len(flat)
            if size >= PACK_TOKENS:
                yield packed(waiting)
                waiting, size = [], 0
        if size:
            yield packed(waiting)

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens = np.concatenate([p[0] for p in parts])
        tokens, nodes, several = summary(tokens, np.concatenate([p[1] for p in parts]), np.zeros(len(tokens), dtype=bool))
        # tokens are sorted, and a bucket is a range of them
        where = (tokens >> np.uint64(TOKEN_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
        at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        cuts = list(zip(at.tolist(), np.r_[at[1:], len(where)].tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(where[at].astype(np.int32)), pa.array([narrow(tokens[a:b], TOKEN_BYTES) for a, b in cuts], pa.binary()),
             pa.array([narrow(nodes[a:b], NODE_BYTES) for a, b in cuts], pa.binary()),
             pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary())],
            names=["bucket", "tokens", "nodes", "several"])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [widen(x, TOKEN_BYTES) for x in pdf["tokens"]]
        nodes = np.concatenate([widen(x, NODE_BYTES) for x in pdf["nodes"]])
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)) for x, t in zip(pdf["several"], tokens)]
        found, _, more = summary(np.concatenate(tokens), nodes, np.concatenate(several).astype(bool))
        return pd.DataFrame({"hash": found[more].astype(np.int64)})

    return sets.select("node", "tokens") \
        .mapInArrow(pack, "bucket int, tokens binary, nodes binary, several binary") \
        .groupBy("bucket").applyInPandas(find, "hash bigint")


def kept_tokens(sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """``hash, node, need`` of the tokens that several nodes have, for nodes with enough of them.

    Tokens that the bitmap does not hold are not repeated; it only saves shuffling.
    """
    bits = min(27, max(16, (32 * repeated.count()).bit_length()))  # 16 MB at most
    shift = 64 - TOKEN_BITS
    bitmap = bitmap_of(repeated.select(F.shiftleft("hash", shift).alias("hash")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bitmap, dtype=np.uint8)
        for b in batches:
            flat, counts = batch_tokens(b.column(1))
            keep = in_bitmap(held, bits, flat << np.uint64(shift))
            row = np.repeat(np.arange(len(counts)), counts)[keep]
            flat = flat[keep]
            side = (flat & np.uint64(1)).astype(np.int64)
            has = np.bincount(row * 2 + side, minlength=2 * len(counts))
            need = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            enough = (has >= need)[row * 2 + side]
            row, flat, side = row[enough], flat[enough], side[enough]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.astype(np.int64)), pa.array(b.column(0).to_numpy(zero_copy_only=False)[row]),
                 pa.array(need[row * 2 + side].astype(np.int32))], names=["hash", "node", "need"])

    rows = sets.select("node", "tokens", "need").mapInArrow(run, "hash bigint, node bigint, need int")
    exact = stored(rows.distinct().join(repeated, "hash", "left_semi"), "candidate-tokens")
    side = F.col("hash").bitwiseAND(1).alias("side")
    enough = exact.groupBy("node", side, "need").count().where("count >= need").select("node", "side")
    return exact.withColumn("side", side).join(enough, ["node", "side"], "left_semi").select("hash", "node", "need")


def with_hubs(tokens: DataFrame) -> DataFrame:
    """``hash, node, need, hub``: the smallest node of each token; tokens that one node only has left are dropped."""
    hubs = tokens.groupBy("hash").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    return tokens.join(hubs.select("hash", "hub"), "hash")


def shared_enough(pairs: DataFrame, *by: str) -> DataFrame:
    """Distinct ``by`` of rows (one per shared token) that share at least ``need`` tokens of one pairing."""
    return pairs.groupBy(*by, F.col("hash").bitwiseAND(1).alias("side"), "need").count() \
        .where("count >= need").select(*by).distinct()


def node_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` of the given nodes, from one document of each."""
    chosen = stored(sets.select("node", "id").join(nodes, "node").groupBy("node")
                    .agg(F.min(F.xxhash64("id")).alias("hash")), "chosen")
    bits = min(27, max(16, (32 * chosen.count()).bit_length()))
    bitmap = bitmap_of(chosen.select("hash"), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bitmap, dtype=np.uint8)
        for b in batches:
            here = in_bitmap(held, bits, b.column(0).to_numpy(zero_copy_only=False))
            keys = b.column(0).filter(pa.array(here))
            found = [shingle_set(t, n) for t in b.column(1).filter(pa.array(here)).to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(set_hash, found), pa.int64()), lists_of(found)],
                                             names=["hash", "node", "shingles"])

    return docs.select(F.xxhash64(F.col(id_col)).alias("hash"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, "hash bigint, node bigint, shingles array<bigint>") \
        .join(chosen, ["hash", "node"], "left_semi").dropDuplicates(["node"]).select("node", "shingles")


class Members:
    """The sets of a group: their union, and which of them have each of its shingles."""

    def __init__(self, members: pd.DataFrame, percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in members["shingles"]])
        self.union, self.place, self.frequency = np.unique(np.concatenate(list(members["shingles"])),
                                                           return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.posting = owner[np.argsort(self.place, kind="stable")]
        self.begins = np.r_[0, np.cumsum(self.frequency)]
        self.begin = np.r_[0, np.cumsum(self.sizes)]
        self.flag = np.zeros(len(self.union), dtype=bool)

    def candidates(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set's places in the union, and the members that may link with it (none if the group stays closed)."""
        size = len(shingles)
        need = -(-size * self.percent // 100)
        at = np.minimum(np.searchsorted(self.union, shingles), len(self.union) - 1)
        at = at[self.union[at] == shingles]
        if len(at) < need:
            return at, np.zeros(0, dtype=np.int64)  # the union bounds the overlap with every member
        # a member with the needed overlap has one of any size - need + 1 shingles; the rarest are taken
        rare = at[np.argsort(self.frequency[at], kind="stable")][:size - need + 1 - (size - len(at))]
        cands = np.unique(np.concatenate([self.posting[self.begins[i]:self.begins[i + 1]] for i in rare]))
        sizes = self.sizes[cands]
        return at, cands[(sizes * 100 >= self.percent * size) & (size * 100 >= self.percent * sizes)]

    def overlap(self, j: int) -> int:
        """Flagged shingles of member ``j``."""
        return int(np.count_nonzero(self.flag[self.place[self.begin[j]:self.begin[j + 1]]]))

    def linked(self, size: int, at: np.ndarray, cands: np.ndarray) -> np.ndarray:
        """The candidates that link with the set of ``size`` shingles at the places ``at``."""
        self.flag[at] = True
        if 4 * self.sizes[cands].sum() > len(self.place):  # most of the group: one pass over all its sets
            same = np.add.reduceat(self.flag[self.place], self.begin[:-1], dtype=np.int64)[cands]
        else:
            same = np.array([self.overlap(j) for j in cands.tolist()], dtype=np.int64)
        self.flag[at] = False
        return cands[100 * same >= self.percent * (size + self.sizes[cands] - same)]


class Classes(dict):
    """Labels joined so far (union-find)."""

    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self[up]
        return x


def verify_group(members: pd.DataFrame, queries: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join classes between the queries and the members of one group."""
    links: list[tuple[int, int]] = []
    if len(members) and len(queries):
        group, classes = Members(members, percent), Classes()
        m_node, m_label, root = members["node"].tolist(), members["label"].tolist(), classes.root
        for node, label, shingles in zip(queries["node"].tolist(), queries["label"].tolist(), queries["shingles"]):
            at, cands = group.candidates(shingles)
            group.flag[at] = True
            mine = root(label)
            for j in cands.tolist():
                other = root(m_label[j])
                if other == mine:
                    continue
                same = group.overlap(j)
                if 100 * same >= percent * (len(shingles) + int(group.sizes[j]) - same):
                    links.append((node, m_node[j]))
                    classes[other] = mine
            group.flag[at] = False
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def count_group(members: pd.DataFrame, queries: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Every link between the queries and the members of one group, counted: (node, node, n) with the rows that have
    the sets of n linked members other than the node itself. Links that join classes also come by name: (a, b, 0)."""
    out: list[tuple[int, int, int]] = []
    if len(members) and len(queries):
        group, classes = Members(members, percent), Classes()
        m_node, m_copies = members["node"].to_numpy(), members["copies"].to_numpy()
        _, first_of, m_label = np.unique(members["label"].to_numpy(), return_index=True, return_inverse=True)
        names = members["label"].to_numpy()[first_of].tolist()
        for node, label, shingles in zip(queries["node"].tolist(), queries["label"].tolist(), queries["shingles"]):
            linked = group.linked(len(shingles), *group.candidates(shingles))
            linked = linked[m_node[linked] != node]
            if not len(linked):
                continue
            out.append((node, node, int(m_copies[linked].sum())))
            labels, at = np.unique(m_label[linked], return_index=True)
            for k, j in zip(labels.tolist(), linked[at].tolist()):
                other, mine = classes.root(names[k]), classes.root(label)
                if other != mine:
                    out.append((node, int(m_node[j]), 0))
                    classes[other] = mine
    return pd.DataFrame(out, columns=["a", "b", "n"], dtype="int64")


def hub_links(tokens: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links between nodes and hubs that share enough tokens, verified."""
    pairs = shared_enough(tokens.where("node <> hub"), "node", "hub")
    a = shingles.select("node", F.col("shingles").alias("x"))
    b = shingles.select(F.col("node").alias("hub"), F.col("shingles").alias("y"))
    both = pairs.join(a, "node").join(b, "hub") \
        .where((F.size("x") * 100 >= percent * F.size("y")) & (F.size("y") * 100 >= percent * F.size("x")))
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)) \
        .select(F.col("node").alias("a"), F.col("hub").alias("b"))


def group_links(tokens: DataFrame, shingles: DataFrame, labels: DataFrame, percent: int,
                copies: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` between nodes of different classes that share a token, through the token-group matrix.

    With ``copies`` (node, copies) the nodes of every token meet, those of one class too, and all their links are
    counted: ``a, b, n`` as ``count_group`` gives them.
    """
    opened = tokens.join(labels, "node")
    if copies is None:
        spread = opened.groupBy("hash").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
        opened = opened.join(spread.select("hash"), "hash", "left_semi")
    opened = stored(opened, "open")
    sizes = shingles.select("node", F.size("shingles").cast("long").alias("size"))
    nodes = opened.groupBy("node", "label").agg(F.min("hub").alias("hub")).join(sizes, "node")
    classes = nodes.groupBy("label").agg(F.min("hub").alias("cluster"), F.sum("size").alias("class_size"))
    clusters = classes.groupBy("cluster").agg(F.sum("class_size").alias("cluster_size"))
    grouped = nodes.drop("hub").join(classes, "label").join(clusters, "cluster")
    big = F.col("class_size") > GROUP_SHINGLES
    group = F.when(big, F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("class_size") / GROUP_SHINGLES)))) \
        .otherwise(F.xxhash64("cluster", F.lit(-1), F.pmod(F.xxhash64("label"), F.ceil(F.col("cluster_size") / GROUP_SHINGLES))))
    grouped = grouped.select("node", "label", "size", group.alias("group"))
    if copies is not None:
        grouped = grouped.join(copies, "node")
    grouped = stored(grouped, "groups")
    own = opened.select("hash", "node", "need").join(grouped, "node")
    matrix = own.select("hash", F.col("group").alias("other")).distinct()
    if copies is None:
        pure = grouped.groupBy("group").agg(F.min("label").alias("l"), F.max("label").alias("h")) \
            .select(F.col("group").alias("other"), F.when(F.col("l") == F.col("h"), F.col("l")).alias("only"))
        met = own.join(matrix.join(pure, "other"), "hash") \
            .where((F.col("group") <= F.col("other")) & (F.col("only").isNull() | (F.col("only") != F.col("label"))))
    else:
        met = own.join(matrix, "hash")
    asked = stored(shared_enough(met, "other", "node", "label", "size").withColumnRenamed("other", "group"), "asked")
    chunks = asked.groupBy("group").agg(F.ceil(F.sum("size") / GROUP_SHINGLES).alias("chunks"))
    queries = asked.join(chunks, "group") \
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))) \
        .join(shingles, "node").select("group", "chunk", "node", "label", "shingles") \
        .toDF("group", "chunk", "node", "label", "shingles")
    extra = [] if copies is None else ["copies"]
    members = grouped.select("group", "node", "label", *extra).join(chunks, "group") \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))) \
        .join(shingles, "node").select("group", "chunk", "node", "label", "shingles", *extra)
    both = members.groupBy("group", "chunk").cogroup(queries.groupBy("group", "chunk"))
    if copies is None:
        return both.applyInPandas(lambda m, q: verify_group(m, q, percent), "a bigint, b bigint")
    return both.applyInPandas(lambda m, q: count_group(m, q, percent), "a bigint, b bigint, n bigint")


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", links: bool = False) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row; the component is named by its smallest id.

    With ``links`` also ``n_links``: how many other rows the row links with, those with the same set included.
    Every candidate pair of different sets is then verified, also within a class, and counted where it is found.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sets = stored(document_sets(docs, n, percent, id_col, text_col), "sets")
    total = sets.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (TOKEN_BYTES * BUCKET_TOKENS) + 1)
    repeated = stored(repeated_tokens(sets, buckets), "repeated")
    tokens = stored(with_hubs(stored(kept_tokens(sets, repeated), "kept")), "tokens")
    shingles = stored(node_sets(docs, sets, tokens.select("node").distinct(), n, id_col, text_col), "shingles")
    first = stored(hub_links(tokens, shingles, percent), "hub-links")
    classes = connected(first)
    labels = stored(tokens.select("node").distinct().join(classes, "node", "left")
                    .select("node", F.coalesce("label", "node").alias("label")), "labels")
    smallest = sets.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    if links:
        smallest = stored(smallest, "copies")
        second = stored(group_links(tokens, shingles, labels, percent, smallest.select("node", "copies")), "links")
        counted = second.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        smallest = smallest.join(counted, "node", "left") \
            .withColumn("n_links", F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1)
    else:
        second = group_links(tokens, shingles, labels, percent)
    classes = connected(first.union(second.select("a", "b")))
    extra = ["n_links"] if links else []
    smallest = smallest.join(classes, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"), *extra)
    named = smallest.join(smallest.groupBy("label").agg(F.min("low").alias("component_id")), "label") \
        .select("node", "component_id", *extra)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return sets.select("id", "n_shingles", "node").join(named, "node", "left") \
        .select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in extra])
