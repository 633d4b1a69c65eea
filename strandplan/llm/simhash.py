"""Near-duplicates by SimHash, linked by a self-join of the binary trie of fingerprints.

The fingerprint of a text: A-Z lower-cased, words are runs of other bytes than ASCII white space, shingles are three
words joined by spaces, repeats included (the whole sequence if there are fewer words); a bit is 1 if it is set in over
half of the shingles' XXH64 (seed 42).  Texts without words have fingerprint zero and are linked like any other.

Fingerprints are leaves of a binary trie.  Two that differ in three bits agree in one of four blocks of 16 bits, so there
are four tries, of the fingerprint rotated by a block each time, and a pair meets below a node whose path is the block
that it agrees in.  Tries are dealt out by the top of that path: four rows for each fingerprint, however many there are.
A task traverses the node pairs below each block together, adding up the bits in which their paths differ and dropping a
pair once it exceeds the budget.  As only components are asked
for, a task keeps a spanning forest of its links, so a dense cluster doesn't leave it as all its pairs.

Null texts are empty.  Rows with equal fingerprints are one node, however many they are; repeated rows are among them and
each returned.  All shingles of a text count, however long it is.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import materialise, whole_text
from strandplan.llm.components import connected_components

WORDS, SEED, BUDGET = 3, 42, 3
#: Blocks of a fingerprint, one more than the budget, and their bits.
BLOCKS, BLOCK_BITS = BUDGET + 1, 64 // (BUDGET + 1)
#: Fingerprints that a task should hold of a trie.
SUBTREE = 65_536
#: Node pairs of the traversal held at once, and pairs of leaves below which a node pair is compared at once.
FRONTIER, LEAVES = 1 << 17, 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text, unsigned."""
    parts = text.lower().split()
    n = len(parts) - words + 1
    if not parts:
        return 0
    joined = b" ".join(parts)
    if n < 2:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    return int.from_bytes(majority(hashes), "big")


def majority(hashes: np.ndarray) -> bytes:
    """Bits that are set in over half of the rows of bytes."""
    n, width = hashes.shape
    place = 256 * np.arange(width)
    set_bits = np.zeros((width, 8), np.int64)
    for at in range(0, n, 65_536):
        set_bits += np.bincount((hashes[at : at + 65_536] + place).ravel(), minlength=256 * width).reshape(width, 256) @ _BITS
    return np.packbits(2 * set_bits.ravel() > n).tobytes()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


class Trie:
    """A subtree: its leaves in order; a node is a range of them at a level."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.leaves = leaves
        self.ones: dict[int, np.ndarray] = {}

    def middle(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the children with ``bit`` set begin in the nodes [lo, hi)."""
        if bit not in self.ones:
            self.ones[bit] = np.concatenate((np.zeros(1, np.int32), np.cumsum((self.leaves >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)))
        return hi - (self.ones[bit][hi] - self.ones[bit][lo])


def below_blocks(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Node pairs below equal paths: for each value >> bits in both, its range in ``left`` and in ``right``, nothing spent."""
    one, two = left >> np.uint64(bits), right >> np.uint64(bits)
    path = np.intersect1d(one, two)
    ends = [np.searchsorted(x, path, side=side) for x in (one, two) for side in ("left", "right")]
    return np.stack([*ends, np.zeros(len(path), np.int64)]).astype(np.int64)


def trie_links(left: np.ndarray, right: np.ndarray | None, top: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs of leaves that agree above bit ``top`` and differ in ``budget`` bits or fewer.

    ``left`` and ``right`` are sorted without repeats.  ``right`` None: the pairs i < j within ``left``.
    """
    one = right is None
    a, b = Trie(left), Trie(left if one else right)
    b = a if one else b
    stack = [(top, below_blocks(a.leaves, b.leaves, top + 1) if top < 63 else np.array([[0], [len(a.leaves)], [0], [len(b.leaves)], [0]], np.int64))]
    while stack:
        bit, nodes = stack.pop()
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            stack += [(bit, nodes[:, :half]), (bit, nodes[:, half:])]
            continue
        few = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= LEAVES
        if bit < 0:
            few[:] = True
        if few.any():
            yield from _compare(a.leaves, b.leaves, nodes[:, few], one, budget)
            nodes = nodes[:, ~few]
        if not nodes.shape[1]:
            continue
        alo, ahi, blo, bhi, errors = nodes
        amid, bmid = a.middle(alo, ahi, bit), b.middle(blo, bhi, bit)
        twin = (alo == blo) & one
        children = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, errors]),
                np.stack([amid, ahi, bmid, bhi, errors]),
                np.stack([alo, amid, bmid, bhi, errors + 1]),
                np.stack([amid, ahi, blo, bmid, errors + 1])[:, ~twin],
            ],
            axis=1,
        )
        children = children[:, (children[4] <= budget) & (children[1] > children[0]) & (children[3] > children[2])]
        if children.shape[1]:
            stack.append((bit - 1, children))


def _compare(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, one: bool, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide = nodes[3] - nodes[2]
    sizes = (nodes[1] - nodes[0]) * wide
    node = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i, j = nodes[0][node] + at // wide[node], nodes[2][node] + at % wide[node]
    near = np.bitwise_count(left[i] ^ right[j]) <= budget
    if one:
        near &= i < j
    if near.any():
        yield i[near], j[near]


class Forest:
    """Union-find that keeps the edges which joined two trees."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)
        self.kept: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        roots = self.roots()
        apart = roots[i] != roots[j]
        parent = self.parent.tolist()
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            p, q = x, y
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.kept.append((x, y))
        self.parent = np.array(parent)


def _block_links(table: pa.Table) -> pa.Table:
    """Links of one rotation's fingerprints that agree in their top block; rows: turn, path, fp (rotated)."""
    nodes = np.unique(table.column("fp").to_numpy().view(np.uint64))
    turn = table.column("turn")[0].as_py()
    forest = Forest(len(nodes))
    for i, j in trie_links(nodes, None, 63 - BLOCK_BITS):
        forest.add(i, j)
    if not forest.kept:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    bits = np.uint64(BLOCK_BITS * turn)
    back = nodes if not turn else (nodes >> bits) | (nodes << (np.uint64(64) - bits))
    u, v = (back[list(side)].view(np.int64) for side in zip(*forest.kept, strict=True))
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


def near_links(nodes: DataFrame) -> DataFrame:
    """(u, v): links that connect exactly what all pairs of distinct ``fp`` within the budget connect.

    The number of levels that are dealt out follows the number of fingerprints, up to the block's.
    """
    levels = min(BLOCK_BITS, max(4, (nodes.count() // SUBTREE).bit_length()))
    turned = [F.col("fp"), *(F.shiftleft("fp", BLOCK_BITS * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - BLOCK_BITS * k)) for k in range(1, BLOCKS))]
    dealt = nodes.select(F.posexplode(F.array(*turned)).alias("turn", "fp"))
    dealt = dealt.withColumn("path", F.shiftrightunsigned("fp", 64 - levels).cast("int"))
    return dealt.groupBy("turn", "path").applyInArrow(_block_links, "u long, v long")


def near_components(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fp of ``rows``(doc_id, fp).

    component_id is the smallest doc_id that links reach, null if there is none; root names the component itself.
    """
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    found = connected_components(near_links(classes.select("fp")))
    named = materialise(classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")), "simhash-named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialise(fingerprints(docs), "simhash-fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(near_components(rows), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
