"""Removal of near copies by SimHash: links of :mod:`simhash`, and similar texts that differ in more bits.

Two texts are near copies if their fingerprints link (three-word shingles, three bits), or if the Jaccard similarity of
their sets of five-word shingles is ``similarity`` or more.  Fingerprints of texts of similarity 0.8 differ in about a
seventh of their bits, so the latter get ``bands`` fingerprints of 32 bits and a sketch of 64.  The binary trie
self-join runs over each band, as that of fingerprints below blocks that agree, of eight bits here; pairs of texts within
``budget`` bits in some band and ``sketch_bits`` in the sketch are verified by their sets of shingles, which are computed
once for each text.  A pair of similarity 0.8 is within three bits in a band with probability 0.26, in one of twelve with
0.97, and of 0.85 with 0.998.

A task that finds more than ``crowd`` texts linked together passes on the links of a smallest spanning forest by sketch
distance, else all of them; so a large group of near copies doesn't leave it as all its pairs.  Where the verified links
leave such a crowd in several groups, its further candidates in different groups are found and verified in tiles: first
within parts of the crowd of bounded size, then between its texts outside its largest group, in parts, and all its parts.
Parts travel as one row each, and a tile returns only links that join groups, so pairs are never rows.

Null texts are empty.  Texts without words are near copies of each other.  Rows without doc_id are only linked by
fingerprint, to rows with one and among themselves; doc_id is taken to name one text otherwise, and of rows that repeat
one a single row stays.  Sets hold all shingles of a text, however long it is.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandplan.llm.common import materialise, own_name, utf8, whole_text
from strandplan.llm.components import connected_components
from strandplan.llm.simhash import Forest, fingerprint, majority, near_components, trie_links


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 12
    budget: int = 3
    sketch_bits: int = 20
    #: Texts that a task should hold of a band's trie.
    subtree: int = 1 << 17
    #: Texts in a block beyond twice which it is split into parts of so many.
    part: int = 1 << 15
    crowd: int = 64
    #: Links held at once before those of crowds are reduced.
    held: int = 500_000
    #: Documents of a crowd, and bytes of their sets, that a part should hold; a task verifies the pairs of two parts.
    tile: int = 2048
    tile_bytes: int = 4 << 20
    #: Bound on rows of ids that are broadcast; beyond it they are joined by a shuffle.
    broadcast_ids: int = 2_000_000


#: Blocks of a band, one more than the budget of bits, and the bits of a block.
_BLOCKS, _BLOCK_BITS = 4, 8
_ENTRY = np.dtype([("value", "<u4"), ("sketch", "<u8"), ("doc", "<i8")])
#: Fixed odd multipliers that make further hashes of a shingle's.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; of the whole sequence if it has fewer words, none without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), ">u8").astype(np.uint64)


def signature(text: bytes, at: Settings) -> bytes | None:
    """The sketch and the bands of a text's set of shingles; null if it has no words."""
    base = np.unique(shingles(text, at.words))
    return _sign(base, at) if len(base) else None


def _sign(base: np.ndarray, at: Settings) -> bytes:
    mixed = np.empty((len(base), 1 + (at.bands + 1) // 2), np.uint64)
    for k in range(mixed.shape[1]):
        column = (base ^ _ODD[k % 8]) * _ODD[(k + 3 + k // 8) % 8]
        column ^= column >> np.uint64(32)
        mixed[:, k] = column * _ODD[(k + 5) % 8]
    return majority(mixed.view(np.uint8))[: 8 + 4 * at.bands]


def _print_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            prints = np.array([fingerprint(t) for t in texts], np.uint64)
            signs = pa.array([signature(t, at) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), signs], ["doc_id", "fp", "signature"])

    return run


def _turned(signs: np.ndarray, at: Settings) -> Iterator[tuple[int, int, np.ndarray]]:
    """Band, turn and values of the band rotated by so many blocks."""
    for band in range(at.bands):
        value = np.ascontiguousarray(signs[:, 8 + 4 * band : 12 + 4 * band]).view("<u4")[:, 0]
        for turn in range(_BLOCKS):
            bits = np.uint32(_BLOCK_BITS * turn)
            yield band, turn, value if not turn else (value << bits) | (value >> (np.uint32(32) - bits))


def _signs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _size_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many texts each block of each band has, as one row for each of a bounded number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((at.bands, _BLOCKS, 1 << _BLOCK_BITS), np.int64)
        for batch in batches:
            for band, turn, value in _turned(_signs(batch), at):
                total[band, turn] += np.bincount(value >> np.uint32(32 - _BLOCK_BITS), minlength=1 << _BLOCK_BITS)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["block", "n"])

    return run


def _block_batches(at: Settings, levels: int, crowded: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deal out texts by band, turn and the path of their trie; a row holds many texts.

    The texts of a crowded block are split, by a hash of doc, into as many parts as told; each pair of parts is dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _signs(batch)
            entries = np.zeros(batch.num_rows, _ENTRY)
            entries["doc"], entries["sketch"] = batch.column("doc").to_numpy(), np.ascontiguousarray(signs[:, :8]).view("<u8")[:, 0]
            lot = (entries["doc"].astype(np.uint64) * _ODD[3]) >> np.uint64(40)
            rows: list[tuple] = []
            for band, turn, value in _turned(signs, at):
                entries["value"] = value
                block = (value >> np.uint32(32 - _BLOCK_BITS)).astype(np.int64)
                key = (band * _BLOCKS + turn) << _BLOCK_BITS
                split = np.array([crowded.get(key + k, 1) for k in range(1 << _BLOCK_BITS)])[block]
                path = np.where(split > 1, (1 << _BLOCK_BITS) + block, block >> (_BLOCK_BITS - levels))
                part = lot.astype(np.int64) % split
                order = np.lexsort((part, path))
                for own in np.split(order, np.flatnonzero((np.diff(path[order]) != 0) | (np.diff(part[order]) != 0)) + 1):
                    if len(own):
                        p, i, data = int(path[own[0]]), int(part[own[0]]), entries[own].tobytes()
                        rows += [(band, turn, p, min(i, j), max(i, j), i > j, data) for j in range(int(split[own[0]]))]
            kinds = (*(pa.int32(),) * 5, pa.bool_(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["band", "turn", "path", "p", "q", "second", "data"])

    return run


class Links:
    """Links between places, with their distances; those among a crowd are reduced to a smallest spanning forest."""

    def __init__(self, size: int, at: Settings) -> None:
        self.size, self.at = size, at
        self.parts: list[np.ndarray] = []
        self.count = 0
        self.crowded = np.zeros(size, bool)

    def add(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        self.parts.append(np.stack([i, j, distance.astype(np.int64)]))
        self.count += len(i)
        if self.count > self.at.held:
            self.reduce()

    def reduce(self) -> np.ndarray:
        links = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((3, 0), np.int64)
        forest = Forest(self.size)
        kept = []
        for d in np.unique(links[2]):
            some = links[:, links[2] == d]
            before = len(forest.kept)
            forest.add(some[0], some[1])
            new = np.array(forest.kept[before:], np.int64).reshape(-1, 2)
            kept.append(np.stack([new[:, 0], new[:, 1], np.full(len(new), d)]))
        root = forest.roots()
        self.crowded = np.bincount(root, minlength=self.size)[root] > self.at.crowd
        few = ~self.crowded[links[0]]
        links = np.concatenate([links[:, few], *kept], axis=1)
        links = np.unique(links, axis=1)
        self.parts, self.count = [links], links.shape[1]
        return links


def _leaves(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of their values, the distinct values, and where each begins (with the end)."""
    entries = np.frombuffer(b"".join(data), _ENTRY)
    entries = entries[np.argsort(entries["value"], kind="stable")]
    values, first = np.unique(entries["value"], return_index=True)
    return entries, values.astype(np.uint64), np.append(first, len(entries))


def _pair_links(at: Settings) -> Callable[[pa.Table], pa.Table]:
    """Candidates, all but of crowds, which have ``cut`` set."""

    def run(table: pa.Table) -> pa.Table:
        data, second = table.column("data").to_pylist(), table.column("second").to_pylist()
        turn, p, q = (table.column(c)[0].as_py() for c in ("turn", "p", "q"))
        a, left, a_first = _leaves([d for d, s in zip(data, second, strict=True) if not s])
        b, right, b_first = (a, None, a_first) if p == q else _leaves([d for d, s in zip(data, second, strict=True) if s])
        shift = 0 if right is None else len(a)
        nodes = a if right is None else np.concatenate([a, b])
        links = Links(len(nodes), at)

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            distance = np.bitwise_count(nodes["sketch"][i] ^ nodes["sketch"][j])
            near = distance <= at.sketch_bits
            if near.any():
                links.add(i[near], j[near], distance[near])

        if right is None and not turn:
            for lo, hi in zip(a_first[:-1].tolist(), a_first[1:].tolist(), strict=True):
                for s in range(lo, hi if hi - lo > 1 else lo, 256):
                    i, j = np.meshgrid(np.arange(s, min(s + 256, hi)), np.arange(lo, hi), indexing="ij")
                    compare(i[i < j], j[i < j])
        if len(left) and (right is None or len(right)):
            for x, y in trie_links(left, right, 31 - _BLOCK_BITS, at.budget):
                apart = left[x] ^ (left if right is None else right)[y]
                new = np.ones(len(x), bool)
                for earlier in range(turn):  # blocks that an earlier turn has on top, the lowest here
                    new &= (apart >> np.uint64(_BLOCK_BITS * earlier)) & np.uint64((1 << _BLOCK_BITS) - 1) != 0
                x, y = x[new], y[new]
                wide = b_first[y + 1] - b_first[y]
                sizes = (a_first[x + 1] - a_first[x]) * wide
                for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 18))) + 1):
                    pair = np.repeat(part, sizes[part])
                    place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
                    compare(a_first[x[pair]] + place // wide[pair], b_first[y[pair]] + place % wide[pair] + shift)
        u, v, _ = links.reduce()
        return pa.table({"u": pa.array(nodes["doc"][u]), "v": pa.array(nodes["doc"][v]), "cut": pa.array(links.crowded[u])})

    return run


def _set_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replace a text by its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, at.words)) for t in utf8(batch.column("text"))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            held = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(ends), held)], ["doc", "shingles"])

    return run


def _joining(left: pa.Table, right: pa.Table, at: Settings) -> pa.Table:
    """Links (u, v) of similar texts, one of each table, that join what all candidates in different groups join.

    The tables have (doc, group, asks, shingles, signature); pairs of texts that both ask are looked at once, u < v.
    """
    sides = (left, right)
    xs, ys = (t.column("doc").to_numpy() for t in sides)
    group = np.unique(np.concatenate([t.column("group").to_numpy() for t in sides]), return_inverse=True)[1]
    x_group, y_group = group[: len(xs)], group[len(xs) :]
    asks = right.column("asks").to_numpy()
    signs = [np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(t.num_rows, 8 + 4 * at.bands) for t in sides]
    x_sketch, y_sketch = (np.ascontiguousarray(s[:, :8]).view("<u8")[:, 0] for s in signs)
    x_bands, y_bands = (np.ascontiguousarray(s[:, 8:]).view("<u4") for s in signs)
    held = [t.column("shingles").combine_chunks() for t in sides]
    x_size, y_size = (np.diff(h.offsets.to_numpy()).astype(np.int64) for h in held)
    size = np.concatenate([x_size, y_size])
    x_first, y_first = np.split(np.cumsum(size) - size, [len(xs)])
    _, ids = np.unique(np.concatenate([h.flatten().to_numpy() for h in held]), return_inverse=True)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    kept: list[tuple[int, int]] = []
    for x, doc in enumerate(xs.tolist()):
        near = np.flatnonzero((y_group != x_group[x]) & (~asks | (ys > doc)))
        near = near[np.bitwise_count(y_sketch[near] ^ x_sketch[x]) <= at.sketch_bits]
        if len(near):
            near = near[np.bitwise_count(y_bands[near] ^ x_bands[x]).min(axis=1) <= at.budget]
        if not len(near):
            continue
        mine = ids[x_first[x] : x_first[x] + x_size[x]]
        mark[mine] = 1
        begin = np.cumsum(y_size[near]) - y_size[near]
        theirs = np.arange(int(y_size[near].sum())) + np.repeat(y_first[near] - begin, y_size[near])
        both = np.add.reduceat(mark[ids[theirs]], begin)
        mark[mine] = 0
        for y in near[both >= at.similarity * (x_size[x] + y_size[near] - both)].tolist():
            if (old := y_group[y]) != (new := x_group[x]):
                kept.append((doc, int(ys[y])))
                x_group[x_group == old] = new
                y_group[y_group == old] = new
    u, v = zip(*kept, strict=True) if kept else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _with_signatures(table: pa.Table, at: Settings) -> pa.Table:
    held = table.column("shingles").combine_chunks()
    flat = held.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(np.diff(held.offsets.to_numpy()))[:-1]
    return table.append_column("signature", pa.array([_sign(s, at) for s in np.split(flat, ends)], pa.binary()))


def _within_part(at: Settings) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        own = _with_signatures(table, at)
        return _joining(own, own, at)

    return run


def _packed_part(at: Settings) -> Callable[[pa.Table], pa.Table]:
    """A part (crowd, part, others, doc, group, asks, shingles) as one row (crowd, part, others, data)."""

    def run(table: pa.Table) -> pa.Table:
        own = _with_signatures(table.select(["doc", "group", "asks", "shingles"]), at)
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), own.schema) as out:
            out.write_table(own)
        return table.select(["crowd", "part", "others"]).slice(0, 1).append_column("data", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    return run


def _between_parts(at: Settings) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:  # the hash left the other part empty
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        left, right = (pa.ipc.open_stream(table.filter(pc.equal(table.column("second"), second)).column("data")[0].as_py()).read_all() for second in (False, True))
        return _joining(left, right, at)

    return run


def _candidates(signed: DataFrame, at: Settings) -> DataFrame:
    """(u, v, cut) from signed(doc, signature)."""
    levels = min(_BLOCK_BITS, max(2, (signed.count() // at.subtree).bit_length()))
    sizes = signed.select("signature").mapInArrow(_size_batches(at), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    crowded = {r.block: -(-r.n // at.part) for r in sizes.where(F.col("n") > 2 * at.part).collect()}
    blocks = signed.mapInArrow(_block_batches(at, levels, crowded), "band int, turn int, path int, p int, q int, second boolean, data binary")
    found = blocks.groupBy("band", "turn", "path", "p", "q").applyInArrow(_pair_links(at), "u long, v long, cut boolean")
    return materialise(found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("cut").alias("cut")), "near-pairs")


def _sets(pairs: DataFrame, texts: DataFrame, at: Settings) -> DataFrame:
    """(doc, shingles) of the texts(doc, text) in pairs(u, v)."""
    asked = pairs.select(F.col("u").alias("doc")).union(pairs.select("v")).distinct()
    asked = F.broadcast(asked) if asked.count() <= at.broadcast_ids else asked
    return materialise(texts.join(asked, "doc", "left_semi").select("doc", "text").mapInArrow(_set_batches(at), "doc long, shingles array<long>"), "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame, at: Settings) -> DataFrame:
    """The pairs(u, v) whose sets(doc, shingles) are similar."""
    mine = sets.select(F.col("doc").alias("u"), F.col("shingles").alias("mine"))
    theirs = sets.select(F.col("doc").alias("v"), F.col("shingles").alias("theirs"))
    # both >= similarity * (mine + theirs - both), in whole millionths
    whole, least = 1_000_000, round(at.similarity * 1_000_000)
    both = F.size(F.array_intersect("mine", "theirs")).cast("long")
    alike = both * (whole + least) >= (F.size("mine") + F.size("theirs")).cast("long") * least
    return materialise(pairs.select("u", "v").join(mine, "u").join(theirs, "v").where(alike).select("u", "v"), "near-verified")


def _small(rows: DataFrame, at: Settings) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= at.broadcast_ids else rows


def _apart(crowds: DataFrame, similar: DataFrame, at: Settings) -> DataFrame:
    """(doc, crowd, group, asks, parts, asking_parts) of the crowds(doc, crowd, bytes) that are several groups still.

    Texts outside a crowd's largest group ask.  The numbers of parts are those of all its texts and of those that ask.
    """
    groups = connected_components(similar).select(F.col("node").alias("doc"), F.col("component").alias("group"))
    now = materialise(crowds.join(groups, "doc", "left").withColumn("group", F.coalesce("group", "doc")), "near-groups")
    sizes = now.groupBy("crowd", "group").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("crowd").agg(F.max(F.struct("n", "group", "bytes")).alias("most"), F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, size: F.greatest(F.ceil(n / at.tile), F.ceil(size / at.tile_bytes), F.lit(1)).cast("int")
    asking = parts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    state = materialise(sizes.where("groups > 1").select("crowd", F.col("most.group").alias("main"), parts(F.col("n"), F.col("bytes")).alias("parts"), asking.alias("asking_parts")), "near-apart")
    return materialise(now.join(_small(state, at), "crowd").select("doc", "crowd", "group", (F.col("group") != F.col("main")).alias("asks"), "parts", "asking_parts"), "near-asking")


def _linked_within(apart: DataFrame, sets: DataFrame, at: Settings) -> DataFrame:
    """(u, v): links that join groups within the parts of crowds; there every text asks."""
    rows = apart.select("doc", "crowd", "group", F.lit(True).alias("asks"), F.pmod(F.xxhash64("doc"), "parts").alias("part"))
    found = rows.join(sets, "doc").groupBy("crowd", "part").applyInArrow(_within_part(at), "u long, v long")
    return materialise(found, "near-within")


def _linked_between(apart: DataFrame, sets: DataFrame, at: Settings) -> DataFrame:
    """(u, v): links that join groups between the parts of texts that ask and all parts of a crowd."""

    def packed(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.select("doc", "crowd", "group", "asks", F.pmod(F.xxhash64("doc"), own).alias("part"), F.col(other).alias("others")).join(sets, "doc")
        return rows.groupBy("crowd", "part").applyInArrow(_packed_part(at), "crowd long, part long, others int, data binary")

    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("others").cast("long") - 1))
    left = packed(apart.where("asks"), "asking_parts", "parts").select("crowd", F.col("part").alias("a"), each.alias("b"), F.lit(False).alias("second"), "data")
    right = packed(apart, "parts", "asking_parts").select("crowd", each.alias("a"), F.col("part").alias("b"), F.lit(True).alias("second"), "data")
    whole = left.unionByName(right).groupBy("crowd", "a", "b").applyInArrow(_between_parts(at), "u long, v long")
    return materialise(whole, "near-between")


def similar_links(signed: DataFrame, texts: DataFrame, at: Settings) -> DataFrame:
    """(u, v): pairs of doc_ids from signed(doc, signature) whose texts(doc, text) are similar.

    They connect what all similar candidates connect, but aren't all of these.
    """
    pairs = _candidates(signed.select("doc", "signature"), at)
    sets = _sets(pairs, texts, at)
    similar = _verified(pairs, sets, at)
    cut = pairs.where("cut")
    if cut.isEmpty():
        return similar
    weight = sets.groupBy("doc").agg(F.sum(8 * F.size("shingles")).alias("bytes"))
    crowds = connected_components(cut).select(F.col("node").alias("doc"), F.col("component").alias("crowd"))
    crowds = materialise(crowds.join(weight, "doc"), "near-crowds")
    apart = _apart(crowds, similar, at)
    if apart.isEmpty():
        return similar
    similar = similar.union(_linked_within(apart, sets, at))
    if apart.where("parts > 1").isEmpty():
        return similar
    apart = _apart(crowds, similar, at).where("parts > 1")
    return similar if apart.isEmpty() else similar.union(_linked_between(apart, sets, at))


def drop_near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id.

    Groups are what links connect.  Of rows that repeat a doc_id one stays; a group without any doc_id keeps one row.
    """
    at = settings
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), whole_text().alias("text"))
    rows = materialise(texts.mapInArrow(_print_batches(at), "doc_id long, fp long, signature binary"), "near-prints")
    known = rows.where("doc_id IS NOT NULL")
    linked = materialise(near_components(rows), "near-components")
    signed = materialise(known.where("signature IS NOT NULL").groupBy("signature").agg(F.min("doc_id").alias("doc"), F.count("*").alias("size")), "near-signed")
    same = known.join(signed.where("size > 1"), "signature").select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))
    bits = known.join(linked, "fp").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    similar = similar_links(signed.select("doc", "signature"), texts.select(F.col("doc_id").alias("doc"), "text"), at)
    groups = connected_components(bits.unionByName(same).unionByName(similar).where("u <> v"))
    other, prints, name = (own_name(docs.columns, c) for c in ("id", "fp", "root"))
    dropped = materialise(groups.where("node <> component").select(F.col("node").alias(other)), "near-dropped")

    out = docs.where("doc_id IS NOT NULL").join(dropped, doc_id == F.col(other), "left_anti")
    again = materialise(known.groupBy(F.col("doc_id").alias(other)).count().where("count > 1").select(other), "near-repeated")
    if not again.isEmpty():
        repeated = out.join(again, doc_id == F.col(other), "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, doc_id == F.col(other), "left_anti").unionByName(repeated)
    alone = linked.where("component_id IS NULL").select(F.col("fp").alias(prints), F.col("root").alias(name))
    if not alone.isEmpty():  # groups without any doc_id
        no_id = docs.where("doc_id IS NULL")
        no_id = no_id.mapInArrow(_with_fingerprint(prints), T.StructType([*no_id.schema, T.StructField(prints, T.LongType())]))
        no_id = no_id.join(alone, prints).dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in docs.columns))
        out = out.unionByName(no_id)
    return out


def _with_fingerprint(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, name])

    return run
