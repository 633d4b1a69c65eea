"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased and runs of white space become one space; lengths count characters of such a text.  A benchmark
item is looked for by patterns: the item itself if it has up to ``window`` characters, else windows of that length at
every ``stride`` and at its end.  A pattern of m characters occurs in a document if a part of the document is within
edit distance e = floor(rate * m) of it.  By the q-gram lemma such a part shares at least m + 1 - q * (e + 1) q-grams
with the pattern, on diagonals that differ by at most e; shared q-grams are counted in bands of 2 * (e + 1) diagonals
that overlap by half, so a match lies wholly in one of them.  Bands that reach the bound are aligned, in batches, by
dynamic programming over the band's diagonals only.

Items whose bound isn't positive (under about 5 * q characters) are looked for with the largest budget that keeps it
positive, down to verbatim; items shorter than q are looked for verbatim by their whole text, and empty ones never.
Null texts are empty; items with a null item_id or text are ignored.  The index of items is broadcast in blocks of at
most ``block_chars`` characters, and the documents are scanned once for each block, so benchmarks of any size are borne.
Repeated rows are each reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandplan.llm.common import own_name

_HITS = T.ArrayType(T.StructType().add("item_id", "long").add("edits", "integer").add("start", "long").add("length", "integer"))
_HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("length", pa.int32())]))
_BASE = 0x9E3779B97F4A7C15
_APART = "\U0010ffff"  # a noncharacter: stands between texts and beyond their ends


@dataclass(frozen=True)
class Settings:
    q: int = 8
    rate: float = 0.1
    window: int = 120
    stride: int = 60
    #: Benchmark characters in one broadcast index.
    block_chars: int = 4_000_000
    #: Characters of documents that are looked at together; longer texts are cut into overlapping parts.
    part_chars: int = 1 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all q-grams, by doubling."""
    n = len(chars) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, have = np.zeros(n, np.uint64), 0
    power, size = chars.astype(np.uint64), 1
    while True:
        if q & size:  # append the next `size` characters
            out = out * np.uint64(pow(_BASE, size, 2**64)) + power[have : have + n]
            have += size
        if have == q:
            return out ^ (out >> np.uint64(29))
        power = power[:-size] * np.uint64(pow(_BASE, size, 2**64)) + power[size:]
        size *= 2


class PatternIndex:
    """Patterns of one block of items and the places of their q-grams."""

    FILTER_BITS = 22

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds all items that are shorter than q at once."""
        same = defaultdict(list)
        for item_id, text in self.short:
            same[text].append(item_id)
        out = ahocorasick.Automaton()
        for text, item_ids in same.items():
            out.add_word(text, (item_ids, len(text)))
        out.make_automaton()
        return out

    def __init__(self, items: list[tuple[int, str]], settings: Settings) -> None:
        self.settings = at = settings
        self.item: list[int] = []
        self.pattern: list[np.ndarray] = []
        self.short: list[tuple[int, str]] = []
        for item_id, raw in sorted(items):
            text = normalise(raw)
            if 0 < len(text) < at.q:
                self.short.append((item_id, text))
                continue
            starts = [0] if len(text) <= at.window else sorted({*range(0, len(text) - at.window, at.stride), len(text) - at.window})
            for s in starts if len(text) >= at.q else []:
                self.item.append(item_id)
                self.pattern.append(codes(text[s : s + at.window]))
        self.length = np.array([len(p) for p in self.pattern], np.int64)
        self.edits = np.minimum((self.length * at.rate).astype(np.int64), np.maximum(self.length // at.q - 1, 0))
        self.bound = np.maximum(self.length + 1 - at.q * (self.edits + 1), 1)
        hashes = [grams(p, at.q) for p in self.pattern]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.which, self.place = which[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - self.FILTER_BITS)] = True

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, pattern, place in the pattern) of all shared q-grams."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - self.FILTER_BITS)])
        if not len(at) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        real = self.keys[key] == hashes[at]
        at, key = at[real], key[real]
        many = self.many[key]
        entry = np.repeat(self.first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.which[entry], self.place[entry]


def align(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to a part of its text within the band, and where that part ends.

    patterns: rows of codes, padded at the end; texts: rows that begin where the band's first diagonal meets the
    pattern's begin, as long as a pattern plus the band.  Distances above ``limits`` mean no match.
    """
    rows, width = texts.shape[0], texts.shape[1] - patterns.shape[1] + 1
    ramp = np.arange(width, dtype=np.int32)
    now = np.zeros((rows, width), np.int32)
    best, end = np.full(rows, 1 << 20, np.int32), np.zeros(rows, np.int64)
    for i in range(int(lengths.max())):
        step = now + (texts[:, i : i + width] != patterns[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)
        now = np.minimum.accumulate(step - ramp, axis=1) + ramp
        done = np.flatnonzero(lengths == i + 1)
        if len(done):
            k = now[done].argmin(axis=1)
            best[done], end[done] = now[done, k], i + 1 + k
        if i % 32 == 31 and (now.min(axis=1) > limits).all():
            break
    return best, end


def find(texts: list[str], index: PatternIndex) -> list[list[dict]]:
    """The items that occur in each text; for each the match of fewest edits."""
    at = index.settings
    found: list[dict[int, tuple]] = [{} for _ in texts]
    parts: list[tuple[int, int, str]] = []
    held, overlap = 0, 2 * at.window
    for k, raw in enumerate(texts):
        text = normalise(raw)
        for last, (item_ids, length) in index.automaton.iter(text) if index.short else ():
            for item_id in item_ids:
                found[k].setdefault(item_id, (0, last + 1 - length, length))
        for s in range(0, max(1, len(text) - overlap), at.part_chars):
            part = text[s : s + at.part_chars + overlap]
            parts.append((k, s, part))
            held += len(part)
            if held >= at.part_chars:
                _find_in(parts, index, found)
                parts, held = [], 0
    if parts:
        _find_in(parts, index, found)
    return [[{"item_id": i, "edits": m[0], "start": m[1], "length": m[2]} for i, m in sorted(f.items())] for f in found]


def _find_in(parts: list[tuple[int, int, str]], index: PatternIndex, found: list[dict[int, tuple]]) -> None:
    at = index.settings
    chars = codes(_APART.join(p[2] for p in parts))
    begin = np.cumsum([0] + [len(p[2]) + 1 for p in parts])
    where, which, place = index.shared(grams(chars, at.q))
    if not len(where):
        return
    part = np.searchsorted(begin, where, side="right") - 1
    step = index.edits[which] + 1
    diagonal = where - begin[part] - place
    band = (diagonal + at.window) // step
    bands = int(band.max()) + 2
    key = (part * len(index.pattern) + which) * bands + band
    key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    group, band = key // bands, key % bands
    part, which = group // len(index.pattern), group % len(index.pattern)
    full = count >= index.bound[which]
    part, which, band = part[full], which[full], band[full]
    for s in range(0, len(part), 4096):
        _verify(chars, begin, part[s : s + 4096], which[s : s + 4096], band[s : s + 4096], parts, index, found)


def _verify(chars, begin, part, which, band, parts, index, found) -> None:
    edits, longest = index.edits[which], int(index.length[which].max())
    low = band * (edits + 1) - index.settings.window - edits
    width = 2 * int(edits.max() + 1) + 2 * int(edits.max()) + 1
    at = (begin[part] + low)[:, None] + np.arange(longest + width - 1)
    inside = (at >= begin[part][:, None]) & (at < begin[part + 1][:, None] - 1)
    texts = np.where(inside, chars[np.clip(at, 0, len(chars) - 1)], np.uint32(0x110001))
    patterns = np.full((len(which), longest), 0x110002, np.uint32)
    for row, p in enumerate(which):
        patterns[row, : index.length[p]] = index.pattern[p]
    best, end = align(patterns, index.length[which], texts, edits)
    for row in np.flatnonzero(best <= edits):
        k, offset, _ = parts[part[row]]
        item_id, length = index.item[which[row]], int(index.length[which[row]])
        match = (int(best[row]), max(0, int(offset + low[row] + end[row] - length)), length)
        if item_id not in found[k] or match < found[k][item_id]:
            found[k][item_id] = match


def _find_batches(shared, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = find([t or "" for t in batch.column("text").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, _HITS_ARROW)], [*batch.schema.names, name])

    return run


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """Items of each block of bounded size."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // settings.block_chars))
    for k in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def _with_hits(docs: DataFrame, items: list[tuple[int, str]], settings: Settings, name: str) -> DataFrame:
    """``docs`` with the column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(PatternIndex(items, settings))
    return docs.mapInArrow(_find_batches(shared, name), T.StructType([*docs.schema, T.StructField(name, _HITS)]))


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, edits, start, length): every item that occurs in a row of ``docs``.

    start: about where the match of fewest edits begins in the normalised text; length: characters of its pattern.
    """
    rows, out = docs.select("doc_id", "text"), None
    for items in _blocks(benchmark, settings):
        block = _with_hits(rows, items, settings, "hits").select("doc_id", F.inline("hits"))
        out = block if out is None else out.unionByName(block)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    name = own_name(docs.columns, "hits")
    for items in _blocks(benchmark, settings):
        docs = _with_hits(docs, items, settings, name).where(F.size(name) == 0).drop(name)
    return docs
