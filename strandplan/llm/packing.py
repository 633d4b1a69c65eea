"""Packing of documents into sequences by order-preserving dynamic programming.

A task lays the ids of its documents end to end and chooses where to cut.  Cuts may lie at document ends, at sentence
ends (``sentence_penalty``: a document is truncated there) and, at ``forced_penalty``, within sentences at multiples
of ``stride`` ids.  Over all chains of cuts no further apart than ``capacity`` it minimises padding
plus penalties:

    cost(j) = penalty(j) + min over i with 0 < p(j) - p(i) <= capacity of cost(i) + capacity - (p(j) - p(i))

The minimum of cost(i) + p(i) over that moving range comes from a monotone queue, so a chunk takes linear time.  A
sequence whose length is a power of two needs no padding, which the end of a stream makes use of: what remains there is
cut into powers of two while this costs less than padding it.  The last sequence of a chunk is carried into the next,
so only a task's last one is short for want of documents.

Null and empty texts are a single closing id.  Rows repeated, or without doc_id, are packed like any other.  A very long text
is turned into ids whole and fills as many sequences as it needs.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandplan.llm.bpe import IdCache, word_bpe
from strandplan.llm.common import whole_text

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    closing_id: int = 1
    sentence_penalty: int = 2
    forced_penalty: int = 6
    stride: int = 16
    #: Ids that a task cuts at once.
    chunk: int = 1 << 20
    tokenizer: str | None = None


@dataclass
class Segment:
    """Ids of a document, from its id number ``start`` on."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


def candidates(segments: list[Segment], sentence_ends: np.ndarray, at: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where a cut may lie, 0 first and the total last, and their penalties."""
    ids = np.concatenate([s.ids for s in segments])
    ends = np.cumsum([len(s.ids) for s in segments])
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[np.flatnonzero(sentence_ends[ids]) + 1] = at.sentence_penalty
    penalty[ends] = penalty[0] = 0
    grid = penalty[:: at.stride]
    grid[grid < 0] = at.forced_penalty
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def cut(places: np.ndarray, penalties: np.ndarray, capacity: int) -> list[int]:
    """Places of the cheapest chain of cuts from the first to the last place."""
    p, fee = places.tolist(), penalties.tolist()
    n = len(p)
    before = [0] * n
    keys = [0] * n  # cost(i) + p(i), for the queue
    queue, head = [0], 0
    for j in range(1, n):
        here = p[j]
        low = here - capacity
        while p[queue[head]] < low:
            head += 1
        i = queue[head]
        before[j] = i
        key = keys[i] + capacity + fee[j]
        keys[j] = key
        # cost(j) + p(j) = cost(i) + capacity - p(j) + p(i) + fee + p(j)
        while len(queue) > head and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chain = [n - 1]
    while chain[-1]:
        chain.append(before[chain[-1]])
    return [p[k] for k in reversed(chain)]


def cut_rest(length: int, at: Settings) -> list[int]:
    """Lengths of the sequences made of a stream's last ``length`` ids: powers of two while they save padding."""
    out: list[int] = []
    while length:
        power = 1 << (length.bit_length() - 1)
        rest = length - power
        if power >= at.capacity or at.capacity - length <= at.forced_penalty * rest.bit_count():
            out.append(length)
            break
        out.append(power)
        length = rest
    return out


class Packer:
    """The stream of one task."""

    def __init__(self, at: Settings, first_sequence: int) -> None:
        self.at, self.sequence = at, first_sequence
        bpe = word_bpe(at.tokenizer)
        self.cache = IdCache(bpe)
        self.sentence_ends = np.zeros(max(bpe.library.get_vocab_size(True), at.closing_id + 1), bool)
        self.sentence_ends[bpe.sentence_ends] = True
        self.held: list[Segment] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(self.cache.text(text) + self.at.closing_id.to_bytes(4, "little"), "<u4")
        self.held.append(Segment(doc_id, 0, len(ids), ids))
        self.size += len(ids)
        if self.size >= self.at.chunk:
            yield self.flush(False)

    def flush(self, last: bool) -> pa.RecordBatch:
        """Give the sequences of what is held; all but the last one unless this is the stream's end."""
        at, segments = self.at, self.held
        cuts = cut(*candidates(segments, self.sentence_ends, at), at.capacity)
        if last:
            for length in cut_rest(cuts[-1] - cuts[-2], at)[:-1]:
                cuts.insert(-1, cuts[-2] + length)
        else:
            cuts.pop()
        rows: list[tuple] = []
        ends = np.cumsum([len(s.ids) for s in segments])
        edges = np.array(cuts)
        stops = np.unique(np.concatenate([edges, ends[ends < edges[-1]]]))
        starts = stops[:-1]
        for a, b, k, window in zip(starts.tolist(), stops[1:].tolist(), np.searchsorted(ends, starts, side="right").tolist(), (np.searchsorted(edges, starts, side="right") - 1).tolist(), strict=True):
            s = segments[k]
            inside = a - int(ends[k]) + len(s.ids)
            rows.append((s.doc_id, s.start + inside, b - a, zlib.crc32(s.ids[inside : inside + b - a]), s.doc_tokens, self.sequence + window, a - cuts[window]))
        self.sequence += len(cuts) - 1
        self.held, self.size = self._rest(segments, ends, cuts[-1]), int(ends[-1]) - cuts[-1]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(_ARROW), schema=_ARROW)

    @staticmethod
    def _rest(segments: list[Segment], ends: np.ndarray, place: int) -> list[Segment]:
        out: list[Segment] = []
        for k in range(int(np.searchsorted(ends, place, side="right")), len(segments)):
            s = segments[k]
            skip = max(0, place - int(ends[k]) + len(s.ids))
            out.append(Segment(s.doc_id, s.start + skip, s.doc_tokens, s.ids[skip:].copy()))
        return out


def _pack_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(at, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from packer.add(doc_id, text)
        if packer.held:
            yield packer.flush(True)

    return run


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence's pieces lie in one partition of ``docs``, in its order; sequence_id holds the partition's number from
    bit 36 on, so a task that is run again gives the same sequences.
    """
    rows = docs.select(docs.doc_id.cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_pack_batches(settings), PIECES)
