"""Near-duplicate passages by compact windows.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; the tokens of a text are its shingles of five
words.  For each of ``hashes`` hash functions the Cartesian tree over the tokens' hashes gives compact windows
(l, c, r): every subsequence from between l and c to between c and r has its minimum at c.  Only windows of at least
``shortest`` words are kept, about two for every ``shortest`` words of text and hash function.

Windows whose minimum is the same token share a signature.  Only those whose signature another text has too are looked
at further.  In a document, ``agreeing`` of them, of different functions, that hold a common sequence of the shortest
passage's tokens make a joint window, and those of equal signatures are linked: every joint window to that of the
smallest doc_id and to that of the doc_id before its own, first within a batch and then, for the batch's first and last,
over all batches.  So a passage that many documents hold makes as many links as documents, not all pairs, and a batch
passes on two rows of a signature; and documents that hold a passage's phrases apart from each other, or less of it, don't
stand between those that share it.  Verbatim passages don't rest on these links: where windows of the first hash function
share their signature with another document's, every run of the shortest passage's tokens around their minimum is a key
of its own, and is linked to the smallest doc_id that holds the whole run, again first within a batch, where links of
successive runs become one.  The links between two documents are joined by the intervals that they cover, and these are
verified against the texts: runs of common shingles, bridged over ``bridge`` of them, must hold at least ``shortest``
words and have Jaccard similarity ``similarity`` or more, or be verbatim.

Identical passages of ``shortest`` words or more share a window of the first hash function and are always found, in the
later of their texts at least.  Passages of similarity 0.8 share three of five signatures with probability 0.94, and each
sequence of the shortest passage's length inside longer ones is a further trial; those that differ can still be missed
where, for every joint window that they share, the first document and the one before have the same three minima as close
together and yet are less than similar.  Texts that are equal up to case and
white space are one class: its smallest doc_id stands for it, and the others are reported as copies.  Null texts are
empty, texts of fewer than ``shortest`` words hold no passage, rows without doc_id are left out, rows that repeat doc_id
and text count once; of several texts of one doc_id that of the smallest digest counts.  Long texts are looked at in
overlapping pieces of ``chunk`` words, so every sequence of the shortest passage's words is in one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import materialise, whole_text


@dataclass(frozen=True)
class Settings:
    words: int = 5
    shortest: int = 50
    hashes: int = 5
    agreeing: int = 3
    similarity: float = 0.8
    bridge: int = 12
    #: Words that a task looks at together.
    chunk: int = 1 << 18
    #: Runs that a task compares before it passes them on.
    runs: int = 1 << 21
    #: Bound on doc_ids that are broadcast to pick texts; beyond it they are joined by a shuffle.
    broadcast_ids: int = 2_000_000

    @property
    def tokens(self) -> int:
        """Tokens of the shortest passage."""
        return self.shortest - self.words + 1


#: Fixed odd multipliers, one for each hash function.
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_PLACE_BITS = 24
_PLACES = np.uint64((1 << _PLACE_BITS) - 1)
_SPREAD = 0x5851F5  # odd: permutes the places, so that equal tokens don't make a deep tree
_UNSPREAD = pow(_SPREAD, -1, 1 << _PLACE_BITS)
_REACH = 0xFFFF  # of a window on either side of its minimum, as far as a row tells; beyond it other windows hold the rest


_BLANKS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_TOGETHER = 1 << 20  # bytes of texts that are hashed at once
#: Words of more bytes are hashed one by one.
_SHORT_WORD = 31
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _short_xxh64(eights: Callable[[int], np.ndarray], size: int) -> np.ndarray:
    """XXH64 of words of ``size`` bytes, at most 31; ``eights`` gives their eight bytes from a place on."""
    one, two, three, four, five = _PRIMES
    done = size & ~7
    out: np.ndarray = five + np.uint64(size)
    for k in range(0, done, 8):
        out = _rotated(out ^ _rotated(eights(k) * two, 31) * one, 27) * one + four
    if left := size & 7:
        last = eights(done)
        if left >= 4:
            out = _rotated(out ^ (last & np.uint64(0xFFFFFFFF)) * one, 23) * two + three
        for k in range(left & 4, left):
            out = _rotated(out ^ (last >> np.uint64(8 * k) & np.uint64(255)) * five, 11) * one
    out = (out ^ out >> np.uint64(33)) * two
    out = (out ^ out >> np.uint64(29)) * three
    return out ^ out >> np.uint64(32)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the words of all texts, those of one length at once, and how many words the texts up to each one have."""
    whole = b" ".join(texts).lower()
    raw = np.frombuffer(whole.ljust(len(whole) // 8 * 8 + 24), np.uint8)  # ends with a blank, and two eights can be read from every place
    blank = _BLANKS[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edges = np.concatenate([[0], edges])
    begin, sizes = edges[::2], edges[1::2] - edges[::2]
    aligned, out = raw.view("<u8"), np.empty(len(begin), np.uint64)
    kind = np.minimum(sizes, _SHORT_WORD + 1).astype(np.uint8)
    order, ends = np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind, minlength=_SHORT_WORD + 2)).tolist()
    for size in range(1, _SHORT_WORD + 1):
        words = order[ends[size - 1] : ends[size]]
        if len(words):
            at = begin[words]
            first, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            back = np.uint64(63) - shift
            out[words] = _short_xxh64(lambda k: aligned[first + (k >> 3)] >> shift | aligned[first + (k >> 3) + 1] << np.uint64(1) << back, size)  # noqa: B023  called at once
    for k in order[ends[_SHORT_WORD] :].tolist():
        out[k] = xxhash.xxh64_intdigest(whole[begin[k] : begin[k] + sizes[k]])
    return out, np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))


def hashed_texts(texts: Iterable[bytes], form: Callable[[np.ndarray], np.ndarray] = lambda words: words) -> Iterator[tuple[np.ndarray, int]]:
    """For every text ``form`` of its words' hashes, from its first word on, and its number of words; small texts are hashed together."""

    def together(held: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        words, ends = _hashed(held)
        formed, begin = form(words), 0
        for end in ends.tolist():
            yield formed[begin:end], end - begin
            begin = end

    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        if (size := size + len(text)) >= _TOGETHER:
            yield from together(held)
            held, size = [], 0
    if held:
        yield from together(held)


def word_hashes(text: bytes) -> np.ndarray:
    return _hashed([text])[0]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(_ODD[0])
        out ^= out >> np.uint64(29)
    return out


def _stirred(out: np.ndarray) -> np.ndarray:
    out = out * np.uint64(_ODD[0])
    out ^= out >> np.uint64(29)
    return out


def run_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` tokens from each place on, put together from hashes of 1, 2, 4, ... tokens."""
    n = max(0, len(tokens) - size + 1)
    out, taken, span, least = np.full(n, size, np.uint64), 0, 1, tokens
    while True:
        if size & span:
            out = _stirred(_stirred(out) + least[taken : taken + n])
            taken += span
        if taken == size or not n:
            return out
        least = _stirred(_stirred(least[:-span]) + least[span:])
        span *= 2


def _mixed(tokens: np.ndarray, function: int) -> np.ndarray:
    out = (tokens ^ np.uint64(_ODD[-1 - function])) * np.uint64(_ODD[function])
    out ^= out >> np.uint64(32)
    return out * np.uint64(_ODD[(function + 1) % len(_ODD)])


def compact_windows(tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray, shortest: int, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), bounds inclusive, of all windows of at least ``shortest`` tokens within the texts [begin, end)."""
    n = len(tokens)
    spread = (np.arange(n, dtype=np.uint64) * np.uint64(_SPREAD)) & _PLACES
    level = (_mixed(tokens, function) & ~_PLACES) | spread
    longest = int((ends - begins).max(initial=1))
    least = np.empty((longest.bit_length(), n), np.uint64)  # minima of the 2**k tokens from each place on
    least[0] = level
    for k in range(1, len(least)):
        half = 1 << (k - 1)
        least[k] = least[k - 1]
        np.minimum(least[k - 1][:-half], least[k - 1][half:], out=least[k][:-half])
    l, r = begins, ends - 1
    found: list[tuple[np.ndarray, ...]] = []
    while True:
        wide = r - l + 1 >= shortest
        l, r = l[wide], r[wide]
        if not len(l):
            break
        k = np.log2(r - l + 1).astype(np.int64)
        low = np.minimum(least[k, l], least[k, r - (1 << k) + 1])
        c = ((low & _PLACES) * np.uint64(_UNSPREAD) & _PLACES).astype(np.int64)
        found.append((l, c, r))
        l, r = np.concatenate([l, c + 1]), np.concatenate([c - 1, r])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_FOUND = pa.schema([(name, pa.int64()) for name in ("doc", "lo", "hi", "to_doc", "to_lo", "to_hi")])
#: A stretch of doc that to_doc has too, first and last token in one number, or a row (key, doc, span) that looks for others of its key; span is its place.
_SPANS = pa.schema([(name, pa.int64()) for name in ("doc", "span", "to_doc", "to_span")])
_SOUGHT = pa.schema([("key", pa.int64()), *_SPANS])
FOUND, SPANS, SOUGHT = (", ".join(f"{name} long" for name in schema.names) for schema in (_FOUND, _SPANS, _SOUGHT))


def _joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, to_doc: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> list[np.ndarray]:
    """The stretches that overlapping ones of the same documents cover; joining some of them first gives the same."""
    order = np.lexsort((lo, to_doc, doc))
    doc, lo, hi, to_doc, to_lo, to_hi = (x[order] for x in (doc, lo, hi, to_doc, to_lo, to_hi))
    if not len(order):
        return [doc, lo, hi, to_doc, to_lo, to_hi]
    pair = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (to_doc[1:] != to_doc[:-1]))])
    covered = np.maximum.accumulate((pair << 32) + hi)
    cut = np.flatnonzero(np.concatenate([[True], (pair[1:] << 32) + lo[1:] > covered[:-1]]))
    return [doc[cut], lo[cut], np.maximum.reduceat(hi, cut), to_doc[cut], np.minimum.reduceat(to_lo, cut), np.maximum.reduceat(to_hi, cut)]


def _span_columns(stretches: list[np.ndarray]) -> list[pa.Array]:
    doc, lo, hi, to_doc, to_lo, to_hi = stretches
    return [pa.array(x) for x in (doc, lo << 32 | hi, to_doc, to_lo << 32 | to_hi)]


def _sought_batch(stretches: list[np.ndarray], key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Stretches, and rows that look for others."""
    none, no_key = pa.nulls(len(key), pa.int64()), pa.nulls(len(stretches[0]), pa.int64())
    columns = [pa.concat_arrays(x) for x in zip(_span_columns(stretches), [pa.array(doc), pa.array(place), none, none], strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([no_key, pa.array(key)]), *columns], schema=_SOUGHT)


def _pack(c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A window's minimum and its reach on both sides in one number."""
    return (c << 32) | (np.minimum(left, _REACH) << 16) | np.minimum(right, _REACH)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> 16) & _REACH, place & _REACH


def _linked(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of (key, doc): rows, and the rows they are linked to, the first of their key and of the doc before."""
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
    leader = np.flatnonzero(new_key)[np.cumsum(new_key) - 1]
    before = np.flatnonzero(new_doc)[np.maximum(np.cumsum(new_doc) - 2, 0)]
    star = np.flatnonzero(doc != doc[leader])
    chain = star[doc[before[star]] != doc[leader[star]]]
    return np.concatenate([star, chain]), np.concatenate([leader[star], before[chain]])


#: A window whose key must be looked for in other batches, one of a key that texts of its batch share, and one of these for each key and batch.
_ALONE, _KNOWN, _SPEAKS = 0, 1, 2
_WINDOWS = pa.schema([(name, pa.int64()) for name in ("key", "doc", "place")] + [("state", pa.int8())])
WINDOWS = "key long, doc long, place long, state byte"


def _window_rows(ids: list[int], texts: list[np.ndarray], starts: list[int], at: Settings) -> pa.RecordBatch:
    """All windows of these texts, with their states.  ``starts``: which token of its document each text begins with."""
    sizes = np.array([len(t) for t in texts])
    tokens, ends = np.concatenate(texts), np.cumsum(sizes)
    begins, docs, shift = ends - sizes, np.array(ids, np.int64), np.array(starts, np.int64)
    parts = []
    for j in range(at.hashes):
        l, c, r = compact_windows(tokens, begins, ends, at.tokens, j)
        text = np.searchsorted(ends, c, side="right")
        # The function's number is the lowest digits of the signature.
        key = (tokens[c] & ~np.uint64(7) | np.uint64(j)).view(np.int64)
        parts.append((key, docs[text], _pack(c - begins[text] + shift[text], c - l, r - c)))
    key, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, doc, place = key[order], doc[order], place[order]
    first, group, several = _groups(key, doc)
    state = np.where(several[group], np.where(first, _SPEAKS, _KNOWN), _ALONE).astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, place, state)], schema=_WINDOWS)


def _groups(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of key: which are the first of their key, the number of each one's key, and which keys several docs have."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(first)
    return first, np.cumsum(first) - 1, np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key: those whose key texts of their batch share, or several rows' docs."""
    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int8))  # of the last key, until it is known to be shared
    told = False  # the row that is held stands for a shared key and has been passed on
    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        if (known := rows[3] == _KNOWN).any():
            yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in rows], schema=_WINDOWS)
        rows = tuple(np.concatenate([x, y[~known]]) for x, y in zip(held, rows, strict=True))
        key, doc, _, state = rows
        if not len(key):
            continue
        _, group, several = _groups(key, doc)
        several |= np.bincount(group, state == _SPEAKS) > 0
        out = several[group] | (state == _SPEAKS)
        if told:
            several[0] = True
            out |= group == 0
            out[0] = False
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], schema=_WINDOWS)
        told = bool(several[-1])
        kept = [len(key) - 1] if told else np.flatnonzero(group == group[-1])
        held = tuple(x[kept] for x in rows)


def _joint_windows(key: np.ndarray, doc: np.ndarray, place: np.ndarray, at: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, place) for every ``agreeing`` functions whose windows hold a common sequence of the shortest passage's tokens.

    A function's windows hold disjoint sets of such sequences, each a range of first tokens.  Where these ranges begin or
    end, the windows are looked up; the place is that of the first function's minimum, its reach is what all have.
    """
    c, left, right = _unpack(place)
    text = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 32
    begin = text + c - np.minimum(left, at.tokens - 1)
    end = text + c + np.minimum(right, at.tokens - 1) - at.tokens + 2
    cuts = np.unique(np.concatenate([begin, end]))
    owner = []
    for j in range(at.hashes):
        own = np.flatnonzero(key & 7 == j)
        own = own[np.lexsort((end[own], begin[own]))]
        k = np.searchsorted(begin[own], cuts, side="right") - 1
        reach = np.maximum.accumulate(end[own])
        owner.append(np.where((k >= 0) & (np.append(reach, 0)[k] > cuts), np.append(own, -1)[k], -1))
    parts = []
    for number, chosen in enumerate(combinations(owner, at.agreeing)):
        rows = np.stack(chosen)
        every = (rows >= 0).all(0)
        new = every & np.concatenate([[True], ~every[:-1] | (rows[:, 1:] != rows[:, :-1]).any(0)])
        rows = rows[:, new]
        joint = np.full(rows.shape[1], _ODD[number % len(_ODD)], np.uint64)
        for r in rows:
            joint = (joint ^ key[r].view(np.uint64)) * np.uint64(_ODD[0])
            joint ^= joint >> np.uint64(29)
        low, high = (c - left)[rows].max(0), (c + right)[rows].min(0)
        parts.append((joint.view(np.int64), doc[rows[0]], _pack(c[rows[0]], c[rows[0]] - low, high - c[rows[0]])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _window_spans(doc: np.ndarray, place: np.ndarray, to_doc: np.ndarray, to_place: np.ndarray, at: Settings) -> list[np.ndarray]:
    """The stretches of links of joint windows, as far as both windows reach."""
    (c, left, right), (to_c, to_left, to_right) = _unpack(place), _unpack(to_place)
    left, right = np.minimum(left, to_left), np.minimum(right, to_right)
    wide = left + right + 1 >= int(at.tokens * at.similarity)
    return [x[wide] for x in (doc, c - left, c + right, to_doc, to_c - left, to_c + right)]


def _joint_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of windows in the order of doc: stretches of joint windows within some documents, and rows to look for the others by."""

    def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, doc))
        return _link_rows(*_joint_windows(key[order], doc[order], place[order], at), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, ("key", "doc", "place"), "doc", at.chunk):
            yield rows(held)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: str, least: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Of rows in the order of ``by``: lists of columns of ``least`` rows or more, never parting equal ones of it."""
    held: list[tuple[np.ndarray, ...]] = []
    size, of = 0, names.index(by)
    for batch in batches:
        new = tuple(batch.column(name).to_numpy() for name in names)
        if not len(new[0]):
            continue
        whole = int(np.searchsorted(new[of], new[of][-1]))  # before the last one begins in this batch
        if size + whole >= least and (whole or held[-1][of][-1] != new[of][0]):
            yield [*held, tuple(x[:whole] for x in new)]
            held, size, new = [], 0, tuple(x[whole:] for x in new)
        held.append(new)
        size += len(new[0])
    if held:
        yield held


def _link_rows(key: np.ndarray, doc: np.ndarray, place: np.ndarray, at: Settings) -> pa.RecordBatch:
    """Joined stretches of links within these rows, and the first row of each key's first and last document, to look for others by."""
    order = np.lexsort((place, doc, key))
    key, doc, place = key[order], doc[order], place[order]
    if not len(key):
        return pa.RecordBatch.from_pylist([], schema=_SOUGHT)
    row, to = _linked(key, doc)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    new_doc = np.flatnonzero(first | np.concatenate([[True], doc[1:] != doc[:-1]]))
    sent = np.union1d(np.flatnonzero(first), new_doc[np.append(first[new_doc[1:]], True)])
    parts = []
    for k in range(0, len(row) or 1, at.chunk):
        of, other = row[k : k + at.chunk], to[k : k + at.chunk]
        parts.append(_joined(*_window_spans(doc[of], place[of], doc[other], place[other], at)))
    return _sought_batch(_joined(*(np.concatenate(x) for x in zip(*parts, strict=True))), key[sent], doc[sent], place[sent])


def _window_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[np.ndarray] = []
        starts: list[int] = []
        held = 0
        for batch in batches:
            shingled = hashed_texts(batch.column(1).to_pylist(), lambda words: shingle_hashes(words, at.words))
            for doc_id, (shingles, n) in zip(batch.column(0).to_pylist(), shingled, strict=True):
                tokens = shingles[: max(0, n - at.words + 1)]
                if len(tokens) < at.tokens:
                    continue
                for start in range(0, max(1, len(tokens) - 4 * at.tokens), at.chunk):
                    piece = tokens[start : start + at.chunk + 4 * at.tokens]
                    if held + len(piece) > max(at.chunk, len(piece)) and ids:
                        yield _window_rows(ids, texts, starts, at)
                        ids, texts, starts, held = [], [], [], 0
                    ids.append(doc_id)
                    texts.append(piece)
                    starts.append(start)
                    held += len(piece)
        if ids:
            yield _window_rows(ids, texts, starts, at)

    return run


def _link_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of key: stretches as they are, and those of the others' links."""

    def link(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        row, to = _linked(key, doc)
        return _window_spans(doc[row], place[row], doc[to], place[to], at)

    return _by_key(link, at)


def _by_key(link: Callable[..., list[np.ndarray]], at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of key: stretches as they are, and what ``link`` makes of all rows of some keys, in the order of (key, doc, place).

    A key has a row or two for each batch of the step before, so all of one fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought: list[pa.RecordBatch] = []
        for batch in batches:  # rows without a key come first
            done = pc.is_null(batch.column("key"))
            yield batch.filter(done).select(_SPANS.names)
            sought = [batch.filter(pc.invert(done))]
            if sought[0].num_rows:
                break
        for held in _whole_groups(chain(sought, batches), ("key", "doc", "span"), "key", at.chunk):
            key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, doc, key))
            yield pa.RecordBatch.from_arrays(_span_columns(link(key[order], doc[order], place[order])), schema=_SPANS)

    return run


def _run_spans(doc: np.ndarray, place: np.ndarray, to_doc: np.ndarray, to_place: np.ndarray, at: Settings) -> list[np.ndarray]:
    """The stretches of links of runs."""
    return [doc, place, place + at.tokens - 1, to_doc, to_place, to_place + at.tokens - 1]


def _leaders(key: np.ndarray) -> np.ndarray:
    """Of keys in order: where each one's first row is."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return np.flatnonzero(first)[np.cumsum(first) - 1]


def _first_runs(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in the order of key: stretches as they are, and every run linked to the first of its key."""

    def link(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        leader = _leaders(key)
        kept = doc != doc[leader]
        return _run_spans(doc[kept], place[kept], doc[leader][kept], place[leader][kept], at)

    return _by_key(link, at)


def _run_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (doc, text, places): the runs of the shortest passage's tokens around the windows' minima.

    Those that the same task sees again soon are links; the first of each key is a row with the key.
    """

    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, key))
        key, doc, place = key[order], doc[order], place[order]
        leader = _leaders(key)
        kept = doc != doc[leader]
        first = leader == np.arange(len(key))
        return _sought_batch(_joined(*_run_spans(doc[kept], place[kept], doc[leader][kept], place[leader][kept], at)), key[first], doc[first], place[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            keyed = hashed_texts(batch.column("text").to_pylist(), lambda words: run_hashes(shingle_hashes(words, at.words), at.tokens))
            for doc, places, (keys, n) in zip(*(batch.column(c).to_pylist() for c in ("doc", "places")), keyed, strict=True):
                keys = keys[: max(0, n - at.shortest + 1)]
                c, left, right = _unpack(np.array(places, np.int64))
                lo = c - np.minimum(left, at.tokens - 1)
                hi = np.minimum(c + np.minimum(right, at.tokens - 1) - at.tokens + 1, c)
                change = np.zeros(len(keys) + 1, np.int64)
                np.add.at(change, np.minimum(lo, len(keys)), 1)
                np.add.at(change, np.minimum(hi + 1, len(keys)), -1)
                start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                parts.append((keys[start].view(np.int64), np.full(len(start), doc, np.int64), start))
                if (held := held + len(start)) > at.runs:
                    yield rows(parts)
                    parts, held = [], 0
        if held:
            yield rows(parts)

    return run


def _join_intervals(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of stretches in the order of a hash of (doc, to_doc): those that overlapping ones cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, ("pair", *_SPANS.names), "pair", at.chunk):
            _, doc, span, to_doc, to_span = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = _joined(doc, span >> 32, span & 0xFFFFFFFF, to_doc, to_span >> 32, to_span & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=_FOUND)

    return run


def _apart(places: list[int], bridge: int) -> list[tuple[int, int]]:
    """First and last of every run of ascending places at most ``bridge`` apart."""
    if not places:
        return []
    cut = [k for k in range(1, len(places)) if places[k] - places[k - 1] > bridge]
    return [(places[i], places[j - 1]) for i, j in zip([0, *cut], [*cut, len(places)], strict=True)]


def common_passages(a: np.ndarray, b: np.ndarray, at: Settings) -> list[tuple[int, int, int, int, float]]:
    """(start and words in a, start and words in b, similarity) of the common passages of two word sequences."""
    x, y = shingle_hashes(a, at.words), shingle_hashes(b, at.words)
    mine, theirs = x.tolist(), y.tolist()
    known = set(theirs)
    places = [i for i, token in enumerate(mine) if token in known]
    if not places or places[-1] - places[0] + 1 < at.tokens:
        return []
    out: list[tuple[int, int, int, int, float]] = []
    for bridge in (at.bridge, 1):
        for lo, last in _apart(places, bridge):
            hi = last + 1
            if hi - lo < at.tokens or any(s <= lo and hi <= s + n - at.words + 1 for s, n, _, _, _ in out):
                continue
            part = set(mine[lo:hi])
            for first, end in _apart([j for j, token in enumerate(theirs) if token in part], bridge):
                there = set(theirs[first : end + 1])
                both = len(part & there)
                alike = both / (len(part) + len(there) - both)
                if alike >= at.similarity and end - first + 1 >= at.similarity * at.tokens:
                    out.append((lo, hi - lo + at.words - 1, first, end - first + at.words, alike))
                    break
    left = [(lo, last + 1) for lo, last in _apart(places, 1) if last + 1 - lo >= at.tokens]
    left = [(lo, hi) for lo, hi in left if not any(s <= lo and hi <= s + n - at.words + 1 for s, n, _, _, _ in out)]
    if not left:
        return out
    order = np.argsort(y, kind="stable")
    if not out:
        return _verbatim(x, y, order, at)
    for lo, hi in left:
        for s, n, t, _, alike in _verbatim(x[lo:hi], y, order, at):
            if not any(b <= lo + s and lo + s + n <= b + m for b, m, _, _, _ in out):
                out.append((lo + s, n, t, n, alike))
    return out


def _verbatim(x: np.ndarray, y: np.ndarray, order: np.ndarray, at: Settings) -> list[tuple[int, int, int, int, float]]:
    """Runs of at least the shortest passage that are equal place by place."""
    first = np.searchsorted(y[order], x, side="left")
    many = np.searchsorted(y[order], x, side="right") - first
    i = np.repeat(np.arange(len(x)), many)
    j = order[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] if len(i) else i
    sort = np.lexsort((i, j - i))
    i, j = i[sort], j[sort]
    out, covered = [], -1
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    for run in sorted(np.split(np.arange(len(i)), breaks), key=lambda r: i[r[0]] if len(r) else 0):
        if len(run) >= at.tokens and i[run[-1]] > covered:
            out.append((int(i[run[0]]), len(run) + at.words - 1, int(j[run[0]]), len(run) + at.words - 1, 1.0))
            covered = int(i[run[-1]])
    return out


def _once_hashed(batch: pa.RecordBatch, by: str) -> Iterator[np.ndarray]:
    """The hashes of the words of each row's text; rows in succession that are equal in ``by`` have one text."""
    doc = batch.column(by).to_numpy()
    first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    texts = batch.column("text").filter(pa.array(first))
    found = hashed_texts(text.as_py() for text in texts)
    words = None
    for new in first.tolist():
        if new:
            words, _ = next(found)
        yield words


def _slice_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, lo, hi, words in zip(*(batch.column(c).to_pylist() for c in ("doc", "lo", "hi")), _once_hashed(batch, "doc"), strict=True):
                out.append(words[lo : hi + at.words].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "words"])

    return run


_PASSAGES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64()), ("similarity", pa.float64())])
PASSAGES = "doc_id long, start long, n_words long, source_id long, source_start long, similarity double"


def _verify_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lo, to_doc, to_lo, to_hi, own, there in zip(*(batch.column(c).to_pylist() for c in ("doc", "lo", "to_doc", "to_lo", "to_hi", "words")), _once_hashed(batch, "to_doc"), strict=True):
                for s, n, t, _, alike in common_passages(np.frombuffer(own, np.uint64), there[to_lo : to_hi + at.words], at):
                    rows.append((doc, lo + s, n, to_doc, to_lo + t, alike))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PASSAGES, strict=True)], schema=_PASSAGES)

    return run


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, label: str) -> DataFrame:
    """As ``materialise``, but the shuffle files go when the table stands, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialise(df, label)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def shared_windows(texts: DataFrame, at: Settings) -> DataFrame:
    """(key, doc, place) of the windows whose signature other texts have too.

    A task tells those that texts of a batch share, and passes one row of such a key on; the others are looked for by
    key.  So a key has a row or two for each batch there, however many documents hold it.
    """
    spread = F.when(F.col("state") == _KNOWN, F.xxhash64("doc", "place")).otherwise(F.col("key"))
    windows = texts.mapInArrow(_window_batches(at), WINDOWS)
    return windows.repartition(spread).sortWithinPartitions("key").mapInArrow(_shared_batches, WINDOWS).select("key", "doc", "place")


def _looked_for(sought: DataFrame, link: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Stretches as they are, and those of rows of the same key."""
    spread = F.when(F.col("key").isNull(), F.xxhash64("doc", "span")).otherwise(F.col("key"))
    # By one column alone Spark sorts by radix; what follows puts the rows of a key in order.
    return sought.repartition(spread).sortWithinPartitions("key").mapInArrow(link, SPANS)


def shared_runs(texts: DataFrame, windows: DataFrame, at: Settings) -> DataFrame:
    """Stretches of runs of tokens, each as long as the shortest passage, that texts share."""
    places = windows.where("key & 7 = 0").groupBy("doc").agg(F.collect_set("place").alias("places"))
    runs = texts.join(places, "doc").select("doc", "text", "places").mapInArrow(_run_batches(at), SOUGHT)
    return _looked_for(_written(runs, "passages-runs"), _first_runs(at))


def candidate_stretches(texts: DataFrame, at: Settings) -> DataFrame:
    """(doc, lo, hi, to_doc, to_lo, to_hi), in tokens, of ``texts``(doc, text binary), which differ; to_doc is smaller than doc."""
    windows = _written(shared_windows(texts, at), "passages-windows")
    joint = windows.repartition("doc").sortWithinPartitions("doc").mapInArrow(_joint_batches(at), SOUGHT)
    spans = _looked_for(joint, _link_batches(at)).unionByName(shared_runs(texts, windows, at))
    pairs = spans.repartition("doc", "to_doc").select(F.xxhash64("doc", "to_doc").alias("pair"), *_SPANS.names)
    return pairs.sortWithinPartitions("pair").mapInArrow(_join_intervals(at), FOUND)


_CLASSES = "doc long, digest binary, n_words long"


def _squeezed(text: bytes) -> tuple[bytes, int]:
    """SHA-256 of a text up to case and white space, and its number of words."""
    words = text.lower().split()
    return hashlib.sha256(b" ".join(words)).digest(), len(words)


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = zip(*(_squeezed(text.as_py()) for text in batch.column("text")), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["doc", "digest", "n_words"])


def _chosen_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, text, least): texts without a least digest, or of that digest."""
    for batch in batches:
        kept = [least is None or _squeezed(text)[0] == least for text, least in zip(batch.column("text").to_pylist(), batch.column("least").to_pylist(), strict=True)]
        yield batch.filter(pa.array(kept, pa.bool_())).select(["doc", "text"])


def substring_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, n_words, source_id, source_start, similarity): a passage of doc_id that is found in source_id too.

    start and n_words count words.  source_id is smaller than doc_id.  Of copies of a text all but the smallest doc_id
    have one row, which covers the whole text; passages inside are reported for the smallest alone.
    """
    at = settings
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), whole_text().cast("binary").alias("text"))
    classes = _written(own.mapInArrow(_class_batches, _CLASSES), "passages-classes")
    several = classes.groupBy("doc").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most")
    several = _written(several.select("doc", "least"), "passages-several")
    if not several.isEmpty():
        classes = classes.join(several, "doc", "left").where("least IS NULL OR least = digest").drop("least")
        own = own.join(several, "doc", "left").mapInArrow(_chosen_batches, "doc long, text binary")
    first = _written(classes.where(F.col("n_words") >= at.shortest).groupBy("digest").agg(F.min("doc").alias("source_id"), F.count("*").alias("size")), "passages-first")
    copies = classes.join(first.where("size > 1"), "digest").where("doc <> source_id").select("doc", "source_id", "n_words").distinct()
    zero = F.lit(0).cast("long")
    copied = copies.select(F.col("doc").alias("doc_id"), zero.alias("start"), "n_words", "source_id", zero.alias("source_start"), F.lit(1.0).alias("similarity"))

    others = _written(copies.select("doc"), "passages-copies")
    others = F.broadcast(others) if others.count() <= at.broadcast_ids else others
    found = _written(candidate_stretches(own.join(others, "doc", "left_anti"), at), "passages-found")
    asked = found.select("doc").union(found.select("to_doc")).distinct()
    asked = F.broadcast(asked) if asked.count() <= at.broadcast_ids else asked
    texts = own.join(asked, "doc", "left_semi")
    if not classes.groupBy("doc").count().where("count > 1").isEmpty():  # one text, several times
        texts = texts.dropDuplicates(["doc"])
    mine = found.join(texts, "doc").mapInArrow(_slice_batches(at), f"{', '.join(('doc long', 'lo long', 'hi long', 'to_doc long', 'to_lo long', 'to_hi long'))}, words binary")
    theirs = texts.select(F.col("doc").alias("to_doc"), "text")
    passages = mine.join(theirs, "to_doc").select("doc", "lo", "to_doc", "to_lo", "to_hi", "words", "text").mapInArrow(_verify_batches(at), PASSAGES)
    return copied.unionByName(passages.distinct())
