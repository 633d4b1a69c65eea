"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, and an end for each text.  A token's class is
the token itself if it is one of the commonest ``words`` or the end, else one of ``suffixes`` classes by a hash of its
last letters.  The model is

    P(token | before) = P(class | s1, s2) * P(token | class, a, b)

P(class | s1, s2) is a softmax over the classes.  s1 and s2 are the classes of the token before and the one before that;
features are the bigram s1, the skip s2, the trigram (s2, s1) hashed to ``hashed`` buckets, and a bias.

P(token | class, a, b) is 1 for a class of one token.  Else it is a softmax over the tokens of the class.  a and b are
the last two tokens before, whatever lies between, whose class isn't theirs alone.  Features are the skip bigram
(a, token) and the skip trigram (b, a, token), hashed, and a bias, the log of (c + 0.1) / (n + 0.1 * (v + 1)) with the
class's n training tokens of v kinds; the 1 stands for all tokens never seen.  A feature exists if training rows hold it
``least`` times, so the features grow with the corpus.  Tokens beyond the ``frequent`` commonest share features: those of
a class are hashed to ``buckets`` buckets, a bucket's features stand for its tokens, and within a bucket a token's share
is by its count.  A bucket has the share of its tokens and of one never seen.

Contexts are hashes of as many bits as the number of training tokens asks for (28, and one more for every doubling beyond
2^21), the same ones whatever they are dealt out to, so scores don't depend on the number of partitions.

Training.  One pass counts all training tokens.  Another sums, per task and then over tasks, how often each context and
each feature with each class occurs: all the softmax over classes needs to know of the data, of a size that only depends
on the settings.  Each round then deals out the contexts, sums the features that the model expects of them and moves the
weights by the scaled gradient.  The softmax within classes is trained where its contexts are: occurrences are dealt out
by a hash of (a, class) in packed blocks, into as many parts as the corpus needs; a part has all that concerns its
contexts, so it moves its own weights by rounds of the gradient and then scores its occurrences, held-out ones included.
As a is never one of the commonest tokens, and as equal texts of a chunk are dealt out once, a context fills a part only
if it stands in very many different texts.

The counts of the ``frequent`` commonest tokens are broadcast, those of rarer ones are dealt out and joined.  Training
uses rows for which crc32(doc_id as text) mod 10 isn't 0, and those without doc_id.  Null texts are empty: one end.
Rows that repeat doc_id and text are each trained on and each returned.  Without training rows every score is finite.  A
text of any length is scored whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import commonest, materialise, repeat_rows, shuffle_width, whole_text

HELD_OUT = "coalesce(pmod(crc32(cast(doc_id AS string)), 10) = 0, false)"
END = b""
SMOOTH = 0.1
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


@dataclass(frozen=True)
class Settings:
    words: int = 351
    suffixes: int = 160
    hashed: int = 1024
    rounds: int = 12
    step: float = 0.3
    #: Tasks of a round; each deals out tables of the weights' size.
    tasks: int = 4
    #: Bound on the broadcast table of counts, and buckets of a class for the tokens beyond it.
    frequent: int = 1 << 18
    buckets: int = 2048
    #: Distinct tokens that a task holds, and tokens that it looks at together.
    held: int = 300_000
    chunk: int = 400_000
    #: Occurrences that make a feature of the softmax within classes, and what its counts are discounted by.
    least: int = 2
    discount: float = 0.75
    #: Rounds within a part, the weight of the squared weights, and training tokens to a part.
    part_rounds: int = 6
    ridge: float = 0.1
    part_tokens: int = 1 << 21

    @property
    def classes(self) -> int:
        return 1 + self.words + self.suffixes

    @property
    def shapes(self) -> tuple[tuple[int, int], ...]:
        """Of the tables of contexts, and of bigram, skip and hashed features by class; before a text is a class of its own."""
        return ((self.classes + 1, self.classes + 1), (self.classes + 1, self.classes), (self.classes + 1, self.classes), (self.hashed, self.classes))


def tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(END)
    return found


def suffix_class(token: bytes, at: Settings) -> int:
    letters = token.rstrip(_PUNCTUATION)
    return 1 + at.words + zlib.crc32(letters[-3:] + token[len(letters) :][-1:]) % at.suffixes


def bucket(token: bytes, suffix: int, at: Settings) -> int:
    """The number among all classes' buckets."""
    return (suffix - 1 - at.words) * at.buckets + zlib.crc32(token) % at.buckets


class Codes(dict):
    """A frequent token's rank, or -1 - class - classes * hash for a rarer one; of those it remembers ``held``."""

    def __init__(self, frequent: list[bytes], at: Settings) -> None:
        super().__init__(zip(frequent, range(len(frequent)), strict=True))
        self.frequent, self.at, self.rare = frequent, at, 0

    def __missing__(self, token: bytes) -> int:
        code = -1 - suffix_class(token, self.at) - self.at.classes * zlib.crc32(token)
        if self.rare < self.at.held:
            self.rare += 1
            self[token] = code
        return code


@dataclass
class Lexicon:
    """Frequent tokens, the most frequent first, with their counts and classes; by class n and v, by bucket those of rarer tokens."""

    at: Settings
    tokens: list[bytes]
    counts: np.ndarray
    total: int
    kinds: int
    class_total: np.ndarray
    class_kinds: np.ndarray
    bucket_total: np.ndarray
    bucket_kinds: np.ndarray

    @property
    def context_bits(self) -> int:
        return min(28 + max(int(self.total).bit_length() - 21, 0), 60)

    def codes(self) -> Codes:
        return Codes(self.tokens, self.at)

    def classes(self) -> np.ndarray:
        own = {w: k for k, w in enumerate([END, *[w for w in self.tokens if w != END][: self.at.words]])}
        return np.array([own.get(w) if w in own else suffix_class(w, self.at) for w in self.tokens] or [0], np.int64)


def _texts(docs: DataFrame, *rest) -> DataFrame:
    return docs.select(*rest, F.encode(whole_text(), "UTF-8").alias("text"))


def _count_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > at.held:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    return run


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "c"])


def _suffix_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket(t, suffix_class(t, at), at) for t in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column("c")], ["bucket", "c"])

    return run


def lexicon(counts: DataFrame, at: Settings) -> Lexicon:
    """From (token, c) of all training tokens."""
    kinds, total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = commonest(counts, "c", "token", at.frequent).toArrow()
    found, sizes = top.column("token").to_pylist(), top.column("c").to_pylist()
    if END not in found:  # it has a class of its own, however rare
        for r in counts.where(F.col("token") == F.lit(END)).collect():
            found, sizes = [*found, END], [*sizes, r.c]
    lex = Lexicon(at, found, np.array(sizes, np.float64), total, kinds, *(np.zeros(n) for n in (at.classes, at.classes, at.suffixes * at.buckets, at.suffixes * at.buckets)))
    sums = counts.mapInArrow(_suffix_batches(at), "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    place = sums.column("bucket").to_numpy()
    lex.bucket_total[place], lex.bucket_kinds[place] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
    lex.class_total[1 + at.words :], lex.class_kinds[1 + at.words :] = (x.reshape(at.suffixes, -1).sum(1) for x in (lex.bucket_total, lex.bucket_kinds))
    for w, c, k in zip(lex.tokens, lex.counts, lex.classes(), strict=False):
        suffix = suffix_class(w, at)
        lex.bucket_total[bucket(w, suffix, at)] -= c
        lex.bucket_kinds[bucket(w, suffix, at)] -= 1
        if k <= at.words:  # it has a class of its own instead
            lex.class_total[suffix] -= c
            lex.class_kinds[suffix] -= 1
            lex.class_total[k], lex.class_kinds[k] = c, 1
    return lex


def _encode(texts: list[bytes], codes: Codes, classes: np.ndarray, at: Settings) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts: the first one's number, their tokens, where each begins, codes and classes of all tokens."""
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(found := tokens(text))
        size += len(found)
        if size >= at.chunk or k == len(texts) - 1:
            code = np.fromiter((codes[w] for doc in held for w in doc), np.int64, size)
            yield first, held, np.cumsum([0] + [len(d) for d in held[:-1]]), code, np.where(code >= 0, classes[np.maximum(code, 0)], (-1 - code) % at.classes)
            first, held, size = k + 1, [], 0


def _contexts(classes: np.ndarray, begins: np.ndarray, at: Settings) -> tuple[np.ndarray, np.ndarray]:
    """s1 and s2 of every token."""
    before = at.classes
    s1 = np.concatenate([[before], classes[:-1]])
    s1[begins] = before
    s2 = np.concatenate([[before], s1[:-1]])
    s2[begins] = before
    return s1, s2


def _hash(s1: np.ndarray, s2: np.ndarray, at: Settings) -> np.ndarray:
    return (((s1 * 2654435761 + s2 * 2246822519) >> 7) ^ s1) % at.hashed


_BLOCK = 4096
_SUMS = "block int, sums binary"


def _statistics_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        at, codes, classes = lex.at, lex.codes(), lex.classes()
        sums = [np.zeros(a * b, np.int64) for a, b in at.shapes]
        for batch in batches:
            for _, _, begins, _, s0 in _encode(batch.column(0).to_pylist(), codes, classes, at):
                s1, s2 = _contexts(s0, begins, at)
                for total, row, column in zip(sums, (s2, s1, s2, _hash(s1, s2, at)), (s1, s0, s0, s0), strict=True):
                    width = at.classes + 1 if total is sums[0] else at.classes
                    total += np.bincount(row * width + column, minlength=len(total))
        yield from _block_rows({k: v for k, v in enumerate(_blocks(np.concatenate(sums))) if v.any()})

    return run


def _blocks(values: np.ndarray) -> list[np.ndarray]:
    return [values[k : k + _BLOCK] for k in range(0, len(values), _BLOCK)]


def _block_rows(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(blocks.keys(), pa.int32()), pa.array([v.tobytes() for v in blocks.values()], pa.binary())], ["block", "sums"])


def _add_blocks(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                values = np.frombuffer(raw, kind)
                total[k] = total[k] + values if k in total else values
        yield from _block_rows(total)

    return run


def _gather(sums: DataFrame, shapes: tuple[tuple[int, int], ...], kind: type) -> list[np.ndarray]:
    """The tables of ``sums``, which holds each block once."""
    flat = np.zeros(sum(a * b for a, b in shapes), kind)
    for r in sums.collect():
        values = np.frombuffer(r.sums, kind)
        flat[r.block * _BLOCK : r.block * _BLOCK + len(values)] = values
    cuts = np.cumsum([a * b for a, b in shapes])[:-1]
    return [x.reshape(shape) for x, shape in zip(np.split(flat, cuts), shapes, strict=True)]


def statistics(docs: DataFrame, lex: Lexicon) -> list[np.ndarray]:
    """Counts of contexts, and of bigram, skip and hashed features with classes, over all texts of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    add = _add_blocks(np.int64)
    own = _texts(docs).mapInArrow(_statistics_batches(shared), _SUMS)
    some = own.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("block", "salt").drop("salt").mapInArrow(add, _SUMS)
    out = _gather(some.repartition("block").mapInArrow(add, _SUMS), lex.at.shapes, np.int64)
    shared.destroy()
    return out


@dataclass
class Weights:
    """bias and tables of bigram, skip and hashed features by class."""

    bias: np.ndarray
    tables: list[np.ndarray]


def _logits(weights: Weights, s1: np.ndarray, s2: np.ndarray, at: Settings) -> np.ndarray:
    a, b, c = weights.tables
    return weights.bias + a[s1] + b[s2] + c[_hash(s1, s2, at)]


def _expect_batches(at: Settings, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        sums = [np.zeros_like(t) for t in weights.tables]
        for batch in batches:
            contexts, counts = batch.column("context").to_numpy(), batch.column("n").to_numpy()
            for k in range(0, len(contexts), 4096):
                s2, s1 = np.divmod(contexts[k : k + 4096], at.classes + 1)
                logits = _logits(weights, s1, s2, at)
                logits -= logits.max(axis=1, keepdims=True)
                expected = np.exp(logits)
                expected *= (counts[k : k + 4096] / expected.sum(axis=1))[:, None].astype(np.float32)
                for total, row in zip(sums, (s1, s2, _hash(s1, s2, at)), strict=True):
                    order = np.argsort(row, kind="stable")
                    rows, begin = np.unique(row[order], return_index=True)
                    total[rows] += np.add.reduceat(expected[order], begin, axis=0)
        yield from _block_rows(dict(enumerate(_blocks(np.concatenate([t.ravel() for t in sums])))))

    return run


def train(stats: list[np.ndarray], docs: DataFrame, at: Settings) -> Weights:
    """Rounds of distributed gradient updates; a round's traffic depends on the settings only.

    The tasks' tables are added up on the executors, in the order of the tasks, so the driver gets one set of them.
    """
    spark = docs.sparkSession
    contexts = np.flatnonzero(stats[0].ravel())
    table = pa.table({"context": contexts, "n": stats[0].ravel()[contexts].astype(np.float64)})
    dealt = materialise(spark.createDataFrame(table).repartition(at.tasks, "context"), "lm-contexts")
    observed = [s.astype(np.float32) for s in stats[1:]]
    share = (observed[0].sum(0) + 0.5) / (observed[0].sum() + 0.5 * at.classes)
    weights = Weights(np.log(share).astype(np.float32), [np.zeros_like(o) for o in observed])
    rows = observed[0].sum(1, keepdims=True)
    weights.tables[0] = (np.log((observed[0] + 20 * share) / (rows + 20)) - weights.bias).astype(np.float32)
    for _ in range(at.rounds if len(contexts) else 0):
        shared = spark.sparkContext.broadcast(weights)
        own = dealt.coalesce(at.tasks).mapInArrow(_expect_batches(at, shared), _SUMS).withColumn("part", F.spark_partition_id())
        added = own.repartition(at.tasks, "block").sortWithinPartitions("part").drop("part").mapInArrow(_add_blocks(np.float32), _SUMS)
        expected = _gather(added, at.shapes[1:], np.float32)
        shared.destroy()
        moved = [t + at.step * np.clip((o - e - 0.05 * t) / (np.maximum(o, e) + 3), -2, 2) for t, o, e in zip(weights.tables, observed, expected, strict=True)]
        weights = Weights(weights.bias, [t.astype(np.float32) for t in moved])
    return weights


@dataclass
class Model:
    lex: Lexicon
    weights: Weights
    #: By rank of a frequent token: log10 of its base share and of its share in its class; by class: of a token with c = 0, less log10(0.1).
    base: np.ndarray
    inside: np.ndarray
    base_rest: float
    inside_rest: np.ndarray

    def shares(self) -> np.ndarray:
        """What the bias gives a token in its class, by rank, and after the ranks the tokens of each bucket together."""
        at, lex = self.lex.at, self.lex
        rest = 10 ** np.repeat(self.inside_rest[1 + at.words :], at.buckets)
        return np.concatenate([10.0**self.inside, (lex.bucket_total + SMOOTH * (lex.bucket_kinds + 1)) * rest])


def fit(docs: DataFrame, counts: DataFrame, at: Settings = Settings()) -> Model:
    """Learn from all rows of ``docs``, whose token counts ``counts`` has."""
    lex = lexicon(counts, at)
    weights = train(statistics(docs, lex), docs, at)
    base_rest = -float(np.log10(lex.total + SMOOTH * (lex.kinds + 1)))
    inside_rest = -np.log10(lex.class_total + SMOOTH * (lex.class_kinds + 1))
    seen, classes = np.log10(lex.counts + SMOOTH), lex.classes()[: len(lex.counts)]
    inside = np.where(classes <= at.words, 0.0, seen + inside_rest[classes])
    return Model(lex, weights, seen + base_rest, inside, base_rest, inside_rest)


#: Fixed odd multipliers of hashes.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(values: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    out = (values.view(np.uint64) * _ODD[0]) ^ ((np.asarray(more).astype(np.uint64) + np.uint64(1)) * _ODD[1])
    out = (out ^ (out >> np.uint64(29))) * _ODD[2]
    return out ^ (out >> np.uint64(32))


def _packed(columns: list[np.ndarray], press: zstandard.ZstdCompressor) -> bytes:
    """Columns of unsigned 32-bit numbers, like bytes together."""
    return press.compress(b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns))


def _unpacked(data: bytes, columns: int, press: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = np.frombuffer(press.decompress(data), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<u4")[:, :, 0]


def _occurrences(code: np.ndarray, s0: np.ndarray, begins: np.ndarray, copies: np.ndarray, parts: int, lex: Lexicon) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By part: context, further context, rank + 1 (of rarer tokens the bucket), training copies and text of every token that has a context.

    Contexts are hashes of ``lex.context_bits`` bits, of which the part is the remainder, further contexts, within these,
    of 16.  ``copies``: of each text, how many training rows hold it; -1 leaves the text out.
    """
    at = lex.at
    place = np.flatnonzero(s0 > at.words)
    text = np.searchsorted(begins, place, side="right") - 1
    one, two = np.zeros(len(place), bool), np.zeros(len(place), bool)
    one[1:] = text[1:] == text[:-1]
    two[2:] = text[2:] == text[:-2]
    kept = np.flatnonzero(one & (copies[text] >= 0))
    if not len(kept):
        return
    own, before = code[place[kept]], code[place[kept - 1]]
    context = _mixed(before, s0[place[kept]]) >> np.uint64(64 - lex.context_bits)
    further = np.where(two[kept], (_mixed(code[place[np.maximum(kept - 2, 0)]]) >> np.uint64(48)) + np.uint64(1), np.uint64(0))
    context, part = np.divmod(context, np.uint64(parts))
    hashes, suffix = np.divmod(-1 - own, at.classes)
    rank = 1 + np.where(own >= 0, own, len(lex.tokens) + (suffix - 1 - at.words) * at.buckets + hashes % at.buckets)
    order = np.lexsort((context, part))
    columns = [c[order] for c in (context, further, rank, copies[text[kept]], text[kept])]
    part = part[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
        first, *rest = (c[begin:end] for c in columns)
        yield int(part[begin]), [np.diff(first, prepend=first.dtype.type(0)), *rest]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Numbers of the distinct keys, how many there are, and where each occurs first."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    first = order[new]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return number, len(first), first


def part_deltas(context: np.ndarray, further: np.ndarray, rank: np.ndarray, copies: np.ndarray, share: np.ndarray, at: Settings) -> np.ndarray:
    """Train the softmax within classes over a part's occurrences and give the change of each one's log-probability.

    ``share``: of a token or bucket, by rank, what the bias alone gives it in its class.  Of the occurrences little more than
    three numbers of 32 bits each is held at once.
    """
    u64 = np.uint64

    def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = high.astype(u64)
        out <<= u64(32)
        out |= low
        return out

    def bias(first: np.ndarray) -> np.ndarray:
        return share[np.maximum(rank[first].astype(np.int64) - 1, 0)]

    near, n_near, _ = _numbered(context)
    c_near = np.bincount(near, copies, n_near)
    two, n_two, first = _numbered(joined(near, rank))
    c_two = np.bincount(two, copies, n_two)
    b = np.flatnonzero((c_two >= at.least) & (rank[first] > 0))
    b_near, b_base, o_two = near[first[b]], bias(first[b]), c_two[b] - at.discount
    del c_two
    far, n_far, first = _numbered(joined(near, further))
    near_of_far, c_far = near[first], np.bincount(far, copies, n_far)
    del near
    three, n_three, first = _numbered(joined(far, rank))
    c_three = np.bincount(three, copies, n_three)
    t = np.flatnonzero((c_three >= at.least) & (rank[first] > 0))
    t_far, t_base, t_two, o_three = far[first[t]], bias(first[t]), two[first[t]], c_three[t] - at.discount
    del c_three, first
    w, v = np.zeros(n_two), np.zeros(n_three)
    # The bigrams' own optimum, were there no trigrams, is the start.
    left = 1 - np.bincount(b_near, o_two / np.maximum(c_near[b_near], 1), n_near)
    free = np.maximum(1 - np.bincount(b_near, b_base, n_near), 1e-9)
    w[b] = np.log(o_two / np.maximum(c_near[b_near], 1) / b_base * free[b_near] / np.maximum(left[b_near], 1e-9))

    def normaliser() -> np.ndarray:
        z = 1 + np.bincount(b_near, b_base * np.expm1(w[b]), n_near)[near_of_far]
        return np.maximum(z + np.bincount(t_far, t_base * np.exp(w[t_two]) * np.expm1(v[t]), n_far), 1e-12)

    for _ in range(at.part_rounds if len(t) else 0):
        weight = c_far / normaliser()
        gain = t_base * np.exp(w[t_two]) * weight[t_far]
        e_three = gain * np.exp(v[t])
        e_two = b_base * np.exp(w[b]) * np.bincount(near_of_far, weight, n_near)[b_near] + np.bincount(t_two, gain * np.expm1(v[t]), n_two)[b]
        v[t] += 0.5 * np.clip((o_three - e_three - at.ridge * v[t]) / (np.maximum(o_three, e_three) + at.ridge), -1, 1)
        w[b] += 0.5 * np.clip((o_two - e_two - at.ridge * w[b]) / (np.maximum(o_two, e_two) + at.ridge), -1, 1)
    out = w[two]
    out += v[three]
    out -= np.log(normaliser())[far]
    return out


def _part_scores(shared) -> Callable[[pa.Table], pa.Table]:
    """Of a part's packed blocks (block, data): (block, data) with the texts' summed changes."""

    def run(table: pa.Table) -> pa.Table:
        model: Model = shared.value
        at, press, pull = model.lex.at, zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        texts: list[np.ndarray] = []
        found: tuple[list[np.ndarray], ...] = ([], [], [], [])
        for data in table.column("data"):
            first, *rest, text = _unpacked(data.as_py(), 5, pull)
            texts.append(text.copy())
            for own, column in zip(found, (np.cumsum(first, dtype=np.uint64), *(c.copy() for c in rest)), strict=True):
                own.append(column)
        columns = []
        for own in found:
            columns.append(np.concatenate(own))
            own.clear()
        delta = part_deltas(*columns, model.shares(), at)
        out, begin = [], 0
        for text in texts:
            own, place = np.unique(text, return_inverse=True)
            sums = np.bincount(place, delta[begin : begin + len(text)]).view("<u4").reshape(-1, 2).T
            out.append(_packed([own, *sums], press))
            begin += len(text)
        return pa.table({"block": table.column("block"), "data": pa.array(out, pa.binary())})

    return run


_DELTAS = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("score", pa.float64())])


def _add_deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (block, ids, data) in the order of block, that with the ids first: (doc_id, hash, score) of its rows."""
    pull, now, rows, text, sums = zstandard.ZstdDecompressor(), None, None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(sums[text] / np.log(10))], schema=_DELTAS)

    for batch in batches:
        for block, ids, data in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "data")), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                own = pa.ipc.open_stream(ids).read_all().combine_chunks()
                text = own.column("text").to_numpy()
                rows = own.select(["doc_id", "hash"]).to_batches()[0]
                now, sums = block, np.zeros(int(text.max()) + 1)
            else:
                texts, low, high = _unpacked(data, 3, pull)
                sums[texts] += np.stack([low, high], axis=1).view("<f8")[:, 0]
    if now is not None:
        yield done()


def _id_bytes(ids: list, hashes: list, text: np.ndarray) -> bytes:
    own = pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(text)], ["doc_id", "hash", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema) as out:
        out.write_batch(own)
    return sink.getvalue().to_pybytes()


_PARTS = pa.schema(
    [("doc_id", pa.int64()), ("hash", pa.int64()), ("token", pa.binary()), ("n", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    + [("part", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())]
)
PARTS = "doc_id long, hash long, token binary, n long, n_known long, base double, score double, part int, block long, ids binary, data binary"


def _score_batches(shared, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of three kinds: of each text, of its rare tokens, and packed blocks of occurrences (and, with ids, of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        lex, at = model.lex, model.lex.at
        codes, classes = lex.codes(), lex.classes()
        pad = np.zeros(1)
        base, inside = np.concatenate([model.base, pad]), np.concatenate([model.inside, pad])
        normaliser = np.full((at.classes + 1) ** 2, np.nan, np.float32)
        press, block = zstandard.ZstdCompressor(1), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, hashes, training = (batch.column(c).to_pylist() for c in ("doc_id", "hash", "training"))
            texts = batch.column("text").to_pylist()
            for first, docs, begins, code, s0 in _encode(texts, codes, classes, at):
                s1, s2 = _contexts(s0, begins, at)
                context = s2 * (at.classes + 1) + s1
                new = np.unique(context[np.isnan(normaliser[context])])
                for k in range(0, len(new), 4096):
                    b, a = np.divmod(new[k : k + 4096], at.classes + 1)
                    logits = _logits(model.weights, a, b, at)
                    most = logits.max(axis=1)
                    normaliser[new[k : k + 4096]] = most + np.log(np.exp(logits - most[:, None]).sum(axis=1))
                one, skip, three = model.weights.tables
                chosen = model.weights.bias[s0] + one[s1, s0] + skip[s2, s0] + three[_hash(s1, s2, at), s0] - normaliser[context]
                rare = code < 0
                score = chosen.astype(np.float64) / np.log(10) + np.where(rare, model.inside_rest[s0], inside[np.maximum(code, 0)])
                totals = [np.add.reduceat(x, begins) for x in (np.ones(len(code), np.int64), (~rare).astype(np.int64), np.where(rare, model.base_rest, base[np.maximum(code, 0)]), score)]
                rest = (None,) * 4
                rows = [(ids[first + k], hashes[first + k], None, *(t[k].item() for t in totals), *rest) for k in range(len(docs))]
                seen: list[Counter] = [Counter() for _ in docs]
                owner = np.searchsorted(begins, places := np.flatnonzero(rare), side="right") - 1
                for k, place in zip(owner.tolist(), (places - begins[owner]).tolist(), strict=True):
                    seen[k][docs[k][place]] += 1
                rows += [(ids[first + k], hashes[first + k], w, n, 0, 0.0, 0.0, *rest) for k, own in enumerate(seen) for w, n in own.items()]

                same: dict[bytes, int] = {}
                text = np.array([same.setdefault(t, k) for k, t in enumerate(texts[first : first + len(docs)])])
                copies = np.where(text == np.arange(len(text)), np.bincount(text, training[first : first + len(docs)], len(text)).astype(np.int64), -1)
                block += 1
                rows.append((None,) * 7 + (-1, block, _id_bytes(ids[first : first + len(docs)], hashes[first : first + len(docs)], text), None))
                rows += [(None,) * 7 + (part, block, None, _packed(columns, press)) for part, columns in _occurrences(code, s0, begins, copies, parts, lex)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)

    return run


def token_counts(docs: DataFrame, at: Settings) -> DataFrame:
    """(token, c) over all texts of ``docs``."""
    return _texts(docs).mapInArrow(_count_batches(at), "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def lm_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    at = settings
    training = docs.where(f"NOT {HELD_OUT}")
    counts = materialise(token_counts(training, at), "lm-counts")
    model = fit(training, counts, at)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_parts = max(shuffle_width(docs.sparkSession), -(-model.lex.total // at.part_tokens), 1 << max(model.lex.context_bits - 32, 0))
    training_row = F.expr(f"cast(NOT {HELD_OUT} AS int)").alias("training")
    rows = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("hash"), training_row)
    parts = materialise(rows.mapInArrow(_score_batches(shared, n_parts), PARTS), "lm-parts")

    deltas = parts.where("part >= 0").select("part", "block", "data").groupBy("part").applyInArrow(_part_scores(shared), "block long, data binary")
    deltas = deltas.select("block", F.lit(None).cast("binary").alias("ids"), "data")
    known = parts.where("part < 0").select("block", "ids", F.lit(None).cast("binary").alias("data"))
    deltas = known.unionByName(deltas).repartition("block").sortWithinPartitions("block", F.col("ids").isNull()).mapInArrow(_add_deltas, "doc_id long, hash long, score double")

    row, zero = ["doc_id", "hash"], F.lit(0).cast("long")
    weight = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    rare = parts.where("token IS NOT NULL").select(*row, "token", "n").join(counts, "token", "left")
    rare = rare.groupBy(row).agg(zero.alias("n"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(weight).alias("base"), F.sum(weight).alias("score"), zero.alias("copies"))
    sure = parts.where("token IS NULL AND part IS NULL").select(*row, "n", "n_known", "base", "score", F.lit(1).cast("long").alias("copies"))
    deltas = deltas.select(*row, zero.alias("n"), zero.alias("n_known"), F.lit(0.0).alias("base"), "score", zero.alias("copies"))
    total = sure.unionByName(rare).unionByName(deltas).groupBy(row).agg(*(F.sum(c).alias(c) for c in ("n", "n_known", "base", "score", "copies")))
    whole = total.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.expr("n div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"), F.lit(model.lex.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"), "copies")
    return repeat_rows(whole, "copies").drop("copy")
