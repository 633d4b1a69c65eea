"""Ranked lexical search by block-max pruning over a forward index.

The index is a table with one row for each block, a range of documents that a task read one after another.  A block has a
head (its terms; for each the number of documents that hold it, and its *maxima*) and a forward part (each document's terms
with their counts).  How much a term counts in a document grows with its occurrences and falls with the document's
length, by an amount that depends on the whole corpus.  So a term's maxima are the (occurrences, length) pairs of the block
that no other pair beats in both: whatever the corpus' totals, one of them gives the block's highest value.  Blocks of new
documents can be appended without touching old ones.

A search reads heads only to add up document frequencies, and once more to bound, for each query, what a block's documents
can score at most.  The blocks with the highest bounds of each query are scored first; their tenth score is a threshold
for all tasks.  Then each task takes its blocks in falling order of their bounds and scores a block's forward part for the
queries whose bound still reaches the threshold, which rises with what it finds.  No score is estimated: a block is left
out only if nothing in it can be among the results.

Memory: a task holds a few blocks (``block_docs`` documents, closed early at ``block_terms`` terms; one very long text is a
block of its own) and ``k`` results for each query.  Queries are taken in batches of about ``batch_pairs`` (query, term)
pairs, which is what is collected and broadcast.  No shuffle carries texts or postings.

A null or term-less text counts as no document.  A null doc_id is kept, and of equal scores comes last.  Rows are ranked
one by one, so repeated rows fill several ranks.  The rows of one item_id (null is one as well) are one query of all their
terms; a query without terms or hits has no rows.  Empty tables give an empty result.  Other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandplan.llm.common import ascii_words, lower_ascii, materialise, utf8, whole_text

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HEAD = ["block", "first_doc", "names", "holders", "front_at", "front_tf", "front_n"]
INDEX = (
    "block long, docs long, terms long, first_doc long, names binary, holders binary, front_at binary, front_tf binary, front_n binary,"
    " doc_ids array<long>, lengths binary, at binary, term binary, tf binary"
)
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    block_docs: int = 32
    block_terms: int = 1 << 17
    batch_pairs: int = 1 << 18
    #: Blocks of each query that are scored before all others.
    seeds: int = 3


@dataclass(frozen=True)
class Queries:
    """Terms by number, with weights; the queries that hold term t are holder[at[t] : at[t + 1]]."""

    number: dict[bytes, int]
    at: np.ndarray
    holder: np.ndarray
    count: int
    weight: np.ndarray
    documents: int = 0
    terms: int = 0

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        length = 10 + 90 * n * self.documents // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * length)

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``term`` and each query that holds it: the query, and the place in ``term``."""
        sizes = self.at[term + 1] - self.at[term]
        place = np.repeat(np.arange(len(term)), sizes)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.holder[self.at[term][place] + inner], place


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _unpack(buffer: pa.Buffer, count: int) -> np.ndarray:
    return np.frombuffer(buffer, f"u{buffer.size // count}").astype(np.int64)


def _block(number: int, held: list[tuple[int | None, list[bytes]]]) -> dict:
    tokens = pa.array([t for _, own in held for t in own], pa.large_binary()).dictionary_encode()
    names = tokens.dictionary.to_pylist()
    lengths = np.array([len(own) for _, own in held], np.int64)
    place, tf = np.unique(np.repeat(np.arange(len(held)), lengths) * len(names) + tokens.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(place, len(names))
    order = np.lexsort((-tf, lengths[doc], term))
    rising = term[order] * (int(tf.max()) + 1) + tf[order]
    front = order[np.r_[True, rising[1:] > np.maximum.accumulate(rising)[:-1]]]
    ids = [d for d, _ in held]
    return {
        "block": number,
        "docs": len(held),
        "terms": int(lengths.sum()),
        "first_doc": min((d for d in ids if d is not None), default=_LAST),
        "names": b" ".join(names),
        "holders": _pack(np.bincount(term, minlength=len(names))),
        "front_at": _pack(np.searchsorted(term[front], np.arange(len(names) + 1))),
        "front_tf": _pack(tf[front]),
        "front_n": _pack(lengths[doc[front]]),
        "doc_ids": ids,
        "lengths": _pack(lengths),
        "at": _pack(np.searchsorted(doc, np.arange(len(held) + 1))),
        "term": _pack(term),
        "tf": _pack(tf),
    }


def _index_batches(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    binary = ["names", "holders", "front_at", "front_tf", "front_n", "lengths", "at", "term", "tf"]
    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema([(c, pa.binary() if c in binary else pa.list_(pa.int64()) if c == "doc_ids" else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size, made = [], 0, []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                if own := ascii_words(text):
                    held.append((doc, own))
                    size += len(own)
                if held and (len(held) == settings.block_docs or size >= settings.block_terms):
                    made.append(_block(number, held))
                    held, size, number = [], 0, number + 1
                    if len(made) == 16:
                        yield pa.RecordBatch.from_pylist(made, schema)
                        made = []
        if held:
            made.append(_block(number, held))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


def build_index(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The index of ``docs``(doc_id, text), written to the shared folder: a block a row, and no row for term-less texts.

    Indices of further documents may be united with it.  Blocks are numbered by task, so after a union the numbers of
    different parts may meet; only the order of scoring depends on them, never the result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return materialise(rows.mapInArrow(_index_batches(settings), INDEX), "lexical-index")


def query_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of items(item_id, text)."""
    return items.select("item_id", F.explode(F.regexp_extract_all(lower_ascii(whole_text()), F.lit(TERM), F.lit(0))).alias("term")).distinct()


class _Head:
    """A block, row ``r`` of a batch, and its bounds for all queries; reads the batch's buffers in place."""

    def __init__(self, batch: pa.RecordBatch, r: int, queries: Queries) -> None:
        self.batch, self.r, self.queries = batch, r, queries
        names = batch.column("names")[r].as_py().split(b" ")
        self.size = len(names)
        self.query_term = np.fromiter((queries.number.get(t, -1) for t in names), np.int32, self.size)
        self.hits = np.flatnonzero(self.query_term >= 0)

    def numbers(self, column: str, count: int) -> np.ndarray:
        return _unpack(self.batch.column(column)[self.r].as_buffer(), count)

    @property
    def first_doc(self) -> int:
        return self.batch.column("first_doc")[self.r].as_py()

    @property
    def doc_ids(self) -> list[int | None]:
        return self.batch.column("doc_ids")[self.r].as_py()

    def holders(self) -> np.ndarray:
        return self.numbers("holders", self.size)[self.hits]

    def bounds(self) -> np.ndarray:
        out = np.zeros(self.queries.count, np.int64)
        if len(self.hits):
            at = self.numbers("front_at", self.size + 1)
            tf, n = self.numbers("front_tf", at[-1]), self.numbers("front_n", at[-1])
            most = np.maximum.reduceat(self.queries.impact(tf, n), at[:-1])[self.hits]
            own = self.query_term[self.hits]
            query, place = self.queries.spread(own)
            np.add.at(out, query, (most * self.queries.weight[own])[place])
        return out

    def scores(self, alive: np.ndarray) -> np.ndarray:
        """A row for each of the queries ``alive``, a column for each document."""
        queries, docs = self.queries, self.batch.column("docs")[self.r].as_py()
        number = np.full(queries.count, -1)
        number[alive] = np.arange(len(alive))
        at, lengths = self.numbers("at", docs + 1), self.numbers("lengths", docs)
        own = self.query_term[self.numbers("term", at[-1])]
        hit = np.flatnonzero(own >= 0)
        doc, own, tf = np.repeat(np.arange(docs), np.diff(at))[hit], own[hit], self.numbers("tf", at[-1])[hit]
        value = queries.impact(tf, lengths[doc]) * queries.weight[own]
        query, place = queries.spread(own)
        wanted = number[query] >= 0
        out = np.zeros(len(alive) * docs, np.int64)
        np.add.at(out, number[query[wanted]] * docs + doc[place[wanted]], value[place[wanted]])
        return out.reshape(len(alive), docs)


class _Best:
    """The k best results of each query so far, and what a document must reach to be among them."""

    def __init__(self, k: int, score: np.ndarray, doc: np.ndarray) -> None:
        self.k, self.score, self.doc = k, score.copy(), doc.copy()
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in score]

    def reached(self, bound: np.ndarray, first_doc: int) -> np.ndarray:
        return (bound > 0) & ((bound > self.score) | ((bound == self.score) & (first_doc <= self.doc)))

    def take(self, alive: np.ndarray, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        ids = np.array([_LAST if d is None else d for d in doc_ids], np.int64)
        found = (scores > 0) & ((scores > self.score[alive, None]) | ((scores == self.score[alive, None]) & (ids <= self.doc[alive, None])))
        for a, d in zip(*np.nonzero(found)):
            query, entry = alive[a], (int(scores[a, d]), -int(ids[d]))
            heap = self.heaps[query]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.score[query], last = max((int(self.score[query]), -int(self.doc[query])), heap[0])
                self.doc[query] = -last

    def rows(self) -> pa.RecordBatch:
        flat = [(q, None if -d == _LAST else -d, s) for q, heap in enumerate(self.heaps) for s, d in heap]
        query, doc, score = zip(*flat) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["query", "doc_id", "score"])


def _holder_batches(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        holders = np.zeros(len(queries.number), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                head = _Head(batch, r, queries)
                holders[head.query_term[head.hits]] += head.holders()
        term = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(holders[term])], ["term", "holders"])

    return run


def _seed_batches(shared, seeds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks of the highest bounds of each query, of those that the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(queries.count)]
        least = np.zeros(queries.count, np.int64)
        for batch in batches:
            for r, block in enumerate(batch.column("block").to_pylist()):
                bounds = _Head(batch, r, queries).bounds()
                for q in np.flatnonzero(bounds > least):
                    heapq.heappush(heaps[q], (int(bounds[q]), block))
                    if len(heaps[q]) > seeds:
                        heapq.heappop(heaps[q])
                        least[q] = heaps[q][0][0]
        flat = [(q, b, bound) for q, heap in enumerate(heaps) for bound, b in heap]
        query, block, bound = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(block, pa.int64()), pa.array(bound, pa.int64())], ["query", "block", "bound"])

    return run


def _score_batches(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, score, doc = shared.value
        best = _Best(k, score, doc)
        for batch in batches:
            bounds = [_Head(batch, r, queries).bounds() for r in range(batch.num_rows)]
            for r in sorted(range(batch.num_rows), key=lambda r: -int(bounds[r].max(initial=0))):
                alive = np.flatnonzero(best.reached(bounds[r], batch.column("first_doc")[r].as_py()))
                if len(alive):
                    head = _Head(batch, r, queries)
                    best.take(alive, head.scores(alive), head.doc_ids)
        yield best.rows()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(index: DataFrame, queries: Queries, score: np.ndarray, doc: np.ndarray, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((queries, score, doc))
    columns = [*HEAD, "docs", "doc_ids", "lengths", "at", "term", "tf"]
    return _ranked(index.select(*columns).mapInArrow(_score_batches(shared, k), "query int, doc_id long, score long"), k)


def _batch(index: DataFrame, pairs: list, documents: int, terms: int, k: int, settings: Settings) -> tuple[list, DataFrame] | None:
    """The item_id of each query, and (query, doc_id, score, rank); None if no term is found anywhere."""
    sc = index.sparkSession.sparkContext
    items = {i: n for n, i in enumerate(dict.fromkeys(p.item_id for p in pairs))}
    number = {t: n for n, t in enumerate(dict.fromkeys(p.term.encode() for p in pairs))}
    term = np.array([number[p.term.encode()] for p in pairs])
    order = np.argsort(term, kind="stable")
    holder = np.array([items[p.item_id] for p in pairs])[order]
    at = np.searchsorted(term[order], np.arange(len(number) + 1))
    queries = Queries(number, at, holder, len(items), np.zeros(len(number), np.int64))
    shared = sc.broadcast(queries)
    held = index.select("names", "holders").mapInArrow(_holder_batches(shared), "term int, holders long").groupBy("term").agg(F.sum("holders").alias("holders")).collect()
    weight = np.zeros(len(number), np.int64)
    for r in held:
        weight[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.holders + 1)))
    if not weight.any():
        return None
    queries = Queries(number, at, holder, len(items), weight, documents, terms)
    shared = sc.broadcast(queries)
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    seeds = index.select(*HEAD).mapInArrow(_seed_batches(shared, settings.seeds), "query int, block long, bound long")
    seeds = seeds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= settings.seeds).select("block").distinct()
    score, doc = np.zeros(len(items), np.int64), np.full(len(items), np.iinfo(np.int64).min)
    first = index.join(F.broadcast(seeds), "block", "left_semi")  # at most seeds x queries of a batch
    for r in _scored(first, queries, score, doc, k).where(F.col("rank") == k).collect():
        score[r["query"]], doc[r["query"]] = r.score, _LAST if r.doc_id is None else r.doc_id
    return list(items), _scored(index, queries, score, doc, k)


def search(index: DataFrame, items: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each of items(item_id, text), whole corpus against all."""
    spark = index.sparkSession
    schema = f"query int, item_id {items.schema['item_id'].dataType.simpleString()}"
    documents, terms = index.agg(F.sum("docs"), F.sum("terms")).first()
    pairs = materialise(query_terms(items), "lexical-queries")
    out = spark.createDataFrame([], f"{schema[11:]}, rank int, doc_id long, score long")
    batches = -(-pairs.count() // settings.batch_pairs) if documents else 0
    for b in range(batches):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b).collect()
        if rows and (found := _batch(index, rows, documents, terms, k, settings)):
            names = spark.createDataFrame(list(enumerate(found[0])), schema)
            out = out.union(found[1].join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Index ``docs`` and search it for ``items``."""
    return search(build_index(docs, settings), items, k, settings)
