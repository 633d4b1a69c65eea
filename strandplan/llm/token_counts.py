"""Token counts from pre-token frequencies.

Pieces are counted once for each distinct pre-token of the corpus.  Per document only pre-token frequencies are needed:
those of the ``frequent`` commonest pre-tokens meet their counts in the task (their table has at most that many rows and
is broadcast), those of rarer ones are dealt out and joined.  Ids are never materialised.

A null text is empty.  Rows that repeat doc_id and text are counted alike and each returned.  Special strings in a text
are one token each, as the library takes them by default.  A text of any length is counted whole, by one task, which holds
the frequencies of its pre-tokens.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.bpe import WordBpe, word_bpe
from strandplan.llm.common import commonest, materialise, repeat_rows, whole_text


@dataclass(frozen=True)
class Settings:
    over: int = 2048
    #: Bound on the broadcast table.
    frequent: int = 1 << 17
    #: Distinct runs or pre-tokens that a task counts before it passes them on.
    held: int = 300_000
    tokenizer: str | None = None


_COUNTS = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])


def _counts(counter: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array(counter.values(), pa.int64())], schema=_COUNTS)


def _count_batches(at: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(at.tokenizer)
        runs: Counter = Counter()
        pretokens: Counter = Counter()

        def spread() -> None:
            for w, n in runs.items():
                for p in bpe.pretokens(w):
                    pretokens[p] += n
            runs.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = bpe.runs(text)
                (pretokens if found is None else runs).update(bpe.library_pretokens(text) if found is None else found)
                if len(runs) > at.held:
                    spread()
                    if len(pretokens) > at.held:
                        yield _counts(pretokens)
                        pretokens.clear()
        spread()
        yield _counts(pretokens)

    return run


def _piece_batches(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            pieces = [len(bpe.ids(p)) for p in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int32())], ["pretoken", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(pretoken, n, pieces) for every distinct pre-token of ``docs``; n is its number of occurrences."""
    own = docs.select(whole_text().alias("text")).mapInArrow(_count_batches(settings), "pretoken string, n long")
    counted = own.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(_piece_batches(settings.tokenizer), "pretoken string, n long, pieces int")


class RunPieces(dict):
    """Pieces of a run, or RARE if it has a pre-token whose pieces aren't known here; holds ``limit`` runs."""

    RARE = 1 << 40

    def __init__(self, bpe: WordBpe, known: dict[str, int], limit: int) -> None:
        super().__init__()
        self.bpe, self.known, self.limit = bpe, known, limit

    def __missing__(self, run: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = [self.known.get(p) for p in self.bpe.pretokens(run)]
        self[run] = pieces = self.RARE if None in found else sum(found)
        return pieces


_PARTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("hash", pa.int64()), ("pretoken", pa.string()), ("n", pa.int64())])


def _part_batches(at: Settings, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(at.tokenizer)
        known = dict(zip(shared.value.column("pretoken").to_pylist(), shared.value.column("pieces").to_pylist(), strict=True))
        pieces = RunPieces(bpe, known, at.held)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, n_bytes, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = bpe.runs(text)
                if runs is None:
                    rare = Counter(bpe.library_pretokens(text))
                    sure = 0
                else:
                    total = sum(map(pieces.__getitem__, runs))
                    sure, rare = total & (pieces.RARE - 1), Counter()
                    if total >= pieces.RARE:
                        for w in runs:
                            if pieces[w] >= pieces.RARE:
                                rare.update(bpe.pretokens(w))
                for p in [p for p in rare if p in known]:
                    sure += known[p] * rare.pop(p)
                rows.append((doc_id, n_bytes, key, None, sure))
                rows += [(doc_id, n_bytes, key, p, n) for p, n in rare.items()]
                if len(rows) >= 100_000:
                    yield _part_batch(rows)
                    rows = []
            if rows:
                yield _part_batch(rows)

    return run


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)


def token_counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    text = whole_text()
    known = materialise(vocabulary(docs, settings), "token-vocabulary")
    frequent = commonest(known, "n", "pretoken", settings.frequent).select("pretoken", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(frequent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("hash"), text.alias("text"))
    parts = materialise(rows.mapInArrow(_part_batches(settings, shared), "doc_id long, n_bytes long, hash long, pretoken string, n long"), "token-parts")
    row = ["doc_id", "n_bytes", "hash"]
    rare = parts.where("pretoken IS NOT NULL").join(known.select("pretoken", "pieces"), "pretoken")
    rare = rare.groupBy(row).agg(F.sum(F.col("n") * F.col("pieces")).alias("n"), F.lit(0).cast("long").alias("copies"))
    sure = parts.where("pretoken IS NULL").select(*row, "n", F.lit(1).cast("long").alias("copies"))
    total = sure.unionByName(rare).groupBy(row).agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
    total = total.withColumn("n_tokens", F.expr("n div copies"))
    return repeat_rows(total, "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > settings.over).alias("over_limit"))
