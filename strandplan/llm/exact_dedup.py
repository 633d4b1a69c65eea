"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z.  Every text becomes (SHA-256, byte length).  A task keeps a
cuckoo filter over the digests that are live in its part of the data.  A record that hits the filter is verified
against the stored content of its bucket; if it is equal and has a larger doc_id, the live record is deleted and the
new one inserted.  A full filter doubles and is refilled from the stored keys.  Tasks first index their own rows,
``HELD`` texts at a time, so that a group of copies of any size leaves each task as a few rows; these are dealt out by
digest and indexed again.

Null texts count as empty.  Null doc_ids are smaller than any other.  Rows repeated with equal doc_id and equal text
form one group with the rest, and exactly one of them is kept.  Very long texts are digested whole, and only digests and
lengths travel.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandplan.llm.common import lower_ascii, materialise, own_name, repeat_rows, shuffle_width, whole_text

LIVE = "digest binary, n_bytes long, keep_id long, group_size long"
LIVE_ARROW = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: Distinct digests that one task of the second step should index.
DIGESTS_PER_TASK = 500_000
#: Live records that a task of the first step holds before it passes them on and begins anew.
HELD = 250_000
#: Bound on dropped rows that are broadcast as doc_id and digest; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, beside the records that it stands for.

    ``records`` maps the first eight bytes of a digest to its records ``[digest, n_bytes, doc_id, count]``: a hit of
    the filter is only believed once digest and length of such a record are equal.
    """

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 1024) -> None:
        self.records: dict[int, list[list]] = {}
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (buckets * self.SLOTS)

    @staticmethod
    def _fingerprint(key: int) -> int:
        return (key >> 48) or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & self.mask)

    def _slots(self, bucket: int) -> range:
        return range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS)

    def may_contain(self, key: int) -> bool:
        fingerprint, first = self._fingerprint(key), key & self.mask
        table = self.table
        return any(table[i] == fingerprint for b in (first, self._other(first, fingerprint)) for i in self._slots(b))

    def _place(self, key: int) -> bool:
        fingerprint, bucket = self._fingerprint(key), key & self.mask
        table = self.table
        for b in (bucket, self._other(bucket, fingerprint)):
            for i in self._slots(b):
                if not table[i]:
                    table[i] = fingerprint
                    return True
        for kick in range(self.KICKS):
            i = bucket * self.SLOTS + kick % self.SLOTS
            table[i], fingerprint = fingerprint, table[i]
            bucket = self._other(bucket, fingerprint)
            for i in self._slots(bucket):
                if not table[i]:
                    table[i] = fingerprint
                    return True
        return False

    def _grow(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(self._place(key) for key, found in self.records.items() for _ in found):
                return
            buckets *= 2

    def insert(self, key: int, record: list) -> None:
        self.records.setdefault(key, []).append(record)
        self.live += 1
        if self.live > 0.9 * len(self.table) or not self._place(key):
            self._grow()

    def delete(self, key: int, record: list) -> None:
        found = self.records[key]
        found.remove(record)
        if not found:
            del self.records[key]
        self.live -= 1
        fingerprint, first = self._fingerprint(key), key & self.mask
        for b in (first, self._other(first, fingerprint)):
            for i in self._slots(b):
                if self.table[i] == fingerprint:
                    self.table[i] = 0
                    return

    def find(self, key: int, digest: bytes, n_bytes: int) -> list | None:
        if self.may_contain(key):
            for record in self.records.get(key, ()):
                if record[0] == digest and record[1] == n_bytes:
                    return record
        return None

    def add(self, digest: bytes, n_bytes: int, doc_id: int | None, count: int) -> None:
        """Count the record; of equal ones, that of the largest doc_id is live."""
        key = int.from_bytes(digest[:8], "big")
        old = self.find(key, digest, n_bytes)
        if old is None:
            self.insert(key, [digest, n_bytes, doc_id, count])
        elif doc_id is not None and (old[2] is None or doc_id > old[2]):
            self.delete(key, old)
            self.insert(key, [digest, n_bytes, doc_id, old[3] + count])
        else:
            old[3] += count


def index_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index the rows of one task and give the live records whenever ``HELD`` of them are full, and at the end."""
    index = CuckooIndex()
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in LIVE_ARROW.names), strict=True):
            index.add(*row)
        if index.live > HELD:
            yield from _live_batches(index)
            index = CuckooIndex()
    yield from _live_batches(index)


def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index all rows of one task and give its live records."""
    index = CuckooIndex()
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in LIVE_ARROW.names), strict=True):
            index.add(*row)
    yield from _live_batches(index)


def _live_batches(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for found in index.records.values():
        rows += found
        if len(rows) >= 50_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LIVE_ARROW, strict=True)], schema=LIVE_ARROW)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes) of every row's normalised text."""
    text = lower_ascii(whole_text())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def live_records(rows: DataFrame) -> DataFrame:
    """(digest, n_bytes, keep_id, group_size), one row for each distinct text, from the result of :func:`digests`."""
    own = rows.select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    combined = materialise(own.mapInArrow(index_held, LIVE), "exact-dedup-combined")
    tasks = max(shuffle_width(rows.sparkSession), -(-combined.count() // DIGESTS_PER_TASK))
    return combined.repartition(tasks, "digest").mapInArrow(index_batches, LIVE)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest doc_id of the texts equal to this one; kept is true for that row alone.
    """
    rows = materialise(digests(docs), "exact-dedup-digests")
    groups = live_records(rows).where("group_size > 1").drop("n_bytes")
    counted = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    joined = repeat_rows(counted.join(groups, "digest", "left"), "copies")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts don't move unless over ``BROADCAST_ROWS`` rows are dropped: the dropped rows' doc_ids and digests do.
    """
    rows = materialise(digests(docs), "exact-dedup-digests")
    groups = live_records(rows).where("group_size > 1").select("digest", "keep_id")
    dropped = rows.join(groups, "digest").where("NOT doc_id <=> keep_id").select("doc_id", "digest").distinct()
    dropped = materialise(dropped, "exact-dedup-dropped")
    digest = own_name(docs.columns, "digest")
    few = (F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped).alias("dropped")
    marked = docs.withColumn(digest, F.unhex(F.sha2(lower_ascii(whole_text()), 256)))
    same = (marked[digest] == F.col("dropped.digest")) & marked["doc_id"].cast("long").eqNullSafe(F.col("dropped.doc_id"))
    kept = marked.join(few, same, "left_anti")
    repeated = rows.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("digest").alias(digest)).distinct()
    repeated = materialise(repeated, "exact-dedup-repeated")
    if not repeated.isEmpty():  # some doc_id comes with one text more than once
        chosen = kept.join(repeated, digest, "left_semi").dropDuplicates([digest])
        kept = kept.join(repeated, digest, "left_anti").unionByName(chosen)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
