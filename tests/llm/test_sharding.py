import zlib
from collections import defaultdict

import pytest
from tests.llm.fixtures import DOCUMENTS, awkward, documents

from strandplan.llm import sharding
from strandplan.llm.queries import op4_sharding

SF = "/root/testdata/sf0.01"


def check_shards(rows, got, shards=24, slack=None):
    """Whole rows, slots from 0, sizes apart by the largest row or 1 % of a shard at most; gives shards by text."""
    want = sorted(str((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    slots, sizes, by_text = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        by_text[r["size"], r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max((r["size"] for r in got), default=0)
    slack = max(largest, total / shards / 100) + 1 if slack is None else slack
    assert all(abs(sizes[s] - total / shards) <= slack for s in range(shards))
    return by_text


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_table(spark):
    by_text = check_shards(pairs(spark.read.parquet(f"{SF}/documents.parquet")), op4_sharding(spark, SF).collect())
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("at", [sharding.Settings(), sharding.Settings(shards=5, range_rows=2, samples=2)])
def test_awkward_rows(spark, at):
    df = awkward(spark)
    check_shards(pairs(df), sharding.shard(df, at).collect(), at.shards)


def test_hot_text_and_hot_row(spark):
    df = documents(spark, [(i, f"text {i}") for i in range(2000)] + [(i, "same") for i in range(2000, 4000)] + [(9999, "one row")] * 2000)
    by_text = check_shards(pairs(df), sharding.shard(df, sharding.Settings(range_rows=100)).collect(), slack=200)
    assert sum(len(s) > 1 for s in by_text.values()) == 2  # the two groups larger than the bound


def test_groups_below_the_bound_stay_together(spark):
    """Groups that overfill ranges by their rows, but are small among the bytes; ranges are few and overfull."""
    df = documents(spark, [(i, "") for i in range(900)] + [(i, f"t{i % 40}") for i in range(1000, 2200)] + [(i, f"{i} " + "long text " * 300) for i in range(3000, 3600)])
    at = sharding.Settings(range_rows=50, most_ranges=6, whole=0.3)
    by_text = check_shards(pairs(df), sharding.shard(df, at).collect(), slack=0.3 * 1_950_000 / 24)
    assert all(len(s) == 1 for s in by_text.values())


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], DOCUMENTS)).count() == 0
