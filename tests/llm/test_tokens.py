import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import DOCUMENTS, awkward
from tokenizers import Tokenizer

from strandplan.llm import packing, token_counts
from strandplan.llm.bpe import IdCache, word_bpe
from strandplan.llm.common import commonest
from strandplan.llm.queries import op1_token_counts, op2_packing

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", "ábc it's 'S I'LL 12³ ½", "Σας ΟΔΟΣ", "<|endoftext|>x<|startoftext|> y <|ENDOFTEXT|>", "日本語 😀😀 x_y--z", "İstanbul ı ŉ ſ ﬁ", "a\xa0b\x85c\x1cd\x0be f​g\xadh", "É é ª º ¹", "﻿x \x00y"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(text):
    return np.frombuffer(IdCache(word_bpe()).text(text), "<u4").tolist()


@given(st.text(max_size=60) | st.text(alphabet="ab'sS .!éÉ1²<|>_\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    assert packed(text) == ids(text)
    assert [i for p in word_bpe().library_pretokens(text) for i in word_bpe().ids(p)] == ids(text)


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert packed(text) == ids(text)


def counts_brute(rows):
    return sorted(str((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048)) for i, t in rows)


@pytest.mark.parametrize("frequent", [0, 3, 1 << 17])
def test_token_counts_awkward_rows(spark, frequent):
    df = awkward(spark)
    got = token_counts.token_counts(df, token_counts.Settings(frequent=frequent, held=5)).collect()
    assert sorted(str(tuple(r)) for r in got) == counts_brute([(r.doc_id, r.text) for r in df.collect()])


def test_commonest(spark):
    counts = [1000, 900, 50, 50, 7, *[1] * 100]
    df = spark.createDataFrame([(f"t{k:03}", n) for k, n in enumerate(counts)], "token string, n long")
    names = lambda limit: [r.token for r in commonest(df, "n", "token", limit).collect()]
    assert names(0) == [] and names(2) == ["t000", "t001"] and set(names(4)) == {"t000", "t001", "t002", "t003"}
    for n in (3, 20, 30):  # ties are cut by their hash
        assert len(names(n)) == n and names(n) == names(105)[:n]
    assert commonest(df.limit(0), "n", "token", 5).count() == 0


def test_token_counts_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(str(tuple(r)) for r in op1_token_counts(spark, SF).collect()) == counts_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_documents(spark):
    df = spark.createDataFrame([], DOCUMENTS)
    assert token_counts.token_counts(df).count() == 0 and packing.pack(df).count() == 0


def check_packing(rows, pieces, capacity=2048):
    """Each id of each row in exactly one piece, sequences gapless and not too long; gives the share of padding."""
    want, got = defaultdict(int), defaultdict(list)
    for i, t in rows:
        want[i, tuple(ids(t) + [1])] += 1
    for p in pieces:
        got[p.sequence_id].append(p)
    padding, total, by_doc = 0, 0, defaultdict(list)
    for sequence in got.values():
        sequence.sort(key=lambda p: p.offset)
        assert [p.offset for p in sequence] == list(np.cumsum([0] + [p.length for p in sequence])[:-1])
        length = sum(p.length for p in sequence)
        assert 0 < length <= capacity and min(p.length for p in sequence) > 0
        padding += 0 if length & (length - 1) == 0 else capacity - length
        total += length
    for p in pieces:
        by_doc[p.doc_id].append(p)
    pieces_wanted = sum(len(k[1]) * n for k, n in want.items())
    assert total == pieces_wanted
    for i, group in by_doc.items():
        if sum(n for k, n in want.items() if k[0] == i) == 1:
            whole = next(list(k[1]) for k in want if k[0] == i)
            group.sort(key=lambda p: p.start)
            assert [p.start for p in group] == list(np.cumsum([0] + [p.length for p in group])[:-1])
            assert sum(p.length for p in group) == len(whole) == group[0].doc_tokens
            for p in group:
                assert p.ids_crc32 == zlib.crc32(np.array(whole[p.start : p.start + p.length], "<u4").tobytes())
    return padding / total


def test_packing_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert check_packing(rows, packing.pack(df.coalesce(1)).collect()) < 0.02
    small = packing.Settings(capacity=64, chunk=100, stride=4)
    assert check_packing(rows, packing.pack(df, small).collect(), 64) < 0.1


def test_packing_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packing(rows, op2_packing(spark, SF).collect()) < 0.01


def test_cut_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        places = [0, *sorted(rng.sample(range(1, 60), rng.randint(3, 20)))]
        places = [p for k, p in enumerate(places) if not k or p - places[k - 1] <= 16]
        fees = [0] + [rng.choice([0, 2, 6]) for _ in places[1:]]
        if any(b - a > 16 for a, b in zip(places, places[1:])):
            continue
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + 16 - places[j] + places[i] for i in range(j) if places[j] - places[i] <= 16) + fees[j]
        chain = packing.cut(np.array(places), np.array(fees), 16)
        assert chain[0] == 0 and chain[-1] == places[-1]
        assert sum(16 - b + a + fees[places.index(b)] for a, b in zip(chain, chain[1:])) == best[-1]


def test_cut_rest():
    at = packing.Settings()
    for n in range(1, 2049):
        parts = packing.cut_rest(n, at)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts[:-1])
