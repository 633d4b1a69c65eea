import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tests.llm.fixtures import DOCUMENTS, LONG, awkward, documents

from strandplan.llm import lexical_search as ls
from strandplan.llm.common import ascii_words
from strandplan.llm.queries import ORACLES, op11_lexical_search

SF = "/root/testdata/sf0.01"
TERM = re.compile(ls.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, k=10):
    """{item_id: [(score, doc_id)]}, best first."""
    counts = [(d, Counter(own)) for d, t in docs if (own := terms(t))]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    holders = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * h + 1))) for t, h in holders.items()}
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(terms(t))
    out = {}
    for i, own in wanted.items():
        scores = []
        for d, c in counts:
            length = 10 + 90 * sum(c.values()) * n // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * length)) for t in own if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        if scores:
            out[i] = [(-s, d) for s, _, _, d in sorted(scores)[:k]]
    return out


def results(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.score, r.doc_id))
    return dict(out)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_words():
    texts = ["A b-c 1_2 É½…x\x7f\x85\xa0 z", "", "[]^`{}@:/;", "\x1c\x1d a\x0bB"]
    assert [[w.decode() for w in ascii_words(t.encode())] for t in texts] == [terms(t) for t in texts]


def test_matches_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(ORACLES["op11_lexical_search"])
    columns = [c[0] for c in want.description]
    got = op11_lexical_search(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("block_docs, batch_pairs, seeds", [(1, 1 << 18, 3), (3, 7, 1), (64, 40, 2)])
def test_matches_brute_force(spark, block_docs, batch_pairs, seeds):
    rng = random.Random(block_docs)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(300 + i, "same Text again w3") for i in range(40)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w59 w58"), (None, None)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 20])))) for i in range(25)]
    asked += [(90, "same text"), (91, "nowhere"), (92, None), (93, "--"), (94, "w59"), (95, "w0"), (95, "w7 W7"), (None, "w4 w5")]
    at = ls.Settings(block_docs=block_docs, batch_pairs=batch_pairs, seeds=seeds)
    got = results(ls.lexical_search(documents(spark, docs).repartition(5), items(spark, asked), settings=at))
    assert got == brute(docs, asked)


def test_awkward_rows(spark):
    df = awkward(spark)
    asked = [(1, "the cat sat"), (2, "a"), (3, "word5 stone7 y"), (4, "É ½"), (5, "endoftext it s")]
    got = results(ls.lexical_search(df, items(spark, asked)))
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], asked)
    none = spark.createDataFrame([], DOCUMENTS)
    assert ls.lexical_search(none, items(spark, asked)).count() == 0
    assert ls.lexical_search(df, items(spark, [])).count() == 0
    assert ls.lexical_search(none, items(spark, [])).schema == ls.lexical_search(df, items(spark, asked)).schema


def test_index_can_be_appended_to(spark):
    docs = [(i, f"w{i % 7} w{i % 11} " * (i % 5 + 1)) for i in range(200)]
    halves = [ls.build_index(documents(spark, docs[:90])), ls.build_index(documents(spark, docs[90:]))]
    asked = [(1, "w3 w10"), (2, "w6")]
    assert results(ls.search(halves[0].union(halves[1]), items(spark, asked))) == brute(docs, asked)


def test_a_very_long_text_is_a_block_of_its_own(spark):
    docs = [(0, LONG), (1, "word5"), (2, "word6 " * 10), (3, LONG * 3), (4, "stone7")]
    index = ls.build_index(documents(spark, docs).coalesce(1), ls.Settings(block_terms=10_000))
    assert sorted(r.docs for r in index.select("docs").collect()) == [1, 1, 3]
    asked = [(1, "word5 word6"), (2, "stone7")]
    assert results(ls.search(index, items(spark, asked))) == brute(docs, asked)


def test_maxima_bound_every_document_and_blocks_are_left_out():
    rng = random.Random(4)
    words = [b"w%d" % i for i in range(40)]
    blocks = [[(b * 8 + d, rng.choices(words, k=rng.randint(1, 60))) for d in range(8)] for b in range(30)]
    blocks[7][3] = (59, [b"w1", b"w2", b"w3"])
    number = {b"w1": 0, b"w2": 1, b"w3": 2}
    queries = ls.Queries(number, np.array([0, 1, 2, 3]), np.array([0, 0, 0]), 1, np.array([900, 700, 1100]), 240, sum(len(t) for b in blocks for _, t in b))
    batch = pa.RecordBatch.from_pylist([ls._block(n, b) for n, b in enumerate(blocks)])
    heads = [ls._Head(batch, r, queries) for r in range(batch.num_rows)]
    best, scored = ls._Best(1, np.zeros(1, np.int64), np.full(1, np.iinfo(np.int64).min)), 0
    for head in sorted(heads, key=lambda h: -h.bounds()[0]):
        scores = head.scores(np.array([0]))
        assert head.bounds()[0] >= scores.max()
        if best.reached(head.bounds(), head.first_doc)[0]:
            best.take(np.array([0]), scores, head.doc_ids)
            scored += 1
    assert best.rows().to_pylist() == [{"query": 0, "doc_id": 59, "score": max(int(h.scores(np.array([0])).max()) for h in heads)}]
    assert scored < len(blocks) / 2
