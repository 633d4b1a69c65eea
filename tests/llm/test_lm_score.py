import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import DOCUMENTS, awkward, documents

from strandplan.llm import lm_score
from strandplan.llm.queries import op6_lm_scoring

SF = "/root/testdata/sf0.001"
SMALL = dict(words=20, suffixes=10, hashed=64, rounds=4)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split(), b""]


def base_brute(rows):
    seen = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    total, kinds = sum(seen.values()), len(seen)
    share = lambda w: math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(i, held_out(i), len(tokens(t)), sum(w in seen for w in tokens(t)), total, sum(map(share, tokens(t)))) for i, t in rows]


def key(row):
    return str((row[0], *row[2:5], round(row[5], 6)))


def check_base(rows, got):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]
    want = base_brute(rows)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_awkward_rows(spark, frequent):
    df = awkward(spark)
    got = lm_score.lm_scores(df, lm_score.Settings(frequent=frequent, held=3, chunk=50, **SMALL)).collect()
    check_base(pairs(df), got)
    assert all(math.isfinite(r.score) for r in got)


def test_table_and_held_out_gain(spark):
    rows = pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    got = op6_lm_scoring(spark, SF).collect()
    check_base(rows, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    plain = [r for r in lm_score.lm_scores(spark.read.parquet(f"{SF}/documents.parquet"), lm_score.Settings(least=10**9)).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.score for r in plain)  # what token features add


def test_rare_tokens_score_as_frequent_ones_do(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    runs = [lm_score.lm_scores(df, lm_score.Settings(frequent=n, least=10**9, **SMALL)).collect() for n in (30, 100_000)]
    a, b = ({r.doc_id: r.score for r in run} for run in runs)
    assert all(math.isclose(a[k], b[k], rel_tol=1e-5) for k in a), max(abs(a[k] / b[k] - 1) for k in a if b[k])


def inner_brute(context, further, rank, copies, share, at):
    """log P(token | class, a, b) less the bias, with the features' weights found by many small steps."""
    n2, n3, nc = Counter(), Counter(), Counter()
    for g, f, r, m in zip(context, further, rank, copies, strict=True):
        n2[g, r] += m
        n3[g, f, r] += m
        nc[g, f] += m
    near = {k for k, n in n2.items() if n >= at.least and k[1]}
    far = {k for k, n in n3.items() if n >= at.least and k[2]}
    w, v = dict.fromkeys(near, 0.0), dict.fromkeys(far, 0.0)

    def p(g, f, r):
        own = {t: share[t - 1] * math.exp(w[g, t] + v.get((g, f, t), 0.0)) for x, t in near if x == g}
        z = sum(own.values()) + 1 - sum(share[t - 1] for t in own)
        return own.get(r, share[r - 1] if r else 1.0) / z

    for _ in range(1500):
        e2, e3 = Counter(), Counter()
        for (g, f), n in nc.items():
            for x, t in near:
                if x == g:
                    e2[g, t] += n * p(g, f, t)
                    if (g, f, t) in far:
                        e3[g, f, t] += n * p(g, f, t)
        for k in near:
            w[k] += 0.1 * (n2[k] - at.discount - e2[k] - at.ridge * w[k]) / n2[k]
        for k in far:
            v[k] += 0.1 * (n3[k] - at.discount - e3[k] - at.ridge * v[k]) / n3[k]
    return [math.log(p(g, f, r) / (share[r - 1] if r else 1.0)) for g, f, r in zip(context, further, rank, strict=True)]


def test_softmax_within_classes_against_brute_force():
    rng = np.random.default_rng(6)
    n, at = 60, lm_score.Settings(part_rounds=400)
    context, further, rank = rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(0, 4, n)
    copies, share = rng.integers(0, 3, n), np.array([0.1, 0.25, 0.05])
    got = lm_score.part_deltas(*(x.astype(np.uint64) for x in (context, further)), rank.astype(np.uint32), copies, share, at)
    assert np.allclose(got, inner_brute(context.tolist(), further.tolist(), rank.tolist(), copies.tolist(), share.tolist(), at), atol=0.02)


def test_score_grows_with_what_the_corpus_repeats(spark):
    """Texts of the same words in an order of their own: those that occur twice score above those that occur once."""
    import random

    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:75])]
    at = lm_score.Settings(words=5, suffixes=8, hashed=64, rounds=2)
    got = lm_score.lm_scores(documents(spark, rows), at).collect()
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in got}
    twice = [gain[i] for i in range(75) if not held_out(i) and not held_out(i + 150)]
    once = [gain[i] for i in range(75, 150)]
    assert np.mean([x > max(once) for x in twice]) > 0.9
    plain = lm_score.lm_scores(documents(spark, rows), lm_score.Settings(words=5, suffixes=8, hashed=64, rounds=2, least=10**9)).collect()
    assert sum(r.score for r in got) > sum(r.score for r in plain)


def test_parts_and_chunks_do_not_change_scores(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    runs = [lm_score.lm_scores(df, lm_score.Settings(chunk=c, part_tokens=p, **SMALL)).collect() for c, p in ((500, 1000), (400_000, 1000), (400_000, 1 << 21))]
    a, b, c = ({r.doc_id: r.score for r in run} for run in runs)
    assert all(math.isclose(a[k], x[k], rel_tol=1e-6) for k in a for x in (b, c))


def test_shuffle_partitions_do_not_change_scores(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    before, runs = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 32):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            runs.append({r.doc_id: r.score for r in lm_score.lm_scores(df, lm_score.Settings(**SMALL)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = runs
    assert all(math.isclose(a[k], b[k], rel_tol=1e-6) for k in a), max(abs(a[k] / b[k] - 1) for k in a if b[k])


def test_rare_tokens_have_features(spark):
    """Nearly all tokens are beyond the broadcast ones: what they repeat in training raises the score of held-out texts too."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    at = {**SMALL, "frequent": 30}
    runs = [lm_score.lm_scores(df, lm_score.Settings(**at, **more)).collect() for more in ({}, {"buckets": 1}, {"least": 10**9})]
    own, one, none = (sum(r.score for r in run if r.held_out) for run in runs)
    assert own > one and own > none


def test_shares_of_tokens_and_buckets_make_up_a_class(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for frequent in (30, 100_000):
        at = lm_score.Settings(frequent=frequent, **SMALL)
        model = lm_score.fit(df, lm_score.token_counts(df, at), at)
        lex, share = model.lex, model.shares()
        ranks, buckets = share[: len(lex.tokens)], share[len(lex.tokens) :].reshape(at.suffixes, at.buckets).sum(1)
        whole = np.bincount(lex.classes(), ranks, at.classes)[1 + at.words :] + buckets
        places = 0.1 * (at.buckets - 1) / (lex.class_total + 0.1 * (lex.class_kinds + 1))[1 + at.words :]  # a token never seen in each bucket
        assert np.allclose(whole - places, 1) and lex.bucket_total.min() >= 0 and lex.bucket_kinds.min() >= 0


def test_probabilities_of_a_context_sum_to_one(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    at = lm_score.Settings(**SMALL)
    counts = lm_score.token_counts(df, at)
    model = lm_score.fit(df, counts, at)
    lex = model.lex
    logits = lm_score._logits(model.weights, np.array([1, 5, at.classes]), np.array([3, at.classes, at.classes]), at)
    of_class = np.exp(logits - logits.max(1, keepdims=True))
    of_class /= of_class.sum(1, keepdims=True)
    inside, classes = np.zeros(at.classes), lex.classes()
    np.add.at(inside, classes, 10**model.inside)
    inside[at.words + 1 :] += 0.1 * 10 ** model.inside_rest[at.words + 1 :]  # never seen
    known = np.bincount(classes, minlength=at.classes) > 0
    assert np.allclose(inside[known], 1) and np.allclose(of_class.sum(1), 1)


def test_brute_force_score(spark):
    df = documents(spark, [(i, t) for i, t in enumerate(["a b c a b", "b a. c!", "c c a", None, "d b a"])])
    at = lm_score.Settings(words=2, suffixes=3, hashed=8, rounds=3, least=10**9)
    training = df.where(f"NOT {lm_score.HELD_OUT}")
    model = lm_score.fit(training, lm_score.token_counts(training, at), at)
    lex = model.lex
    own = dict(zip(lex.tokens, lex.classes().tolist()))
    seen = dict(zip(lex.tokens, lex.counts.tolist()))
    for r in lm_score.lm_scores(df, at).collect():
        text = next(x.text for x in df.collect() if x.doc_id == r.doc_id)
        s1 = s2 = at.classes
        score = 0.0
        for w in tokens(text):
            k = own.get(w, lm_score.suffix_class(w, at))
            logits = lm_score._logits(model.weights, np.array([s1]), np.array([s2]), at)[0].astype(float)
            score += (logits[k] - math.log(np.exp(logits).sum())) / math.log(10)
            if k > at.words:
                score += math.log10((seen.get(w, 0) + 0.1) / (lex.class_total[k] + 0.1 * (lex.class_kinds[k] + 1)))
            s1, s2 = k, s1
        assert math.isclose(score, r.score, rel_tol=1e-4)


def test_no_rows_and_no_training_rows(spark):
    at = lm_score.Settings(**SMALL)
    assert lm_score.lm_scores(spark.createDataFrame([], DOCUMENTS), at).count() == 0
    only = next(i for i in range(100) if held_out(i))
    got = lm_score.lm_scores(documents(spark, [(only, "x y")]), at).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] and math.isfinite(got[0].score)


def test_a_part_is_trained_in_little_memory():
    """A million occurrences in packed blocks; 64-bit numbers and copies of all columns took over 120 MB."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import zstandard

    n, blocks, at = 1_000_000, 10, lm_score.Settings()
    rng, press = np.random.default_rng(1), zstandard.ZstdCompressor(1)
    data = []
    for _ in range(blocks):
        context = np.sort(rng.zipf(1.3, n // blocks) % 200_000)
        data.append(lm_score._packed([np.diff(context, prepend=0), *(rng.zipf(1.3, n // blocks) % k for k in (5000, 500_000, 3)), np.arange(n // blocks)], press))
    model = SimpleNamespace(lex=SimpleNamespace(at=at), shares=lambda: np.full(500_000, 1e-4))
    run = lm_score._part_scores(SimpleNamespace(value=model))
    tracemalloc.start()
    out = run(pa.table({"block": pa.array(range(blocks), pa.int64()), "data": pa.array(data, pa.binary())}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == blocks and peak < 100e6, peak
