import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tests.llm.fixtures import DOCUMENTS, TEXTS, awkward, documents

from strandplan.llm import components, exact_dedup, near_copies, simhash
from strandplan.llm.components import connected_components
from strandplan.llm.queries import op8_simhash_near_dedup, op9_exact_dedup

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, left = hashlib.sha256(t.encode()).hexdigest(), 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left > 0, sha))
            left -= i == keep
    return out


def shingles(text):
    words = [w for w in lower(text).encode().split()]
    if not words:
        return []
    return [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]


def simhash_brute(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_brute(rows):
    prints = [simhash_brute(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{prints[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows)]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_cuckoo_index_inserts_deletes_and_grows():
    rng, index, live = random.Random(1), exact_dedup.CuckooIndex(2), {}
    for _ in range(20_000):
        digest, i = hashlib.sha256(str(rng.randrange(3000)).encode()).digest(), rng.randrange(10**6)
        index.add(digest, 1, i, 1)
        best, n = live.get(digest, (-1, 0))
        live[digest] = (max(best, i), n + 1)
    assert {r[0]: (r[2], r[3]) for found in index.records.values() for r in found} == live
    assert index.live == len(live) and all(index.may_contain(k) for k in index.records)
    assert sum(map(bool, index.table)) == len(live)


def test_exact_dedup_awkward_rows(spark):
    df = awkward(spark)
    assert sorted(map(str, map(tuple, exact_dedup.exact_dedup(df).collect()))) == sorted(map(str, exact_brute(pairs(df))))
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(lower(t) for _, t in pairs(kept)) == sorted({lower(t) for _, t in pairs(df)})


def test_exact_dedup_hot_group_and_table(spark):
    df = documents(spark, [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)])
    assert sorted(map(str, map(tuple, exact_dedup.exact_dedup(df).collect()))) == sorted(map(str, exact_brute(pairs(df))))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(str, map(tuple, op9_exact_dedup(spark, SF).collect()))) == sorted(map(str, exact_brute(pairs(docs))))


def test_exact_dedup_empty_table(spark):
    df = spark.createDataFrame([], DOCUMENTS)
    assert exact_dedup.exact_dedup(df).count() == 0 and exact_dedup.drop_exact_copies(df).count() == 0


def test_fingerprint():
    for t in TEXTS + ["a b c", "a b c d", "a\x0bb\x0cc\x85d e\x1cf"]:
        assert simhash.fingerprint((t or "").encode()) == simhash_brute(t)


def test_trie_links_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    near = base[rng.integers(0, 300, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    nodes = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(2**64 - 1)]]))
    want = {(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if int(nodes[i] ^ nodes[j]).bit_count() <= 3}
    got = [(int(i), int(j)) for a, b in simhash.trie_links(nodes, None, 63) for i, j in zip(a, b, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = nodes[::2], nodes[1::2]
    for top, one, two in ((47, nodes, None), (47, left, right)):
        other = one if two is None else two
        got = [(int(one[i]), int(other[j])) for a, b in simhash.trie_links(one, two, top) for i, j in zip(a, b, strict=True)]
        pairs = [(int(x), int(y)) for i, x in enumerate(one) for y in (one[i + 1 :] if two is None else two)]
        assert len(got) == len(set(got)) and set(got) == {(x, y) for x, y in pairs if x >> 48 == y >> 48 and (x ^ y).bit_count() <= 3}


def test_near_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)
    nodes = [base]
    for n in (1, 2, 3, 4):
        own = base.copy()
        for _ in range(n):
            own ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
        nodes.append(own)
    nodes = np.unique(np.concatenate(nodes)).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in nodes], "fp long"))
    got = dict(map(tuple, connected_components(links).collect()))
    want = {x: x for x in nodes}
    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if (x ^ y).__and__(2**64 - 1).bit_count() <= 3 and want[x] != want[y]:
                a, b = sorted((want[x], want[y]))
                want = {k: a if c == b else c for k, c in want.items()}
    assert {x: got.get(x, x) for x in nodes} == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {k: 5 for k in range(200, 260)} | {5: 5, 8: 8, 9: 8}


def test_simhash_awkward_rows(spark):
    df = awkward(spark)
    assert sorted(map(str, map(tuple, simhash.simhash_dedup(df).collect()))) == sorted(map(str, near_brute(pairs(df))))


def sets(text):
    w = lower(text).encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups_brute(rows, at=near_copies.Settings()):
    """The smallest doc_id of what links of either kind connect, by doc_id; rows have distinct doc_ids."""
    least = {i: c for i, _, c in near_brute(rows)}
    shingle = {i: sets(t) for i, t in rows}
    holders = defaultdict(set)
    for i, own in shingle.items():
        for s in own:
            holders[s].add(i)
    links = []
    for i, a in shingle.items():
        for j in {j for s in a for j in holders[s] if j < i}:
            both = len(a & shingle[j])
            if both >= at.similarity * (len(a) + len(shingle[j]) - both):
                links.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            for k in (i, j):
                if least[k] != low:
                    old = least[k]
                    least = {x: low if c == old else c for x, c in least.items()}
                    changed = True
    return least


def test_near_copies_awkward_rows(spark):
    df = awkward(spark)
    kept = near_copies.drop_near_copies(df)
    want = {c for i, _, c in near_brute(pairs(df)) if c is not None}
    assert kept.columns == df.columns
    ids = [i for i, _ in pairs(kept)]
    assert set(i for i in ids if i is not None) <= want and len(ids) == len(set(ids))
    assert ids.count(None) == 1
    assert near_copies.drop_near_copies(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_near_copies_of_all_grades(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 100, 400]))]
        for edits in (0, 0, 1, 2, 3, 6, 40):
            own = words.copy()
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    want = groups_brute(rows)
    kept = {i for i, _ in pairs(near_copies.drop_near_copies(documents(spark, rows)))}
    assert {i for i, c in want.items() if i == c} == kept


def test_signature_ignores_how_often_a_line_repeats():
    rng = random.Random(3)
    line = " ".join(f"l{rng.randrange(10**6)}" for _ in range(12))
    before, after = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(2))
    once, often = (f"{before} {' '.join([line] * n)} {after}".encode() for n in (2, 40))
    at = near_copies.Settings()
    assert near_copies.signature(once, at) == near_copies.signature(often, at)


@pytest.mark.parametrize(("part", "tile", "tile_bytes"), [(7, 16, 1 << 23), (1 << 15, 1024, 20_000), (1 << 15, 1024, 1 << 23), (1 << 15, 10, 1 << 23)])
def test_similar_candidates_of_a_crowd_are_all_verified(spark, part, tile, tile_bytes):
    rng = random.Random(12)
    template = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(120):
        own = template.copy()
        for k in rng.sample(range(300), rng.choice([2, 3, 4, 4, 5])):
            own[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    at = near_copies.Settings(crowd=8, part=part, tile=tile, tile_bytes=tile_bytes)
    signs = [near_copies.signature(t.encode(), at) for t in texts]
    bits = np.array([np.frombuffer(b, np.uint8) for b in signs])
    shingle = [sets(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            differ = np.bitwise_count(bits[i] ^ bits[j])
            near = differ[:8].sum() <= at.sketch_bits and differ[8:].reshape(-1, 4).sum(axis=1).min() <= at.budget
            if near and len(shingle[i] & shingle[j]) >= at.similarity * len(shingle[i] | shingle[j]):
                a, b = want[i], want[j]
                want = [min(a, b) if c in (a, b) else c for c in want]
    signed = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(signs)], "doc long, signature binary")
    links = near_copies.similar_links(signed, spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), at)
    got = dict(map(tuple, connected_components(links).collect()))
    assert [got.get(i, i) for i in range(len(texts))] == want


@pytest.mark.parametrize("apart", [True, False])
def test_links_of_a_tile_join_what_its_similar_candidates_join(apart):
    rng = np.random.default_rng(5)
    at = near_copies.Settings(sketch_bits=26, budget=6)
    base = rng.integers(0, 1 << 62, (4, 60))
    held = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 1 << 62, 60), base[k % 4])).astype(np.uint64) for k in range(60)]
    signs = np.array([np.frombuffer(near_copies._sign(x, at), np.uint8) for x in held])
    group = np.where(np.arange(60) < 12, np.arange(60) % 4, np.arange(60))  # some are linked before
    asks = np.arange(60) >= 12
    table = pa.table({"doc": pa.array(range(60)), "group": pa.array(group), "asks": pa.array(asks), "shingles": pa.array([x.view(np.int64).tolist() for x in held], pa.list_(pa.int64()))})
    table = near_copies._with_signatures(table, at)
    left = table.filter(pa.array(asks)) if apart else table.set_column(2, "asks", pa.array([True] * 60))
    found = near_copies._joining(left, table if apart else left, at)
    got, want = group.copy(), group.copy()
    for i, j in zip(*(found.column(c).to_pylist() for c in ("u", "v")), strict=True):
        assert got[i] != got[j] and len(set(held[i]) & set(held[j])) >= at.similarity * len(set(held[i]) | set(held[j]))
        got[got == got[j]] = got[i]
    candidates = 0
    for i in range(60):
        for j in range(i):
            differ = np.bitwise_count(signs[i] ^ signs[j])
            near = differ[:8].sum() <= at.sketch_bits and differ[8:].reshape(-1, 4).sum(axis=1).min() <= at.budget
            if near and (asks[i] or asks[j] or not apart):
                candidates += 1
                if len(set(held[i]) & set(held[j])) >= at.similarity * len(set(held[i]) | set(held[j])):
                    want[want == want[j]] = want[i]
    same = lambda g: {tuple(np.flatnonzero(g == x).tolist()) for x in np.unique(g)}
    assert candidates > 50 and same(got) == same(want) and len(same(want)) < 48
    none = near_copies._joining(left.slice(0, 0), table, at)
    assert none.num_rows == 0


def test_stars_of_a_task():
    ends = np.array([[5, 9, 7, 1, 30, 2], [7, 5, 3, 2, 40, 1]])
    assert sorted(components._stars(ends).T.tolist()) == [[2, 1], [5, 3], [7, 3], [9, 3], [40, 30]]


def test_links_of_a_crowd_connect_it():
    at = near_copies.Settings(crowd=4, held=50)
    links = near_copies.Links(30, at)
    for i in range(20):
        j = np.arange(i + 1, 20)
        links.add(np.full(len(j), i), j, j - i)
    links.add(np.array([25, 25, 26]), np.array([26, 27, 27]), np.array([1, 2, 1]))
    out = {tuple(x) for x in links.reduce()[:2].T.tolist()}
    assert {(i, i + 1) for i in range(19)} == {e for e in out if e[0] < 20} and {(25, 26), (25, 27), (26, 27)} <= out


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(str, map(tuple, op8_simhash_near_dedup(spark, SF).collect()))) == sorted(map(str, near_brute(pairs(docs))))


def test_simhash_empty_table(spark):
    df = spark.createDataFrame([], DOCUMENTS)
    assert simhash.simhash_dedup(df).count() == 0
