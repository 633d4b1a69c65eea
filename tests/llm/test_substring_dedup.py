import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from tests.llm.fixtures import DOCUMENTS, awkward, documents

from strandplan.llm import substring_dedup as sd
from strandplan.llm.queries import op10_substring_dedup

SF = "/root/testdata/sf0.001"


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shared(a, b, n=50):
    """Starts in a of n words that b has too."""
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return [i for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in grams]


def check_passages(rows, got, at=sd.Settings()):
    """Reported passages are alike; every verbatim one is covered in the later of its texts, as are all copies."""
    text = {i: words(t) for i, t in rows if i is not None}
    covered = {i: np.zeros(len(w), bool) for i, w in text.items()}
    for r in got:
        assert r.source_id < r.doc_id and r.similarity >= at.similarity and r.start + r.n_words <= len(text[r.doc_id])
        covered[r.doc_id][r.start : r.start + r.n_words] = True
        mine, theirs = text[r.doc_id][r.start : r.start + r.n_words], text[r.source_id][r.source_start : r.source_start + r.n_words + at.bridge]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (mine, theirs))
        assert len(a & b) / len(a) >= 0.6
    standing = {}
    for i in sorted(text):
        standing.setdefault(tuple(text[i]), i)
    for i, w in text.items():
        if standing[tuple(w)] != i and len(w) >= 50:
            assert covered[i].all()
    grams = {}
    for i in sorted(standing.values()):
        w = text[i]
        for k in range(len(w) - 49):
            first = grams.setdefault(tuple(w[k : k + 50]), i)
            assert first == i or covered[i][k : k + 50].all(), (i, k, first)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(2)
    for n, kinds in ((40, 1000), (60, 4), (30, 1)):
        tokens = rng.integers(0, kinds, n, dtype=np.uint64) * np.uint64(sd._ODD[2])
        begins, ends = np.array([0, n // 3]), np.array([n // 3, n])
        l, c, r = sd.compact_windows(tokens, begins, ends, 5, 1)
        mixed = sd._mixed(tokens, 1) & ~sd._PLACES
        for b, e in zip(begins, ends, strict=True):
            for i in range(b, e):
                for j in range(i + 4, e):
                    inside = (l <= i) & (i <= c) & (c <= j) & (j <= r)
                    assert inside.sum() == 1 and mixed[c[inside][0]] == mixed[i : j + 1].min()


def test_words_hashed_together():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aBcÄ日 \t\n\x0b\x00\x1c") for _ in range(rng.randrange(200))).encode() for _ in range(200)]
    texts += [b"", b" ", b" lead", b"trail ", *(b"x" * n + b" y" for n in (1, 3, 4, 7, 8, 9, 12, 15, 16, 31, 32, 33, 5000))]
    for text, (found, n) in zip(texts, sd.hashed_texts(texts), strict=True):
        assert found.tolist() == sd.word_hashes(text).tolist() == [xxhash.xxh64_intdigest(w) for w in text.lower().split()] and n == len(found)
    shingles = [found[: max(0, n - 4)].tolist() for found, n in sd.hashed_texts(texts, lambda words: sd.shingle_hashes(words, 5))]
    assert shingles == [sd.shingle_hashes(sd.word_hashes(t), 5).tolist() for t in texts]
    tokens = np.random.default_rng(3).integers(0, 1 << 63, 3, dtype=np.uint64)[np.random.default_rng(4).integers(0, 3, 900)]
    for size in (1, 3, 46, 64):
        runs = {}
        for i, key in enumerate(sd.run_hashes(tokens, size).tolist()):
            assert runs.setdefault(tuple(tokens[i : i + size].tolist()), key) == key
        assert len(set(runs.values())) == len(runs) and len(sd.run_hashes(tokens, size)) == 901 - size


def test_links_are_joined_before_they_are_dealt_out():
    """Documents that share a long passage pass on a stretch or two for each two that are linked, not a link for each joint window."""
    rng = random.Random(8)
    prose = lambda n: [f"l{rng.randrange(10**6)}" for _ in range(n)]
    passage, at = prose(600), sd.Settings()
    texts = [" ".join(prose(60) + passage + prose(60)).encode() for _ in range(20)]
    (rows,) = sd._window_batches(at)(iter([pa.record_batch([pa.array(range(20)), pa.array(texts)], ["doc", "text"])]))
    shared = rows.filter(pc.greater(rows["state"], sd._ALONE)).sort_by([("doc", "ascending"), ("place", "ascending")])
    found = [(r["doc"], r["to_doc"]) for b in sd._joint_batches(at)(iter([shared])) for r in b.to_pylist() if r["to_doc"] is not None]
    assert {(i, j) for i in range(1, 20) for j in (0, i - 1)} <= set(found) and len(found) < 190


def test_shuffle_files_go_with_the_step(spark):
    before = spark.conf.get(sd._CLEANUP, None)
    written = sd._written(spark.range(5000).repartition("id"), "passages-test")
    left = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    deal = spark.range(5000).repartition("id")
    sd._written(deal, "passages-test")
    after = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    assert written.count() == 5000 and after.count("shuffle_") <= left.count("shuffle_") and spark.conf.get(sd._CLEANUP, None) == before


def test_planted_passages(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    passages = [prose(n) for n in (50, 55, 80, 200)]
    rows = [(i, " ".join(prose(rng.randint(0, 300)) + (passages[i % 4] if i % 3 else []) + prose(rng.randint(0, 300)))) for i in range(90)]
    edited = passages[3].copy()
    edited[100] = "changed"
    rows += [(200, " ".join(prose(100) + edited + prose(100))), (201, "THE " * 400), (202, "the\n" * 300), (203, rows[5][1].upper()), (204, rows[5][1])]
    got = sd.substring_dedup(documents(spark, rows), sd.Settings(chunk=2000)).collect()
    check_passages(rows, got)
    assert any(r.doc_id == 200 and r.n_words >= 190 for r in got)
    assert {r.doc_id for r in got if r.doc_id < 90} <= {i for i in range(90) if i % 3}


def test_passages_that_the_first_document_holds_in_part(spark):
    rng = random.Random(7)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line = prose(12)
    rows = []
    for k in range(30):
        passage = prose(60)
        for held in (passage[:40], passage[20:], passage, passage):
            rows.append((len(rows), " ".join(prose(80) + held + prose(40) + (line if k % 2 else []) + prose(80))))
    got = sd.substring_dedup(documents(spark, rows), sd.Settings(chunk=2000)).collect()
    check_passages(rows, got)
    assert {r.doc_id for r in got} == {i for i in range(len(rows)) if i % 4 == 3}


def test_common_phrases_do_not_hide_a_passage(spark):
    """A first document with the phrases of a passage's minima in other contexts, in any order of the partitions."""
    rng = random.Random(21)
    prose = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(50)
    tokens = sd.shingle_hashes(sd.word_hashes(" ".join(passage).encode()), 5)
    lows = sorted({int(c) for j in range(5) for c in sd.compact_windows(tokens, np.array([0]), np.array([len(tokens)]), 46, j)[1]})
    first = [w for c in lows for w in prose(90) + passage[c : c + 5]] + prose(90)
    rows = [(1, " ".join(first)), (2, " ".join(prose(70) + passage + prose(70))), (3, " ".join(prose(80) + passage + prose(9)))]
    for turn in range(3):
        df = documents(spark, rows[turn:] + rows[:turn])
        for n in (1, 3):
            assert [(r.doc_id, r.start, r.n_words, r.source_id, r.source_start) for r in sd.substring_dedup(df.repartition(n)).collect()] == [(3, 80, 50, 2, 70)]


def test_decoys_do_not_hide_an_edited_passage(spark):
    """Two documents that hold the minima of all windows of a passage's both versions, each in a context of its own."""
    rng = random.Random(17)
    prose = lambda n: [f"d{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(120)
    edited = passage.copy()
    edited[40], edited[80] = "one", "two"

    def minima(words, j):
        tokens = sd.shingle_hashes(sd.word_hashes(" ".join(words).encode()), 5)
        return sorted({int(c) for c in sd.compact_windows(tokens, np.array([0]), np.array([len(tokens)]), 46, j)[1]})

    def decoy():
        out = []
        for version in (passage, edited):
            for j in range(5):
                for c in minima(version, j):
                    part = prose(60) + version[c : c + 5] + prose(60)
                    while 60 not in minima(part, j):
                        part = prose(60) + version[c : c + 5] + prose(60)
                    out += part
        return out

    rows = [(1, " ".join(decoy())), (10, " ".join(prose(80) + passage + prose(60))), (20, " ".join(decoy())), (30, " ".join(prose(80) + edited + prose(60)))]
    for n in (1, 4):
        (found,) = sd.substring_dedup(documents(spark, rows).repartition(n)).collect()
        assert (found.doc_id, found.start, found.n_words, found.source_id, found.source_start) == (30, 80, 120, 10, 80) and found.similarity > 0.8


def test_repeats_within_the_first_document(spark):
    """The first document holds a passage's minima elsewhere before it holds the passage."""
    rng = random.Random(23)
    prose = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(90)
    edited = passage.copy()
    edited[45] = "other"
    phrases = [w for k in range(0, 85, 3) for w in passage[k : k + 7] + prose(50)]
    rows = [(1, " ".join(phrases + passage + prose(40))), (2, " ".join(prose(30) + edited + prose(30)))]
    assert [(r.doc_id, r.start, r.n_words, r.source_id, r.source_start) for r in sd.substring_dedup(documents(spark, rows)).collect()] == [(2, 30, 90, 1, len(phrases))]


def test_edited_passages_against_brute_force(spark):
    """300 documents that hold versions of passages, or parts of them: every later text of an alike pair is found."""
    rng = random.Random(43)
    prose = lambda n: [f"b{rng.randrange(10**6)}" for _ in range(n)]
    passages, rows, versions = [prose(110) for _ in range(60)], [], []
    for i in range(300):
        k = rng.randrange(60)
        own = passages[k].copy()
        for e in rng.sample(range(110), rng.choice([0, 1, 1, 2])):
            own[e] = prose(1)[0]
        own = own[:40] + prose(40) + own[70:] if rng.random() < 0.25 else own
        rows.append((i, " ".join(prose(60) + own + prose(60))))
        versions.append((k, {tuple(own[j : j + 5]) for j in range(len(own) - 4)}))
    alike = {b for b in range(300) if any(versions[a][0] == versions[b][0] and len(versions[a][1] & versions[b][1]) >= 0.8 * len(versions[a][1] | versions[b][1]) for a in range(b))}
    for n, chunk in ((1, 1 << 18), (5, 900)):
        got = sd.substring_dedup(documents(spark, rows).repartition(n), sd.Settings(chunk=chunk)).collect()
        check_passages(rows, got)
        assert len(alike) > 120 and alike <= {r.doc_id for r in got}


def test_edited_passages_behind_partial_ones(spark):
    """Passages with edits whose first holders have only a part: the later texts of alike pairs are found."""
    rng = random.Random(31)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, alike = [], []
    for _ in range(60):
        passage, earlier = prose(90), []
        for kind in rng.choice(["pf", "pff", "fpf", "ppf", "fff", "pffp"]) + "f":
            own = passage.copy()
            for k in rng.sample(range(90), rng.choice([0, 1])):
                own[k] = prose(1)[0]
            own = own[: rng.randint(20, 45)] if kind == "p" else own
            rows.append((len(rows), " ".join(prose(60) + own + prose(60))))
            if kind == "f":
                grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
                if any(len(grams & g) >= 0.8 * len(grams | g) for g in earlier):
                    alike.append(rows[-1][0])
                earlier.append(grams)
    for chunk in (600, 1 << 18):
        got = sd.substring_dedup(documents(spark, rows).repartition(5), sd.Settings(chunk=chunk)).collect()
        found = {r.doc_id for r in got if r.n_words >= 50}
        assert len(alike) > 60 and set(alike) <= found, (chunk, set(alike) - found)


def test_a_long_text_in_pieces_and_a_doc_id_with_two_texts(spark):
    rng = random.Random(41)
    prose = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    passages = [prose(60) for _ in range(40)]
    long = [w for p in passages for w in prose(rng.randint(100, 500)) + p]
    rows = [(0, " ".join(long))] + [(1 + k, " ".join(prose(30) + p + prose(30))) for k, p in enumerate(passages)]
    got = sd.substring_dedup(documents(spark, rows), sd.Settings(chunk=1000)).collect()
    check_passages(rows, got)
    assert {r.doc_id for r in got} == set(range(1, 41))
    twice = [(7, " ".join(prose(30) + passages[0])), (7, " ".join(passages[1] + prose(30))), (2, " ".join(passages[0] + prose(9))), (3, " ".join(passages[1] + prose(9)))]
    runs = [sd.substring_dedup(documents(spark, t)).collect() for t in (twice, twice[::-1])]
    assert len(runs[0]) == 1 and sorted(runs[0]) == sorted(runs[1])


def test_a_verbatim_passage_beside_a_longer_one():
    rng = np.random.default_rng(5)
    prose = lambda n: rng.integers(0, 1 << 60, n, dtype=np.uint64)
    one, two, odd = prose(60), prose(60), prose(300)
    a = np.concatenate([one, prose(40), odd[100:150], two])
    b = np.concatenate([one, prose(40), two, prose(30), odd[:154], prose(40), odd[146:]])
    found = sd.common_passages(a, b, sd.Settings())
    assert any(s <= 0 and s + n >= 60 for s, n, *_ in found) and any(s <= 150 and s + n >= 210 for s, n, *_ in found)


def test_table(spark):
    check_passages(pairs(spark.read.parquet(f"{SF}/documents.parquet")), op10_substring_dedup(spark, SF).collect())


def test_awkward_rows(spark):
    df = awkward(spark)
    check_passages(pairs(df), sd.substring_dedup(df).collect())
    assert sd.substring_dedup(spark.createDataFrame([], DOCUMENTS)).count() == 0
