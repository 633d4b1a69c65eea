import random

from tests.llm.fixtures import DOCUMENTS, awkward, documents

from strandplan.llm import decontaminate as dc
from strandplan.llm.queries import op3_benchmark_decontamination

SF = "/root/testdata/sf0.001"


def infix_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def patterns(item, at):
    text = dc.normalise(item)
    if len(text) <= at.window:
        return [text] if text else []
    return [text[s : s + at.window] for s in sorted({*range(0, len(text) - at.window, at.stride), len(text) - at.window})]


def budget(pattern, at):
    return min(int(len(pattern) * at.rate), max(len(pattern) // at.q - 1, 0)) if len(pattern) >= at.q else 0


def brute(text, items, at):
    text = dc.normalise(text or "")
    return {i: m for i, t in items if (m := min((d for p in patterns(t, at) if (d := infix_distance(p, text)) <= budget(p, at)), default=None)) is not None}


def altered(rng, text, edits):
    chars = list(text)
    for _ in range(min(edits, len(chars) // 2)):
        k = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(k, rng.choice("abcxyz ")), lambda: chars.pop(k), lambda: chars.insert(k, rng.choice("abcxyz "))])()
    return "".join(chars)


def test_find_against_brute_force():
    rng, at = random.Random(7), dc.Settings(q=5, window=60, stride=30, part_chars=300)
    words = ["alpha", "be", "gamma", "de", "to", "the", "iota", "k"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(1, 30))) for i in range(25)] + [(90, "abc"), (91, ""), (92, "  ")]
    index = dc.PatternIndex(items, at)
    texts = ["", "alpha", prose(300)]
    for _, t in items:
        texts += [f"{prose(rng.randint(0, 40))} {altered(rng, t, rng.randint(0, 8)) if t else ''} {prose(rng.randint(0, 40))}".upper() for _ in range(4)]
    got = [{h["item_id"]: h["edits"] for h in hits} for hits in dc.find(texts, index)]
    assert got == [brute(t, items, at) for t in texts]


def test_table_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, dc.normalise(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op3_benchmark_decontamination(spark, SF).collect()}
    assert {(d, i) for d, text in docs for i, t in items if dc.normalise(t) in text} <= got
    shown = {d: text for d, text in docs}
    whole = {i: t for i, t in items}
    at = dc.Settings()
    assert all(any(infix_distance(p, shown[d]) <= budget(p, at) for p in patterns(whole[i], at)) for d, i in got)


def test_awkward_rows_and_blocks(spark):
    df = awkward(spark).union(awkward(spark).limit(0))
    items = spark.createDataFrame([(1, "the cat sat on the mat today"), (None, "x"), (2, None), (3, ""), (4, "only here, without an id"), (5, "a")], "item_id long, text string")
    for block_chars in (10, 10**6):
        at = dc.Settings(block_chars=block_chars)
        got = sorted(str((r.doc_id, r.item_id)) for r in dc.leaks(df, items, at).collect() if r.item_id != 5)
        assert got == sorted(str(x) for x in [(0, 1), (1, 1), (None, 4)])
        kept = dc.drop_leaks(df, items, at)
        assert kept.columns == df.columns
        assert all("a" not in (r.text or "").lower() for r in kept.collect()) and any(r.text is None for r in kept.collect())


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    df = spark.createDataFrame([], DOCUMENTS)
    assert dc.leaks(df, items).count() == 0 and dc.drop_leaks(df, items).count() == 0
    df = documents(spark, [(1, "x"), (2, None)])
    assert dc.leaks(df, items.limit(0)).count() == 0 and dc.drop_leaks(df, items.limit(0)).count() == 2
