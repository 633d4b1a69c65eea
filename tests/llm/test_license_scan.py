import random
import re

import pytest
from tests.llm.fixtures import DOCUMENTS, LONG, awkward, documents

from strandplan.llm import license_scan as lic
from strandplan.llm.queries import op12_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def base(text):
    own = words(text)
    at = [(i, label) for phrase, label in lic.PHRASES for i in range(len(own)) if own[i : i + len(p := phrase.split())] == p]
    starts = [i for i, _ in at]
    return len(own), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(text, settings):
    """Labels of notices to which a run of whole words is near enough."""
    own, out = words(text), set()
    for notice, label in settings.notices:
        edits = settings.edits(notice)
        for i in range(len(own)):
            run = ""
            for j in range(i, len(own)):
                run = f"{run} {own[j]}".strip()
                if len(run) > len(notice) + edits:
                    break
                if len(run) >= len(notice) - edits and distance(run, notice) <= edits:
                    out.add(label)
    return out


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_of_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert row(r) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.score == (1 if r.n_base else r.score) and 0 <= r.score <= 1 and bool(r.score) == bool(r.labels)


@pytest.mark.parametrize("seed", range(4))
def test_notices_match_brute_force(spark, seed):
    rng = random.Random(seed)
    at = lic.Settings(notices=(("released under the mit license", "mit"), ("licensed under cc by nc 4 0", "nc"), ("this is free software for all of us", "free")))
    letters = "abcdefgilmnrstu "
    docs = []
    for i in range(120):
        notice = list(rng.choice(at.notices)[0])
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(notice))
            how = rng.randrange(3)
            notice[p : p + (how != 1)] = [] if how == 0 else [rng.choice(letters)]
        around = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(2)]
        docs.append((i, f"{around[0]} {''.join(notice)} {around[1]}"))
    labels = {r.doc_id: set(filter(None, r.labels.split(","))) for r in lic.license_scan(documents(spark, docs), lic.Settings((), at.notices)).collect()}
    want = {i: near(t, at) for i, t in docs}
    assert labels == want and any(want.values()) and not all(want.values())


def test_spans_edits_and_overlaps(spark):
    text = "É! Realeased UNDER the\nMIT-Licence; CC by CC  BY cc. Licensed under the Apache License, Version 2.0"
    (r,) = lic.scan(documents(spark, [(1, text)])).collect()
    found = {(p.label, p.exact, p.edits, p.first_word, p.found) for p in r.places}
    assert found == {
        ("mit", False, 2, 1, "Realeased UNDER the\nMIT-Licence"), ("cc-by", True, 0, 6, "CC by"), ("cc-by", True, 0, 8, "CC  BY"),
        ("apache", True, 0, 14, "Apache License"), ("apache-2", False, 0, 11, "Licensed under the Apache License, Version 2.0"),
    }
    assert all(text[p.start : p.end] == p.found and p.last_word - p.first_word == len(words(p.found)) - 1 for p in r.places)
    (d,) = lic.license_scan(documents(spark, [(1, text)])).collect()
    assert row(d) == base(text) and d.labels == "apache,apache-2,cc-by,mit" and d.score == 1
    (d,) = lic.license_scan(documents(spark, [(1, "realeased under the mit licence")])).collect()
    assert d.n_base == 0 and d.labels == "mit" and d.score == pytest.approx(1 - 2 / 30)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = lic.license_scan(df).collect()
    assert sorted(map(str, (((r.doc_id,) + row(r)) for r in rows))) == sorted(map(str, (((r.doc_id,) + base(r.text)) for r in df.collect())))
    assert lic.license_scan(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_very_long_texts_with_many_places(spark):
    text = f"{LONG} " + "cc by mit license cc by " * 5000 + "gnu general publik license " * 2000
    (r,) = lic.license_scan(documents(spark, [(1, text)])).collect()
    assert row(r) == base(text) and r.n_base == 15_000
