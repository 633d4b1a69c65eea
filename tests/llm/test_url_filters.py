import inspect
import random
from datetime import datetime, timedelta

from strandplan.llm import url_filters as uf

START = datetime(2024, 1, 1)
RANK = {"block": 2, "allow": 1, "remove": 0}


def brute(host, at, entries):
    best = None
    if host is None or at is None:
        return None
    for name, pattern in {(n, p) for n, p, _, _ in entries if n and p}:
        past = [(d, RANK[a], a) for n, p, d, a in entries if (n, p) == (name, pattern) and d and a and d <= at]
        if past and (host == pattern.lower() or host.endswith("." + pattern.lower())):
            day = max(d for d, _, _ in past)
            action = max((r, a) for d, r, a in past if d == day)[1]
            if action != "remove":
                best = max([b for b in (best,) if b] + [((len(pattern), action == "allow", name), pattern.lower(), action, day)])
    return best and (best[0][2], *best[1:])


def test_against_brute_force(spark):
    rng = random.Random(11)
    labels = ["a", "b", "shop", "blog", "x-y"]
    names = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(40)]
    entries = [(rng.choice(["l1", "l2", "l3"]), rng.choice(names).upper(), START + timedelta(days=rng.randrange(30)), rng.choice(list(RANK))) for _ in range(150)]
    entries += [(None, "a", START, "block"), ("l1", None, START, "block"), ("l1", "a", None, "block"), ("l1", "b", START, None)]
    rows = [(i, f"https://{rng.choice(['', 'u:p@'])}{rng.choice(names).upper()}{rng.choice(['', '.', ':80'])}/{rng.choice(labels)}", START + timedelta(hours=rng.randrange(900))) for i in range(600)]
    rows += [(1000, None, START), (1001, "no url", START), (1002, "http:///x", START), (1003, f"http://{names[0]}", None), (None, "http://a", START), (5, rows[5][1], rows[5][2])]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").selectExpr("*", "url AS host", "page_id AS pattern")
    listed = spark.createDataFrame(entries, "list_name string, pattern string, day timestamp, action string")
    got = uf.verdicts(captures, listed).collect()
    assert len(got) == len(rows)
    hosts = {r.page_id: r.host for r in got}
    assert hosts[1000] is None and hosts[1001] is None and hosts[1002] is None
    for r in got:
        want = brute(r.host, r.fetched_at, entries)
        assert (r.list_name, r.pattern, r.action, r.valid_from) == (want or (None,) * 4) and r.kept == (not want or want[2] != "block")
    assert sum(not r.kept for r in got) > 50


def test_common_endings_hot_hosts_and_captures_without_one(spark):
    """A host with most captures, endings that most hosts share, entries for short patterns, and many captures without a host."""
    rng = random.Random(5)
    entries = [("l1", "com", START, "block"), ("l2", "big.com", START + timedelta(days=2), "allow"), ("l2", "big.com", START + timedelta(days=4), "remove")]
    entries += [("l1", "h3.big.com", START + timedelta(days=1), "block"), ("l3", "a.h4.big.com", START + timedelta(days=3), "allow")]
    hosts = ["big.com"] * 600 + [f"h{k}.big.com" for k in range(100)] + ["a.h4.big.com", "x.a.h4.big.com", "big.org", "com"] * 10 + [None] * 300
    rows = [(i, h and f"http://{h}/{'p' * rng.randrange(3)}", START + timedelta(hours=rng.randrange(150))) for i, h in enumerate(hosts)]
    rows += [(7, "http://" + "y." * 200 + "big.com/" + "z" * 100_000, START + timedelta(days=2))]  # more labels than a host has
    listed = spark.createDataFrame(entries, "list_name string, pattern string, day timestamp, action string")
    got = uf.verdicts(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp"), listed).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.host, r.fetched_at, entries)
        assert (r.list_name, r.pattern, r.action, r.valid_from) == (want or (None,) * 4) and r.kept == (not want or want[2] != "block")


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b", START)], "page_id long, url string, fetched_at timestamp")
    entries = uf.default_entries(spark)
    assert uf.verdicts(captures.limit(0), entries).count() == 0
    assert [r.kept for r in uf.verdicts(captures, entries.limit(0)).collect()] == [True]


def test_stays_with_dataframe_functions():
    assert not any(word in inspect.getsource(uf) for word in ("udf", "mapIn", "applyIn", ".rdd", "collect("))
