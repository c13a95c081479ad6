"""Temporal list join on a small history."""

import datetime as dt
import random

from millrace.llm import op2_url_lists as op


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


ENTRIES = [
    ("spam", "bad.example.com", "add", day(10)), ("spam", "bad.example.com", "remove", day(20)), ("spam", "bad.example.com", "add", day(30)),
    ("adult", "Example.com", "add", day(15)), ("spam", "both.org", "add", day(5)), ("spam", "both.org", "remove", day(5)),
    ("spam", "gone.org", "remove", day(1)), (None, "x.org", "add", day(1)), ("spam", None, "add", day(1)), ("spam", "y.org", "add", None), ("spam", "bad.example.com", "add", day(12)),
]


def evaluate(spark, captures, entries=ENTRIES):
    a = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, key string")
    b = spark.createDataFrame(entries, "list string, key string, action string, at timestamp")
    return sorted(((r["page_id"], r["lists"], r["blocked"], r["listed_since"]) for r in op.evaluate(a, b).collect()), key=repr)


def test_as_of(spark):
    url = "http://user@Bad.Example.com:80/x"
    cases = [(1, 9, ""), (2, 10, "spam"), (3, 15, "adult,spam"), (4, 20, "adult"), (5, 30, "adult,spam")]
    got = evaluate(spark, [(i, url, day(d), "k") for i, d, _ in cases])
    assert [g[:3] for g in got] == [(i, lists, lists != "") for i, _, lists in cases]
    assert got[2][3] == day(10) and got[4][3] == day(15)


def test_edges(spark):
    rows = [(1, "http://both.org/", day(6), ""), (2, None, day(6), ""), (3, "no url", day(6), ""), (4, "http://bad.example.com", None, ""), (5, "http://gone.org./a", day(9), ""), (6, "https://notbad.example.org/", day(40), ""), (7, "http://both.org/", day(6), ""), (7, "http://both.org/", day(6), ""), (None, "http://a.example.com", day(40), "")]
    got = evaluate(spark, rows)
    assert len(got) == 9 and [g for g in got if g[2]] == [(None, "adult", True, day(15))]
    assert evaluate(spark, []) == [] and [g[2] for g in evaluate(spark, rows[:1], [])] == [False]


def test_keys(spark):
    row = spark.createDataFrame([("http://a.b.c.org/x",)], "url string").select(op.host_keys(op.host(op.F.col("url"))).alias("k")).first()
    assert row["k"] == ["a.b.c.org", "b.c.org", "c.org"]


def test_against_brute_force(spark, monkeypatch):
    """Long histories in several rows a key, captures on and between the changes, behind a shuffle, with and without broadcast."""
    rng = random.Random(3)
    keys = ["a.org", "b.a.org", "c.net"]
    entries = [(rng.choice(["x", "y"]), rng.choice(keys), rng.choice(["add", "remove"]), day(rng.randint(0, 60))) for _ in range(300)]
    captures = [(i, f"http://{rng.choice(['a.org', 'b.a.org', 'z.b.a.org', 'c.net', 'd.net'])}/", day(rng.randint(-2, 70)), "") for i in range(200)]

    def expected(url, at):
        name = url[7:-1]
        out = {}
        for which in ("x", "y"):
            for key in keys:
                if name == key or name.endswith("." + key):
                    last, since = None, None
                    for moment in sorted({e[3] for e in entries if e[:2] == (which, key) and e[3] <= at}):
                        action = max(e[2] for e in entries if e[:2] == (which, key) and e[3] == moment)
                        since = moment if action == "add" and last != "add" else since
                        last = action
                    if last == "add":
                        out[which] = min(out.get(which, since), since)
        return ",".join(sorted(out)), bool(out), min(out.values(), default=None)

    want = sorted(((i, *expected(u, t)) for i, u, t, _ in captures), key=repr)
    assert evaluate(spark, captures, entries) == want
    monkeypatch.setattr(op, "CHUNK", 4)
    monkeypatch.setattr(op, "BROADCAST", 0)
    assert evaluate(spark, captures, entries) == want


def test_very_long_url(spark):
    host = ".".join(["l" * 60] * 40) + ".bad.example.com"
    got = evaluate(spark, [(1, f"http://{host}/{'p' * 200_000}", day(11), "")])
    assert [g[1:3] for g in got] == [("spam", True)]
