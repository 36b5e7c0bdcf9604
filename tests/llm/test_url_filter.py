"""URL lists in time against a walk through the changes."""

import datetime
import random

import pytest

from breezeway.llm import url_filter as uf

T0 = datetime.datetime(2024, 1, 1)


def table(seed=1):
    rng = random.Random(seed)
    hosts = ["a.example.com", "b.example.com", "c.d.example.org", "hot.example.net"]
    day = lambda: T0 + datetime.timedelta(hours=rng.randrange(24 * 200))
    patterns = [*hosts, "example.com", "d.example.org", "hot.example.net/x/1", "other.net"]
    changes = [(rng.choice(patterns), day(), rng.random() < 0.6) for _ in range(120)]
    changes += [(None, T0, True), ("a.example.com", None, True), ("a.example.com", T0, None), changes[0], changes[0]]
    captures = [(i, f"https://{'hot.example.net' if i % 3 else rng.choice(hosts)}/x/{i % 4}?q=1#f", day()) for i in range(300)]
    captures += [(1, None, T0), (2, "not a url", T0), (3, "http://a.example.com", None), (None, "HTTP://User@A.Example.com.:80/", T0),
                 captures[0], captures[0]]
    return captures, changes


def brute(captures, changes):
    def state(pattern, at):
        on, since = False, None
        for t in sorted({c[1] for c in changes if c[0] == pattern and c[1] is not None}):
            if t > at:
                break
            kinds = [c[2] for c in changes if c[:2] == (pattern, t) and c[2] is not None]
            if kinds and max(kinds) != on:
                on, since = max(kinds), t
        return since if on else None

    out = []
    for key, url, at in captures:
        host, patterns = None, []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
            path = ("/" + rest.split("/", 1)[1].split("?")[0].split("#")[0]).rstrip("/") if "/" in rest else ""
            labels = host.split(".")
            patterns = list(dict.fromkeys([host + path, *[".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))]]))
        hits = [(p, state(p, at)) for p in patterns if at is not None and state(p, at)]
        out.append((key, host, at, bool(hits), len(hits), *(hits[0] if hits else (None, None))))
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [100_000, 0])
def test_every_capture_as_of_its_fetch(spark, monkeypatch, rows):
    monkeypatch.setattr(uf, "BROADCAST_ROWS", rows)
    captures, changes = table()
    got = uf.active_entries(spark.createDataFrame(captures, "key long, url string, at timestamp").repartition(4),
                            spark.createDataFrame(changes, "pattern string, at timestamp, added boolean"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(captures, changes)


def test_empty_list_and_no_captures(spark):
    captures, changes = table()
    none = spark.createDataFrame([], "pattern string, at timestamp, added boolean")
    some = spark.createDataFrame(captures, "key long, url string, at timestamp")
    assert not any(r.blocked for r in uf.active_entries(some, none).collect())
    listed = spark.createDataFrame(changes, "pattern string, at timestamp, added boolean")
    assert uf.active_entries(some.limit(0), listed).collect() == []


def test_addresses_are_hosts_without_parents(spark):
    """An IPv6 address is a whole host, and neither kind of address has parent domains."""
    urls = ["http://[2001:db8::1]/a", "http://[2001:db8::2]:80/b", "http://u@[::ffff:1.2.3.4]/", "http://10.1.2.3/x/", "http://9.1.2.3:8/x",
            "http://1.2.3.4.example.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "key int, url string")
    got = {r.key: (r.host, r.keys) for r in df.select("key", uf.host(df.url).alias("host"), uf.lookup_keys(df.url).alias("keys")).collect()}
    assert got[0] == ("[2001:db8::1]", ["[2001:db8::1]/a", "[2001:db8::1]"])
    assert got[1] == ("[2001:db8::2]", ["[2001:db8::2]/b", "[2001:db8::2]"])
    assert got[2] == ("[::ffff:1.2.3.4]", ["[::ffff:1.2.3.4]"])
    assert got[3] == ("10.1.2.3", ["10.1.2.3/x", "10.1.2.3"]) and got[4][1] == ["9.1.2.3/x", "9.1.2.3"]
    assert "example.com" in got[5][1] and "2.3.4.example.com" in got[5][1]
    listed = spark.createDataFrame([("[2001:db8::1]", T0, True), ("2.3", T0, True), ("10.1.2.3", T0, True)],
                                   "pattern string, at timestamp, added boolean")
    rows = uf.active_entries(df.withColumn("at", uf.F.lit(T0)), listed).collect()
    assert {r.key for r in rows if r.blocked} == {0, 3}


@pytest.mark.parametrize("hot", [0, 5, 10_000])
def test_a_long_list_is_not_broadcast_however_small_its_files_are(spark, monkeypatch, hot):
    """Only the entries of hot hosts are, the others are merged; the rows are the same."""
    monkeypatch.setattr(uf, "BROADCAST_ROWS", 40)
    monkeypatch.setattr(uf, "HOT_ROWS", hot)
    captures, changes = table(3)
    got = uf.active_entries(spark.createDataFrame(captures, "key long, url string, at timestamp").repartition(4),
                            spark.createDataFrame(changes, "pattern string, at timestamp, added boolean"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert "strategy=merge" in joins[0] and all("strategy=" in x for x in joins)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(captures, changes)


def test_a_list_of_long_patterns_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(uf, "BROADCAST_BYTES", 100)
    captures, changes = table(4)
    got = uf.active_entries(spark.createDataFrame(captures, "key long, url string, at timestamp"),
                            spark.createDataFrame(changes, "pattern string, at timestamp, added boolean"))
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(captures, changes)
