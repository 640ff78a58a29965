"""Operators without SQL: properties, and brute force on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lectern import streaming
from lectern.functions import move, natural_key, rank_between, slug
from lectern.operators import asof, ngrams, progress

NOW = 1_700_000_000_000


def test_rank_between_keeps_order_for_a_thousand_inserts():
    random.seed(1)
    keys = [rank_between(None, None)]
    for _ in range(1000):
        at = random.randint(0, len(keys))
        made = rank_between(keys[at - 1] if at else None, keys[at] if at < len(keys) else None)
        keys.insert(at, made)
        assert not made.endswith("0")
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    with pytest.raises(ValueError):
        rank_between("b", "a")


def test_slug_and_natural_order():
    assert slug("Émile: the  Book!") == "Emile the Book" and slug("") == "Untitled" and len(slug("x" * 100)) == 60
    assert sorted(["ch 10", "Ch 2", "ch 1"], key=natural_key) == ["ch 1", "Ch 2", "ch 10"]


def test_longest_increasing_against_quadratic():
    random.seed(2)
    for _ in range(200):
        v = [random.randint(0, 30) for _ in range(random.randint(0, 40))]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        got = ngrams.longest_increasing(v)
        assert len(got) == max(best, default=0)
        assert all(v[a] < v[b] and a < b for a, b in zip(got, got[1:]))


def test_unique_matches_against_brute_force(spark):
    random.seed(3)
    make = lambda: "".join(random.choice("ab ") for _ in range(60))
    a, b = [(i, make()) for i in range(3)], [(i, make()) for i in range(4)]
    n = 6

    def once(rows):
        seen = {}
        for k, t in rows:
            t = t.replace(" ", "")
            for p in range(len(t) - n + 1):
                seen.setdefault(t[p : p + n], []).append((k, p))
        return {g: v[0] for g, v in seen.items() if len(v) == 1}

    x, y = once(a), once(b)
    want = {(x[g][0], y[g][0], x[g][1], y[g][1]) for g in x.keys() & y.keys()}
    got = ngrams.unique_matches(spark.createDataFrame(a, "k long, text string"), spark.createDataFrame(b, "k long, text string"), "k", "k", "text", n)
    assert {tuple(r) for r in got.collect()} == want


def test_asof_and_interval_joins_against_brute_force(spark):
    random.seed(4)
    points = [(random.randint(0, 2), t) for t in random.sample(range(400), 60)]
    spans = [(random.randint(0, 2), s, s + random.randint(1, 90)) for s in random.sample(range(400), 30)]
    p, s = spark.createDataFrame(points, "k long, t long"), spark.createDataFrame(spans, "k long, lo long, hi long")
    before = {(k, t): max((lo for q, lo, _ in spans if q == k and lo <= t), default=None) for k, t in points}
    assert {(r.k, r.t): r.lo for r in asof.asof(p, s, ["k"], "t", "lo", ["lo"]).collect()} == before
    after = {(k, t): min((lo for q, lo, _ in spans if q == k and lo > t), default=None) for k, t in points}
    assert {(r.k, r.t): r.lo for r in asof.asof(p, s, ["k"], "t", "lo", ["lo"], forward=True).collect()} == after
    inside = sorted((k, t, lo) for k, t in points for q, lo, hi in spans if q == k and lo < t < hi)
    joined = asof.interval_join(p, s, ["k"], "t", "lo", "hi", 40)
    assert sorted((r.k, r.t, r.lo) for r in joined.collect()) == inside
    assert "NestedLoop" not in joined._jdf.queryExecution().toString()


def events(n=120):
    random.seed(5)
    kinds = ["heartbeat", "open", "seek", "finish", "pause"]
    rows = []
    for i in range(n):
        rows.append((i % 2, i % 3, i, random.randint(0, 2), random.randint(0, 40), random.choice(kinds), NOW + random.randint(-9, 900) * 1000, None if random.random() < 0.7 else random.randint(0, 9), random.random()))
    return rows


SCHEMA = "user_id long, book_id long, event_id long, session long, seq long, intent string, at_ms long, base_revision long, pct double"


def test_reconciliation_rules():
    s = progress.State(4, NOW, 1, 7, "seek", False, 0.5)
    ask = lambda *a: progress.verdict(s, *a, NOW)
    assert ask("heartbeat", NOW, 2, 99, None) == "unclaimed-session"
    assert ask("heartbeat", NOW, 1, 7, None) == "stale-heartbeat"
    assert ask("heartbeat", NOW, 1, 8, None) == "apply"
    assert ask("seek", NOW - 5, 2, 1, None) == "stale-explicit"
    assert ask("seek", NOW - 5, 2, 1, 4) == "apply"
    assert ask("seek", NOW, 1, 8, None) == "apply" and ask("seek", NOW, 2, 8, None) == "stale-explicit"
    far = progress.advance(progress.State(), "open", NOW + 10**12, 3, 1, 0.1, NOW)
    assert far.claim_ms == NOW + progress.FUTURE_SKEW_MS


def test_stream_of_progress_equals_batch(spark, tmp_path):
    more = [(u, (b + 1) % 3, e, *rest) for u, b, e, *rest in events() if e % 9 == 0]  # the same ids for another book
    late = [r for r in events() if r[2] % 11 == 0]  # and again, batches later
    rows = spark.createDataFrame(events() + more, SCHEMA)
    want = {(r.event_id, r.book_id): (r.outcome, r.revision) for r in progress.reconcile(rows, NOW).collect()}
    assert sum(o == "duplicate" for o, _ in want.values()) == len(more)
    parts = [rows.filter(f"event_id >= {k * 40} and event_id < {k * 40 + 40}") for k in range(3)] + [spark.createDataFrame(late, SCHEMA)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.progress_stream(stream, NOW).writeStream.format("memory").queryName("outcomes").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select * from outcomes").collect()
    again = [r for r in got if r.outcome == "duplicate"]
    assert len(got) == rows.count() + len(late) and len(again) == len(more) + len(late)
    assert {(r.event_id, r.book_id): (r.outcome, r.revision) for r in got if r.outcome != "duplicate"} == {k: v for k, v in want.items() if v[0] != "duplicate"}


def test_move_changes_one_rank():
    random.seed(6)
    ranks = [rank_between(None, None)]
    for _ in range(30):
        ranks.append(rank_between(ranks[-1], None))
    for _ in range(200):
        at, to = random.randrange(len(ranks)), random.randrange(len(ranks))
        made = move(ranks, at, to)
        ranks = ranks[:at] + ranks[at + 1 :]
        ranks.insert(to, made)
        assert ranks == sorted(ranks) and len(set(ranks)) == len(ranks)


def test_deduplicated_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, NOW), (1, 7, NOW), (2, 7, NOW), (1, 8, NOW)], "user_id long, event_id long, ms long").selectExpr("user_id", "event_id", "timestamp_millis(ms) as ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = streaming.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("once").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user_id, r.event_id) for r in spark.sql("select * from once").collect()) == [(1, 7), (1, 8), (2, 7)]


def test_monotone_filter(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5000), (1, 1, 2000, 2500), (1, 2, 4000, 9000), (1, 3, 20000, 21000)], "k long, ord long, s long, e long")
    assert sorted(r.ord for r in ngrams.monotone_filter(rows, "k", "ord", "s", "e").collect()) == [0, 2, 3]


def test_sessions_and_windows_run_on_batches_too(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert streaming.sessions(rows).count() > 0
    assert streaming.per_window(rows).agg(F.sum("n")).first()[0] == rows.count()
