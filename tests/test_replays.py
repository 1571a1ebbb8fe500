import random
import uuid
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.operators import block_diff, crawl, index
from plumbline.session import scratch
from plumbline.streaming import ticks


def crawled(links, seeds, failed, refused, max_urls, max_depth):
    """The crawl by a queue: url, depth, outcome, number of the page."""
    queue, seen, out, pages = deque(), set(), [], 0

    def put(url, depth):
        if url not in seen:
            seen.add(url)
            queue.append((url, depth))

    for url, _ in sorted(seeds, key=lambda s: (s[1], s[0])):
        put(url, 0)
    while queue:
        if pages >= max_urls:
            out += [(u, d, "url_cap", None) for u, d in queue]
            break
        url, depth = queue.popleft()
        if depth > max_depth:
            out.append((url, depth, "max_depth", None))
        elif url in refused:
            out.append((url, depth, "robots_disallow", None))
        elif url in failed:
            out.append((url, depth, "failed", None))
        else:
            out.append((url, depth, "page", pages))
            pages += 1
            for _, target in sorted((n, t) for s, t, n in links if s == url):
                put(target, depth + 1)
    return sorted(out)


@pytest.mark.parametrize("seed,max_urls,max_depth", [(1, 15, 4), (2, 1000, 2), (3, 1, 3), (4, 40, 5), (5, 0, 2)])
def test_bounded_crawl(spark, seed, max_urls, max_depth):
    rng = random.Random(seed)
    names = [f"u{k:03d}" for k in range(90)]
    links = [(s, t, n) for s in names for n, t in enumerate(rng.sample(names, rng.randint(0, 4)))]
    links += [(names[0], names[3], 9), (names[0], names[3], 0), (None, "x", 1), ("x", None, 1)]
    seeds, failed, refused = [(names[5], 2), (names[0], 1), (names[5], 3), (names[9], 2)], rng.sample(names, 12), rng.sample(names, 9)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = crawl.bounded(frame(links, "source string, target string, nth int"), frame(seeds, "url string, nth int"), frame([(u,) for u in failed], "url string"), frame([(u,) for u in refused], "url string"), max_urls, max_depth)
    want = crawled([x for x in links if None not in x], seeds, set(failed), set(refused), max_urls, max_depth)
    assert sorted((r["url"], r["depth"], r["outcome"], r["page"]) for r in got.collect()) == want


def patience(one, two, i=0, j=0):
    """Matches (place in one, place in two), by recursion."""
    out, a, b = [], list(one), list(two)
    while a and b and a[0] == b[0]:
        out.append((i, j))
        a, b, i, j = a[1:], b[1:], i + 1, j + 1
    while a and b and a[-1] == b[-1]:
        out.append((i + len(a) - 1, j + len(b) - 1))
        a, b = a[:-1], b[:-1]
    both = [(k, b.index(x)) for k, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    anchors = [both[k] for k in block_diff.longest_run([y for _, y in both])]
    if not anchors:
        return out
    p = q = 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += patience(a[p:x], b[q:y], i + p, j + q)
        if x < len(a):
            out.append((i + x, j + y))
        p, q = x + 1, y + 1
    return out


def versions(seed):
    rng = random.Random(seed)
    pairs = {}
    for pair in range(12):
        one = [rng.choice("abcdefghijklmnopqrstuvwxyz" if pair % 2 else "abcd") for _ in range(rng.randint(0, 18))]
        two = list(one)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(two))
            two[at : at + rng.randint(0, 3)] = rng.choices("abcxyz", k=rng.randint(0, 2))
        if rng.random() < 0.4:
            at = rng.randint(0, len(two))
            two = two[at:] + two[:at]
        pairs[pair] = (one, two)
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_equals_recursion(spark, seed):
    pairs = versions(seed)
    rows = [(pair, side, k, x) for pair, sides in pairs.items() for side, own in enumerate(sides) for k, x in enumerate(own)]
    got = block_diff.aligned(spark.createDataFrame(rows, "pair int, side int, place int, hash string").repartition(3)).collect()
    assert sorted((r["pair"], r["one"], r["two"]) for r in got) == sorted((pair, i, j) for pair, (one, two) in pairs.items() for i, j in patience(one, two))


def test_a_step_deals_blocks_out_once(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "a")], "pair int, side int, place long, hash string")
    matches = spark.createDataFrame([(1, 5, 5)], "pair int, one long, two long")
    for step in (lambda rest: block_diff._ends(rest, "first"), block_diff._unique):
        plan = step(block_diff._stretched(blocks, matches))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


def test_longest_run():
    rng = random.Random(1)
    for _ in range(200):
        own = rng.sample(range(30), rng.randint(0, 12))
        best = [1] * len(own)
        for k in range(len(own)):
            best[k] = 1 + max([best[m] for m in range(k) if own[m] < own[k]], default=0)
        found = block_diff.longest_run(own)
        assert len(found) == max(best, default=0) and found == sorted(found)
        assert [own[k] for k in found] == sorted(own[k] for k in found)


def test_units(spark):
    def blocks(side, *texts):
        return [(1, side, k, t, 2 * k + 1, 2 * k + 2, t[0].upper() if t else None) for k, t in enumerate(texts)]

    rows = blocks(0, "intro", "old one", "same", "gone") + blocks(1, "intro", "new one", "", "same", "tail", "more")
    got = block_diff.units(spark.createDataFrame(rows, "pair int, side int, place int, text string, first int, last int, label string")).collect()
    assert sorted((r["kind"], r["label"], r["first"], r["last"], r["before"], r["after"]) for r in got) == [("changed", "N", 3, 6, "old one", "new one\n"), ("changed", "T", 9, 12, "gone", "tail\nmore")]
    one = blocks(0, "a", "b") + blocks(1, "a", "x", "b") + [(2, *r[1:]) for r in blocks(0, "a", "b", "c") + blocks(1, "a", "c")] + [(3, *r[1:]) for r in blocks(0, "a") + blocks(1, "a")]
    got = block_diff.units(spark.createDataFrame(one, "pair int, side int, place int, text string, first int, last int, label string")).collect()
    assert sorted((r["pair"], r["kind"], r["label"], r["first"], r["before"], r["after"]) for r in got) == [(1, "added", "X", 3, "", "x"), (2, "removed", "B", None, "b", "")]


START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def fired(rows):
    return sorted((r["schedule_id"], r["slot"], r["fired_at"].timestamp()) for r in rows.collect())


def test_a_batch_run_twice_enqueues_once(spark):
    log = scratch(spark, "slots")
    spark.createDataFrame([], ticks._SLOT).drop("batch").write.parquet(f"{log}/batch=-1")
    schedules = spark.createDataFrame([(1, START, 3600, True), (2, START + timedelta(minutes=30), 7200, True), (3, START, 60, False), (4, START, 0, True), (5, None, 60, True), (6, START + timedelta(seconds=10), 7, True)], "schedule_id long, start timestamp, every int, enabled boolean")
    moments = [[-5, 0, 5, 20, 3599], [3600, 9000, 3601, None], [7000, 12, 100000]]
    batches = [spark.createDataFrame([(None if s is None else START + timedelta(seconds=s),) for s in own], "at timestamp") for own in moments]
    want, have = [], set()
    for own in moments:
        for key, start, every in ((1, 0, 3600), (2, 1800, 7200), (6, 10, 7)):
            due = {}
            for s in own:
                if s is not None and s >= start:
                    due.setdefault((key, (s - start) // every), []).append(s)
            want += [(*k, (START + timedelta(seconds=min(v))).timestamp()) for k, v in due.items() if k not in have]
            have |= set(due)
    for number, batch in enumerate(batches):
        ticks.enqueue(batch, number, schedules, log)
        ticks.enqueue(batch, number, schedules, log)
    ticks.enqueue(batches[1], 1, schedules, log)
    assert fired(ticks.enqueued(spark, log)) == sorted(want)


def test_point_ids(spark):
    keys = ["7:3:src/a.py:function:f:1", "", "é ü", None]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", index.point_id(F.col("key")).alias("id")).collect()
    assert {r["key"]: r["id"] for r in rows} == {k: None if k is None else str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys}
