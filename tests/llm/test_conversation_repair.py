import hashlib
import random
import re
import zlib
from itertools import product

import pytest

import __spark_entry__
from plumbline.llm import op12_conversation_repair as op12

SCHEMA = "conv_id long, turn long, role string, text string, gone string, place int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [] if how == 0 else [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        own = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append(3 if not own else 2 if (role, text) in seen else 1 if own[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def every_way(rows, found):
    """(cost, labels, turns) of each way to edit a short conversation."""
    free = [("u", "user"), ("a", "assistant")]
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (_, _, role, text), fault in zip(rows, found):
        more = 5 if fault == 1 else 0
        own = [(2, "D", [])]
        if fault < 2:
            own += [(more, "K", [(role, text)])] + [(1 + more, "R", [(r, text)]) for _, r in free]
        choices.append(own)
    for picked in product(*choices):
        for gap in product(gaps, repeat=len(rows) + 1):
            turns = [(r, "") for r in gap[0]]
            labels, cost = "I" * len(gap[0]), 5 * sum(map(len, gap))
            for (c, label, own), then in zip(picked, gap[1:]):
                turns += own + [(r, "") for r in then]
                labels, cost = labels + label + "I" * len(then), cost + c
            if GRAMMAR.fullmatch("".join(r[:1] for r, _ in turns)):
                yield cost, labels, turns


def by_suffix(rows, found):
    """The same for longer ones: the least (cost, labels, turns) from each place, state and number of insertions on."""
    nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = {}
    for at in range(len(rows), -1, -1):
        for inserted in (2, 1, 0):
            for q in range(4):
                ways = [(0, "", ())] if at == len(rows) and q in (0, 3) else []
                if inserted < 2:
                    for role in ("user", "assistant"):
                        if (q, role[0]) in nexts and (w := after.get((at, nexts[q, role[0]], inserted + 1))):
                            ways.append((5 + w[0], "I" + w[1], ((role, ""), *w[2])))
                if at < len(rows):
                    _, _, role, text = rows[at]
                    w = after[at + 1, q, 0]
                    ways.append((2 + w[0], "D" + w[1], w[2]))
                    for label, cost, own in [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")] if found[at] < 2 else []:
                        if (q, own[:1]) in nexts:
                            w = after[at + 1, nexts[q, own[:1]], 0]
                            ways.append((cost + 5 * (found[at] == 1) + w[0], label + w[1], ((own, text), *w[2])))
                if ways:
                    after[at, q, inserted] = min(ways)
    return after[0, 0, 0]


def expected(rows, search):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(own)
        cost, labels, turns = search(own, found)
        known = [t for _, t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, found.count(3), found.count(2), found.count(1), illegal, cost, labels, digest))
    return sorted(out, key=str)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "Yes.", "No", "Why?\x0b", "é!", "Wait… ", "x\x1c"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, turn + 3, -turn]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"w{rng.randrange(99)}."))
    rng.shuffle(rows)
    return rows


def result(spark, rows):
    class Reader:
        parquet = staticmethod(lambda path: spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3))

    class Session:
        read = Reader

    return sorted(map(tuple, op12.op12_conversation_repair(Session, "").collect()), key=str)


def test_equals_all_ways(spark):
    rows = [r for r in conversations(1, 40, 2)]
    assert result(spark, rows) == expected(rows, lambda own, found: min(every_way(own, found)))


@pytest.mark.parametrize("seed", [2, 3])
def test_equals_search_by_suffix(spark, seed):
    rows = conversations(seed, 60, 12) + [(99, t, "assistant", f"w{t % 50}.") for t in range(300)] + [(98, -(1 << 63), "user", "a."), (98, (1 << 63) - 1, "user", "b.")]
    want = [(*w[:1], w[1] if w[1] < 1 << 63 else None, *w[2:]) for w in expected(rows, by_suffix)]
    assert result(spark, rows) == sorted(want, key=str)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_ranks_instead_of_strings():
    """Each place's ranks order the label strings that lead on from its states."""
    rng = random.Random(4)
    for _ in range(200):
        rows = bytearray(op12.code(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(9)))
        own = [(0, 0, {"s": "system", "u": "user", "a": "assistant", "-": "x"}["sua-"[c >> 2]], "t") for c in rows]
        assert op12.shortest(rows) == by_suffix(own, [c & 3 for c in rows])[:2]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = __spark_entry__.queries()["op12_conversation_repair"](spark, sf)
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows, by_suffix)


def test_repaired_turns(spark):
    rows = op12.marked(op12.damaged(spark.createDataFrame([(1, 0, "assistant", "Hm."), (1, 1, "user", "Why?"), (1, 3, "assistant", "So."), (1, 4, "assistant", "So.")], "conv_id long, turn long, role string, text string")).withColumn("gone", op12.F.lit(False)))
    turns = op12.repaired(rows, op12.repairs(rows)).collect()
    assert [t["role"][0] for t in turns] == ["u", "a"] * (len(turns) // 2)
    assert [t["place"] for t in turns] == list(range(1, len(turns) + 1))
