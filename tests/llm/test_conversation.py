"""Conversation repair against a brute force that reads from right to left with whole audits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from agewise.llm import conversation_audit as ca

BLACK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """Rows (conv, turn, role, text) after damage, a list a conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            mine += [row] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        black = BLACK.findall(text)
        faults.append("b" if not black else "d" if (role, text) in seen else "t" if black[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]

    @lru_cache(None)
    def best(i, state, free=2):  # state: what was read last ("" s u a)
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            cost = int(faults[i] == "t")
            steps = [("D", 3, state)]
            if faults[i] not in ("b", "d"):
                follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                steps += [("K", cost, initials[i])] * (initials[i] != "" and initials[i] in follow)
                steps += [("R", 2 + cost, x) for x in follow if x != "s"]
            for edit, c, to in steps:
                rest = best(i + 1, to)
                found += [(rest[0] + c, edit + rest[1])] * (rest is not None)
        if free:  # at most two inserts in a row are ever of use
            to = "a" if state == "u" else "u"
            rest = best(i, to, free - 1)
            found += [(rest[0] + 2, "I" + rest[1])] * (rest is not None)
        return min((x for x in found), default=(10 ** 9, "~"))

    cost, audit = best(0, "")
    lines, state, i = [], "", 0
    for e in audit:
        if e in "KR":
            state = initials[i] if e == "K" else "a" if state == "u" else "u"
            lines.append(f"{rows[i][1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{rows[i][2]}")
        if e == "I":
            state = "a" if state == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[state])
        i += e != "I"
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, most):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        size = rng.randrange(1, most)
        for t in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Usher", None])
            text = rng.choice(["Yes.", "No", "", " \t", None, "So it goes!", f"t{rng.randrange(9)}?", "é ", "end. \n"])
            turn = None if rng.random() < .05 else t + rng.randrange(3) * rng.randrange(2)
            rows += [(None if conv == 7 else conv, turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment,held,most", [(512, 1 << 15, 12), (3, 20, 25)])
def test_repair_equals_brute_force(spark, segment, held, most):
    """Also where conversations are divided into segments of three rows and over many tasks."""
    rows = conversations(segment, 150, most)
    rows += [(900, t, ["user", "assistant"][t % 2], f"A{t}.") for t in range(40)] + [(901, 5, "user", "again.")] * 30
    src = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as copies", "3 as kind", "4 as h")
    out = {r.conv: tuple(r)[1:] for r in ca.repaired(ca.damaged(src), segment, held).collect()}
    want = {ca.NULL_ID if c is None else c: expected(x) for c, x in damage(rows).items()}
    assert out.keys() == want.keys()
    for c, x in want.items():
        assert out[c] == x, (c, out[c], x)


def test_empty_table_and_dropped_conversations(spark):
    assert ca.repaired(ca.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    conv = next(c for c in range(99) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = ca.repaired(ca.damaged(spark.createDataFrame([(conv, 0, "user", "Hello.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in ca.op11_conversation_repair(spark, folder).collect()}
    assert got == {c: expected(x) for c, x in damage(rows).items()}


def test_equal_hashes_are_verified():
    """With hashes that say nothing the order of audits is still right."""
    rng = np.random.default_rng(5)
    a = ca.Audits(12, 64)
    nodes, names = [np.zeros(1, np.int64)], [b""]
    for _ in range(300):
        i, e = int(rng.integers(len(nodes))), int(rng.integers(65, 67))
        if len(names[i]) < 12:
            nodes.append(a.add(nodes[i], e))
            names.append(names[i] + bytes([e]))
    a.hash[:] = 0
    chain = ca.Chain()
    for _ in range(400):
        i, j = rng.integers(len(nodes), size=2)
        x, y = rng.integers(65, 67, size=2)
        less = a.less(nodes[i], np.array([x]), nodes[j], np.array([y]))[0]
        p, q = names[i] + bytes([x]), names[j] + bytes([y])
        assert less == (p < q)
        u, v = (chain.add(chain.add(0, s[:3]), s[3:]) for s in (p, q))
        assert chain.less(u, v) == (p < q)
        chain.hash = [0] * len(chain.hash)
