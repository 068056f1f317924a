import hashlib
import random
import re
import zlib

import pytest

from aidlake.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, `a.name` string, segment string"


def brute(rows, again):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    if again:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[: h[c]] + v[h[c] :] for c, v in convs.items()}
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    out = []
    for k, members in nodes.items():
        under, todo = [], [k]
        while todo:
            under.append(x := todo.pop())
            todo += kids.get(x, [])
        saved = sum((len(nodes[x]) - 1) * words(x[-1][1]) for x in under if x)
        ended = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), sum(x not in kids for x in under), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, longest, kinds):
    r, rows = random.Random(seed), []
    for c in range(-n // 3, n):
        for t in range(r.randint(1, longest)):
            text = r.choice(kinds)
            rows.append((c, t, r.choice(["user", "bot"]) if t % 2 else None, text, 1, "x", None))
    r.shuffle(rows)
    return rows


ODD = [(None, 0, "user", "no id", 1, "x", None), (5000, None, None, None, None, None, None), (5000, 3, "a", "tie", 1, "x", None), (5000, 3, "a", "tie", 1, "x", None), (5000, 3, "b", "tie", 1, "x", None), (5000, 3, "a", "other\x0btie", 1, "x", None), (5001, 0, "", "", 1, "", ""), (5002, 0, "u", "w " * 40_000, 1, "x", None)]


@pytest.mark.parametrize("again", [False, True])
def test_against_the_plain_trie(spark, again):
    rows = made(1, 90, 6, ["a b", "c", "", "d e f"]) + ODD
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), again=again)) == brute(rows, again)


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    """Paths over many blocks, of which one is the beginning of another, and copies beyond a block."""
    monkeypatch.setattr(pt, "BLOCK", 4)
    rows = made(2, 30, 14, ["a", "b b"])
    for c, n in ((400, 41), (401, 41), (402, 40), (403, 8), (404, 4), (405, 12), (406, 43)):
        rows += [(c, t, "u", "a" if t < 20 or c % 2 else "b b", 1, "x", None) for t in range(n)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_copies_and_a_hot_first_turn(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 50)  # ids of a node in many pieces
    rows = [(c, t, "u", ["hello", "same", "end"][t] if c % 3 or t < 1 else f"{c} {t}", 1, "x", None) for c in range(600) for t in range(3)]
    assert got(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows, False)


def test_empty(spark):
    for rows in ([], [(None, 1, "a", "b", 1, "c", "d")]):
        assert pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), again=True).collect() == []


def test_only_some_prefixes_are_points(spark):
    """Copies of two long conversations that part once: five points, whatever their length."""
    rows = [(c, t, "u", str(t if t < 100 or c % 2 else -t), 1, "x", None) for c in range(40) for t in range(200)]
    t = pt.turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    cut = pt.blocks(pt.as_they_are(t))
    distinct = cut.selectExpr("*", "1L as n_end", "conv as c_end").dropDuplicates(["root", "seq"]).drop("conv", "last")
    edges = pt.compressed(pt.ordered(distinct)).collect()
    assert sorted((e.top, len(e.words)) for e in edges) == [(-1, 1), (0, 100), (100, 100), (100, 100)]
