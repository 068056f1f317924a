import random
import re
import time
from collections import defaultdict

from aidlake.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, th int, gone int"


def brute(rows, depth, min_docs, similarity, min_tokens):
    """The tree in plain Python. Templates of a leaf: any line as seed, lines that differ from it in few places with it."""
    docs, order = {}, lambda d: (d[0] is None, d[0] or 0)  # ids are distinct here but for nulls
    for i, t, *_ in rows:
        if t is not None:
            docs[i, t] = t.split("\n")
    seen = {}
    for d, ls in docs.items():
        for n, l in enumerate(ls):
            tok = l.split()
            masked = [re.sub(r"^[^\s\d]*\d\S*$", "<*>", x) for x in tok]
            if len(tok) >= 4 or any(x != "<*>" for x in masked):
                tok = masked
            if tok and len(tok) >= min_tokens:
                seen[d, n] = tuple(tok)
    leaves = defaultdict(set)
    for tok in seen.values():
        leaves[len(tok), tok[:depth]].add(tok)
    where = defaultdict(set)
    for (d, _), tok in seen.items():
        where[tok].add(d)
    first = {}
    for leaf in leaves.values():
        for seed in leaf:
            group = [t for t in leaf if sum(a != b for a, b in zip(t, seed)) <= (1 - similarity) * len(seed) + 1e-9]
            inside = set().union(*(where[t] for t in group))
            if len(inside) >= min_docs:
                for t in group:
                    first[t] = min([first.get(t, min(inside, key=order)), min(inside, key=order)], key=order)
    out = {}
    for d, ls in docs.items():
        gone = [n for n in range(len(ls)) if seen.get((d, n)) in first and first[seen[d, n]] != d]
        out[d] = ("\n".join(l for n, l in enumerate(ls) if n not in gone), len(ls), len(gone))
    return out


def test_against_brute_force(spark):
    r = random.Random(6)
    word = lambda: r.choice("alpha beta gamma delta river flood road relief rain gauge".split())
    rows = []
    for i in range(80):
        ls = [" ".join(word() for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(6))]
        if r.random() < 0.4:
            ls.append(f"Posted on 2024-01-{r.randrange(10, 30)} by {word()} in the news section of our site")
        if r.random() < 0.3:
            ls.append("All rights reserved by the owner of this page")
        if r.random() < 0.2:
            ls.append(f"Share this\twith {word()} {word()}")
        r.shuffle(ls)
        rows.append((i, "\n".join(ls), "x", 1, 2))
    rows += [(200, None, None, None, None), (201, "", None, None, None), (202, rows[3][1], "x", 1, 1), (202, rows[3][1], "x", 1, 1), (None, rows[3][1], None, None, None)]
    for kw in ({}, {"min_docs": 3, "min_tokens": 4}, {"depth": 2, "similarity": 0.7, "min_tokens": 2}):
        got = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA), **kw).collect()
        want = brute(rows, **({"depth": 3, "min_docs": 2, "similarity": 0.8, "min_tokens": 1} | kw))
        assert len(got) == len(rows)
        before = {}
        for i, t, *_ in rows:
            before.setdefault(i, t)
        for g in got:
            if before[g.doc_id] is None:
                assert (g.text, g.n_lines, g.n_dropped) == (None, 0, 0)
            else:
                assert (g.text, g.n_lines, g.n_dropped) == want[g.doc_id, before[g.doc_id]], g
        assert sum(g.n_dropped for g in got) > 20


def test_variable_fields_share_a_template(spark):
    rows = [(i, f"own text number{i} here {'abcdefgh'[i]}\nServer node{i} started at 10:0{i} with {i * 7} workers", None, None, None) for i in range(6)]
    got = {g.doc_id: g for g in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_dropped == 0 and all("Server" not in got[i].text for i in range(1, 6))


def test_a_long_line_and_empty(spark):
    long = "\n".join(["word " * 30_000] * 2 + ["x"])
    got = line_dedup.line_dedup(spark.createDataFrame([(i, long, None, None, None) for i in range(3)], SCHEMA), min_docs=3, min_tokens=4).collect()
    assert sorted(g.n_dropped for g in got) == [0, 2, 2]
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_drops_lines_of_two_documents_and_short_ones(spark, tmp_path):
    shared, short = "a passage that only these two documents have in common", "All rights reserved."
    texts = [f"own words of the first\n{shared}\n{short}\n17", f"quite another text\n{shared}\n18", f"third\n{short}\n17"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g.text for g in line_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "quite another text\n18", 2: "third"}  # other numbers alone are no common template


def test_templates_that_share_a_leaf(spark):
    """The same token count and first three tokens, other tails: each template recurs by itself."""
    names = "anna ben cleo dora emil finn gina hugo ines jack kira lena mona nora otto paul rosa sven tina ugo".split()
    rows = [(i, f"{w * 2}\nwe would like {w} to visit our shop today", None, None, None) for i, w in enumerate(names)]
    rows += [(i + 20, f"{w * 3}\nwe would like all of {w} old books now", None, None, None) for i, w in enumerate(names)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(g.n_dropped for g in got) == 38


def test_recall_of_planted_templates(spark):
    """Many templates a leaf, each with as many word fields as the similarity allows, some sharing most of their words."""
    r, rows, planted = random.Random(12), [], 0
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    common = [word(4) for _ in range(12)]
    for t in range(60):
        size = r.choice([8, 12, 20, 40])
        body = ["please", "see", "the"] + [r.choice(common) if r.random() < 0.5 else word(5) for _ in range(size - 3)]
        fields = r.sample(range(3, size), size // 5)
        for k in range(8):
            line = [word(7) if p in fields else w for p, w in enumerate(body)]
            rows.append((len(rows), " ".join(line) + "\n" + word(30), None, None, None))
        planted += 7
    got = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert 0.9 * planted <= sum(g.n_dropped for g in got) <= planted


def test_lines_of_a_bucket_that_agree_with_none_of_its_first_seeds(spark):
    """Forty pairs that meet only in buckets which all eighty lines share: a pair differs in both bands that are its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda g, c: f"{letters[g % 26]}{letters[g // 26]}{c}"
    rows = []
    for g in range(40):
        for side in "xy":
            rows.append((len(rows), f"please see the common words of {own(g, side)} then {own(g, side * 2)} {own(g, 'end')}", None, None, None))
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i % 2 for i in range(80)}


def test_very_many_lines_in_one_text(spark):
    text = "\n".join(f"line {'abcdefgh'[i % 8] * (1 + i // 8)}" for i in range(16_000))
    rows = [(0, text, None, None, None), (1, text + "\nown", None, None, None)]
    began = time.time()
    got = {g.doc_id: g for g in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == "own" and got[1].n_dropped == 16_000 and got[0].n_dropped == 0 and time.time() - began < 120


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", "z"), (2, "a b", "x", "y", "z")], "doc_id long, text string, id string, `a.b` string, row string")
    got = sorted(line_dedup.line_dedup(df).collect())
    assert [(g.text, g["id"], g["a.b"], g["row"]) for g in got] == [("a b", "x", "y", "z"), ("", "x", "y", "z")]


def test_a_token_costs_its_length(spark):
    """A very long token without a digit in a line that has digits elsewhere; any white space cuts tokens, U+00A0 is none."""
    long = "x" * 400_000
    lines = [f"{long} at 10:05", "\v a1\tb\f\r c\u00a0d2  e ", "7 8\t9", "", " \t"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    began = time.time()
    got = [r[0] for r in df.select(line_dedup.tokenized(df["line"])).collect()]
    assert got == [[long, "at", "<*>"], ["<*>", "b", "<*>", "e"], ["7", "8", "9"], [], []] and time.time() - began < 20
