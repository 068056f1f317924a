import random
import sys
import time

import numpy as np
import pytest

import corpus_pipeline as cp
from aidlake.llm import common, pieces, simhash, toxicity
from test_toxicity import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic ones, exact and near copies, a shared line, nulls and repeats; and labels."""
    d, r = str(tmp_path_factory.mktemp("pipe")), random.Random(8)
    rows, labels = [], []
    for i, t, y in corpus(1, 500):
        words = t.split()
        text = "\n".join(" ".join(words[k : k + 15]) for k in range(0, len(words), 15))
        if i % 4 == 0:
            text += f"\nread more of item {i} on our news site today"
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        if i % 3:
            labels.append((i, 0, y))
    clean = [x for x, (_, _, y) in zip(rows, corpus(1, 500)) if not y and len(x[1].split()) > 120]
    for k in range(30):  # near copies by one changed word, and exact ones
        words = clean[k][1].split(" ")
        words[r.randrange(20, len(words))] = "changed"
        rows.append((1000 + k, " ".join(words), "en", "src1", 0))
        rows.append((2000 + k, clean[k][1], "en", "src2", 0))
    rows += [(3000, None, None, None, None), (None, "a text without an id", None, None, None), (3001, "", "en", "src0", 0), (3002, "again", "en", "src0", 5), (3002, "again", "en", "src0", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, [x[0] for x in clean]


def test_stages_one_by_one(spark, folder):
    d, rows, clean = folder
    docs, truth, seen = spark.read.parquet(f"{d}/documents.parquet"), {i: y for i, _, y in corpus(1, 500)}, []
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, docs, d), f"test-{name}")
        before, after = docs.collect(), out.collect()
        if name != "pieces":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        ids = [x.doc_id for x in after]
        if name == "toxicity":
            gone = {x.doc_id for x in before} - set(ids)
            toxic = {i for i, y in truth.items() if y}
            assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 0.03 * len(rows)
            net = toxicity.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"))
            want = toxicity.scores(net, [(x.text or "").encode() for x in before])
            assert sorted(map(str, ids)) == sorted(str(x.doc_id) for x, s in zip(before, want) if s < 0.5)
        elif name == "line_dedup":
            assert sorted(map(str, ids)) == sorted(str(x.doc_id) for x in before)
            assert sum("on our news site" in (x.text or "") for x in after) == 1 and all(x.n_chars == (None if x.text is None else len(x.text)) for x in after)
        elif name == "simhash":
            fps = {}
            for x in before:
                fps.setdefault(simhash.fingerprint((x.text or "").encode(), cp.SHINGLE), []).append(x.doc_id)
            left, groups = set(fps), 0
            while left:  # components over all pairs
                todo, groups = [left.pop()], groups + 1
                while todo:
                    f = todo.pop()
                    near = {g for g in left if (f ^ g).bit_count() <= cp.DISTANCE}
                    left -= near
                    todo += near
            assert len(after) == groups
        elif name == "mixing":
            assert {x.doc_id for x in after} <= {x.doc_id for x in before} and max(ids.count(i) for i in ids) <= 3
            words = lambda xs: sum(len((x.text or "").split()) for x in xs)
            assert abs(words(after) - words(before)) < 0.05 * words(before)
        else:
            assert sorted(str((x.doc_id, x.text)) for x in before) == sorted(str((x.doc_id, x.text)) for x in after)
            p = pieces.Pieces(open(pieces.MODEL, "rb").read())
            assert all((x.ids is None and x.text is None) or p.decode(x.ids) == x.text.encode() and x.n_tokens == len(x.ids) for x in after)
        seen.append(name)
        docs = out
    assert seen == ["toxicity", "line_dedup", "simhash", "mixing", "pieces"]


def test_run(spark, folder):
    out = cp.run(spark, folder[0])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids"] and out.count() > 100


def test_near_and_exact_copies_leave_one(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "other ")
    rows = [(5, base, "en", "a", 1), (3, near, "en", "a", 1), (9, base, "en", "b", 1), (7, "quite another text " * 30, "en", "a", 1), (None, base, None, None, None)]
    got = cp.near(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(x.doc_id for x in got) == [3, 7]


def test_repeats_that_differ_elsewhere_leave_the_same_row(spark):
    rows = [(1, "some words of a text", "en", "a", 1), (1, "some words of a text", "fr", "b", 2), (None, "more", "de", "c", 3), (None, "more", "es", "d", 4)]
    got = set()
    for order in (rows, rows[::-1]):
        for parts in (1, 3):
            got.add(tuple(sorted(map(str, cp.near(spark, spark.createDataFrame(order, DOCS).repartition(parts), "").collect()))))
    assert len(got) == 1 and len(next(iter(got))) == 2


def test_columns_with_clashing_names(spark, folder):
    d, rows, _ = folder
    names = "score n_lines n_dropped _n _hash _row _copy copies size row key ids n_tokens a.b place text_hash".split()
    docs = spark.createDataFrame([(*x, *names) for x in rows[:60]], DOCS + "".join(f", `{n}` string" for n in names))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        left = [n for n in names if name != "pieces" or n not in ("ids", "n_tokens")]
        assert name == "pieces" or out.columns == docs.columns
        docs = common.written(out, f"clash-{name}")
        got = docs.collect()
        assert got and all(x[n] == n for x in got for n in left)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).collect() == []


def test_operators_do_not_swallow_imports():
    for m in list(sys.modules):
        if m.startswith("aidlake.llm") and getattr(sys.modules[m], "__file__", None):
            assert "except ImportError" not in open(sys.modules[m].__file__).read()


def test_near_copies_by_exact_similarity(spark, monkeypatch):
    """All pairs at five-word Jaccard 0.8 are joined, however many bits differ, and no others."""
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 1 << 11)  # many blocks a bucket
    r, texts = random.Random(4), []
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(120)]
        for edits in (0, 1, 2, 3, 4):
            words = list(base)
            for p in r.sample(range(120), edits):
                words[p] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(words))
    hub = [f"h{i}" for i in range(200)]
    texts += [" ".join(w if j != i else "x" for j, w in enumerate(hub)) for i in range(0, 200, 3)] + ["a b c", "A  b c", "a b d", "", " \t"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    apart = 0
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if (len(a & sets[j]) / len(a | sets[j]) if a | sets[j] else 1.0) >= 0.8:
                apart += (fps[i] ^ fps[j]).bit_count() > cp.DISTANCE
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert apart > 20
    got = cp.near(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS), "").collect()
    assert sorted(x.doc_id for x in got) == sorted({find(i) for i in range(len(texts))})


def test_unlike_documents_with_one_passage_are_compared_once(spark):
    """300 documents share 300 words and have 60 of their own: no pair is at 0.8, each is compared once at most."""
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(300)]
    rows += [(1000 + i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(59))) for i in range(10)]  # near copies of ten
    trace, t = [], time.time()
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 8, 0.8, trace).collect()
    assert time.time() - t < 60
    assert {g.doc_id: g.component_id for g in got} == {i: i if i < 1000 else i - 1000 for i, _ in rows}
    assert 10 <= sum(trace) <= 310 * 309 // 2, trace


def test_compared_pairs_are_those_of_shared_buckets_and_unlike_roots(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 1 << 8)  # several nodes with a block of their own
    r = random.Random(3)
    sets = {n: np.unique(np.array([r.randrange(60) for _ in range(r.choice([3, 20, 40]))], np.uint64)) for n in range(40)}
    held = {b: r.sample(range(40), 15) for b in range(6)}
    members = spark.createDataFrame([(b, n) for b, ns in held.items() for n in ns], "bucket long, node long")
    table = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in sets.items()], "node long, hashes binary")
    trace = []
    got = {x.node: x.root for x in simhash.settled(members, table, 0.5, trace).collect()}
    root = {n: n for n in sets}
    pairs = {(min(a, b), max(a, b)) for ns in held.values() for a in ns for b in ns if a != b}
    for _ in sets:
        for a, b in pairs:
            if simhash.jaccard(sets[a], sets[b]) >= 0.5:
                root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in sets} == root
    assert sum(trace) <= len(pairs)
