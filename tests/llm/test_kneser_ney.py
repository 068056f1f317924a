import math
import random
import re
from collections import Counter, defaultdict

import pytest

from aidlake.llm import kneser_ney as kn

SCHEMA = "doc_id long, text string, score string, n_tokens int"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]


class Brute:
    """The textbook formulas over dictionaries."""

    def __init__(self, texts, n):
        self.n, self.raw, top = n, Counter(), Counter()
        for t in texts:
            w = split(t)
            self.raw.update(w)
            p = ["<s>"] * (n - 1) + w
            top.update(tuple(p[i : i + n]) for i in range(len(w)))
        self.c = {n: top}
        for k in range(n - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.x = {}, {}
        for k, c in self.c.items():
            m = Counter(c.values())
            n1, n2, n3, n4 = (m[i] for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else 0
            self.d[k] = [0, *([min(max(a - (a + 1) * y * b / e, 0), a) for a, e, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))] if y else (0.5, 1.0, 1.5))]
            self.x[k] = defaultdict(lambda: [0, 0.0])
            for g, v in c.items():
                self.x[k][g[:-1]][0] += v
                self.x[k][g[:-1]][1] += self.d[k][min(v, 3)]

    def p(self, g):
        if not g:
            return 1 / (len(self.raw) + 1)
        low, x = self.p(g[1:]), self.x[len(g)].get(g[:-1])
        if not x:
            return low
        v = self.c[len(g)][g]
        return max(v - self.d[len(g)][min(v, 3)], 0) / x[0] + x[1] / x[0] * low

    def score(self, t):
        w = split(t)
        p, N, V = ["<s>"] * (self.n - 1) + w, sum(self.raw.values()), len(self.raw)
        base = sum(math.log10((self.raw[x] + 0.1) / (N + 0.1 * (V + 1))) for x in w)
        return len(w), sum(self.raw[x] > 0 for x in w), N, base, sum(math.log10(self.p(tuple(p[i : i + self.n]))) for i in range(len(w)))


@pytest.mark.parametrize("order,most", [(2, 2_000_000), (2, 37), (3, 50), (3, 10_000), (4, 400)])
def test_against_textbook(spark, monkeypatch, order, most):
    monkeypatch.setattr(kn, "COUNTED", most)
    monkeypatch.setattr(kn, "SCORED", most)
    r = random.Random(order)
    vocab = [f"W{int(r.paretovariate(0.7))}" for _ in range(300)]
    texts = [" ".join(r.choices(vocab, k=r.randrange(40))) for _ in range(60)] + ["a b\x1cc A B", "", None, "a a a a a", "a a a a a"]
    train, test = texts[10:], texts + ["never seen words", "a never a b"]
    b, df = Brute(train, order), spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(train)], SCHEMA)
    model = kn.fit(df, order=order)
    got = kn.score(spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(test)], SCHEMA), model).collect()
    assert len(got) == len(test)
    for g in got:
        want = b.score(test[g.doc_id])
        assert (g.n_tokens, g.n_known, g.train_tokens) == want[:3]
        assert g.base_score == pytest.approx(want[3], rel=1e-9) and g.score == pytest.approx(want[4], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "b c a", "c c b a b"]
    model = kn.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    b = Brute(texts, 2)
    for before in ("a", "b", "c", "zzz"):
        assert sum(b.p((before, w)) for w in b.raw) + b.p((before, "?")) == pytest.approx(1)
    assert model.train_tokens == 16 and model.distinct == 4


def test_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kn.fit(empty)
    got = kn.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)
    assert kn.score(empty, model).collect() == []


def test_held_out_text_is_likelier_than_by_single_words(spark):
    r = random.Random(9)
    chain = {i: [r.randrange(50) for _ in range(3)] for i in range(50)}

    def text():
        w, out = r.randrange(50), []
        for _ in range(60):
            out.append(f"w{w}")
            w = r.choice(chain[w])
        return " ".join(out)

    model = kn.fit(spark.createDataFrame([(text(),) for _ in range(120)], "text string"))
    got = kn.score(spark.createDataFrame([(text(),) for _ in range(20)], "text string"), model).collect()
    assert sum(g.score for g in got) > 0.5 * sum(g.base_score for g in got)


def test_query_scores_trigrams(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdef", k=r.randrange(1, 30))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = kn.query(spark, str(tmp_path)).collect()
    b = Brute([texts[g.doc_id] for g in got if not g.held_out], 3)
    assert len(got) == 60 and all(g.score == pytest.approx(b.score(texts[g.doc_id])[4], rel=1e-9) for g in got)


def test_counts_beyond_32_bits(spark):
    word, big = kn.np.array([7], kn.np.uint64), 2**32 + 5
    rows = kn.key_parts("raw", 1, kn.mixed(word), [kn.np.array([big], kn.np.uint64)], 1)
    folder = kn.scratch(spark, "big-counts")
    kn.stage(spark.createDataFrame(rows, kn.PART_DDL), "words", 0, folder, 1, 2, []).collect()
    model = kn.Model(folder, 2, 1, [], {("raw", 1)}, {})
    assert model.lookup("raw", 1, kn.mixed(word), None)[0].tolist() == [big]


def test_hot_cores_are_found_and_split(spark):
    r = random.Random(3)
    texts = [" ".join(w for _ in range(40) for w in ("the", f"w{r.randrange(200)}")) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    the = kn.np.uint64(kn.xxhash.xxh64_intdigest(b"the", 0)) >> kn.LESS << kn.LESS
    assert the in kn.hot_cores(df, 3, 4)[3] and len(kn.hot_cores(df, 4, 4)[4]) == 0
    model, b = kn.fit(df), Brute(texts, 3)
    assert {k for k, _ in model.have} >= {"gram", "hot-gram", "context", "hot-context", "raw"}
    got = kn.score(df, model).collect()
    assert [g.score for g in got] == pytest.approx([b.score(t)[4] for t in texts], rel=1e-9)


def test_tables_give_back_what_they_hold():
    r = kn.np.random.default_rng(0)
    for n in (1, 3, 5_000):
        h = kn.np.unique(r.integers(0, 2**64, n, dtype=kn.np.uint64))
        numbers = [r.integers(0, 3, len(h)), r.integers(0, 40, len(h)) ** 4]
        raw = b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in map(kn.np.ascontiguousarray, kn.table(h, numbers)))
        t = kn.Table(kn.np.frombuffer(raw, kn.np.uint8))
        ask = kn.np.unique(kn.np.concatenate([h, h + kn.np.uint64(1 << 50), r.integers(0, 2**64, n, dtype=kn.np.uint64)]))
        hit, got = t.find(ask)
        o = kn.np.argsort(hit)
        assert (ask[hit[o]] == h).all() and (got[o] == kn.np.stack(numbers, 1)).all()
    a = r.integers(0, 70_000, 999)
    assert (kn.decoded(kn.encoded(a)) == a).all()
    words, counts = kn.np.unique(r.integers(0, 2**48, 900, dtype=kn.np.uint64)), kn.np.arange(999)
    for k in (2, 3, 4):
        cols = [(r.random(999) ** 3 * len(words)).astype(int) for _ in range(k)]
        blobs, (n,) = kn.packed_grams(words, cols, counts)
        values, back = kn.unpacked_grams(blobs)
        at = kn.decoded(n)
        assert sorted(at.tolist()) == counts.tolist() and all((values[b] == words[c[at]]).all() for b, c in zip(back, cols))
    big = [kn.np.array([5, 5, 1 << 40, 5]), kn.np.array([2, 1, 1, 1])]  # too wide for one number a row
    for cols in (big, [x % 7 for x in big]):
        o, heads = kn.ordering(cols)
        assert [tuple(c[o[k]] for c in cols) for k in heads] == sorted(set(zip(*(c.tolist() for c in cols))))


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y", 7.0, 3)], "doc_id long, text string, _text string, `a.b` string, score double, n_tokens int")
    got = kn.score(df, kn.fit(df)).first()
    assert got["_text"] == "x" and got["a.b"] == "y" and got.n_tokens == 4 and got.score < 0


def test_tables_off_a_local_file_system(spark, monkeypatch):
    """Pages give what a map gives, to the last number, and a process keeps no more of them than it may."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[min(int(r.expovariate(0.004)), 2999)] for _ in range(200)) for _ in range(300)]
    model = kn.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    cache = kn.WordHashes()
    docs = [kn.tokens(t.encode(), cache, 3) for t in texts[:100] + ["never seen " + texts[0][::-1], ""]]
    kn.load.cache_clear()
    want = model.probabilities(docs)
    read = []

    class Store:
        """A store that has no local files."""

        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, path):
            f = self.fs.open_input_file(path)
            read.append(path)
            return f

        def open_input_stream(self, path):
            raise AssertionError("a table is read whole")

    real = kn.pafs.FileSystem.from_uri

    class Stores:
        @staticmethod
        def from_uri(uri):
            fs, path = real(uri)
            return Store(fs), path

    monkeypatch.setattr(kn.pafs, "FileSystem", Stores)
    for page, kept, run in ((64, 640, 3), (4096, 1 << 14, 64)):
        for name, v in (("PAGE", page), ("KEPT", kept), ("RUN", run), ("PAGES", kn.Pages())):
            monkeypatch.setattr(kn, name, v)
        kn.load.cache_clear()
        got = model.probabilities(docs)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        assert read and len(kn.PAGES.pages) * page <= kept and len(kn.PAGES.files) <= 64
        assert all(len(p) <= page and p.base is None for p in kn.PAGES.pages.values())
    kn.load.cache_clear()
