import random

import numpy as np

from aidlake.llm import toxicity as tox


def corpus(seed, n, bad=("blargh", "snorkwit", "gruntfu")):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "ru", "ta"]) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        words, y = [word() for _ in range(r.randint(1, 300))], int(r.random() < 0.3)
        if y:
            for _ in range(r.randint(1, 5)):
                words.insert(r.randrange(len(words) + 1), r.choice(bad) + r.choice(["", "ing", "en", "."]))
        out.append((i, " ".join(words), y))
    return out


def test_held_out_accuracy_and_new_forms(spark):
    rows, test = corpus(1, 1200), corpus(2, 200)
    net = tox.train([t.encode() for _, t, _ in rows], [y for *_, y in rows], 1.0)
    got = tox.scores(net, [t.encode() for _, t, _ in test])
    assert np.mean((got >= 0.5) == np.array([y for *_, y in test])) > 0.97
    clean = " ".join(t for _, t, y in corpus(3, 150) if not y).split()
    assert len(clean) > 10_000 and tox.scores(net, [" ".join(clean).encode()])[0] < 0.5
    clean.insert(7_777, "snorkwiting")  # deep in a long text
    assert tox.scores(net, [" ".join(clean).encode()])[0] > 0.5
    again = tox.train([t.encode() for _, t, _ in rows], [y for *_, y in rows], 1.0)
    assert (tox.scores(again, [t.encode() for _, t, _ in test]) == got).all()


def test_gradients_against_differences():
    net, rng = tox.Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    v = tox.Vocabulary()
    docs = [v.of(b"one two three four five"), v.of(b"six two one seven")]
    row, grams, starts = v.rows()
    count = np.diff(np.append(starts, len(grams)))
    idx, _ = tox.window_words(docs)
    idx = idx[:, :6]
    y, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    class Fixed:  # no dropout
        random = staticmethod(lambda n: np.ones(n))

    def loss():
        proj = net.embed(row, grams, starts)[0] @ net.p["wx"] + net.p["bx"]
        z = net.logits(proj, idx)
        return float(np.mean(weight * (np.logaddexp(0, z) - y * z)))

    got = {}

    class Adam(dict):
        def setdefault(self, name, default):
            got[name] = default[0]  # after the step a tenth of the gradient
            return default

    before = {k: x.copy() for k, x in net.p.items()}
    adam = Adam(t=0, rate=0.0)
    net.step((row, grams, starts, count), idx, y, weight, adam, Fixed)
    for name in ("uf", "ub", "att", "out", "b", "wx", "bx", "gram"):
        x, at = net.p[name], np.unravel_index(np.argmax(abs(got[name])), got[name].shape)
        old = x[at]
        x[at] = old + 1e-3
        up = loss()
        x[at] = old - 1e-3
        down = loss()
        x[at] = old
        assert abs((up - down) / 2e-3 - got[name][at] * 10) < 0.02 * abs(got[name][at] * 10), name
    assert all(np.array_equal(before[k], net.p[k]) for k in before)


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 55, 56, 57, 1000):
        w = tox.windows(n)
        seen = {i for a in w for i in range(a, min(n, a + tox.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= tox.STRIDE for a, b in zip(w, w[1:]))


def test_columns_nulls_and_empty(spark):
    rows = [(i, t, 7.0, "x") for i, t, _ in corpus(4, 30)] + [(100, None, None, None), (101, "", 1.0, "y"), (101, "", 1.0, "y"), (None, "ba", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(4, 30)] + [(None, 1), (5, None), (999, 1), (7, 3)], "doc_id long, toxic int")
    net = tox.fitted(docs, labels)
    got = tox.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert len({g.score for g in got if not g.text}) == 1
    assert tox.score(docs.limit(0), net).collect() == []
    untrained = tox.fitted(docs, labels.limit(0))
    assert all(0 <= g.score < 0.5 for g in tox.score(docs, untrained).collect())


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id long, text string, _text string, `a.b` string, row string")
    got = tox.score(df, tox.Network()).first()
    assert (got["_text"], got["a.b"], got["row"], got.text) == ("x", "y", "z", "a b") and 0 < got.score < 1


def test_scores_by_plain_loops():
    """The forward pass written out word by word, window by window."""
    r = np.random.default_rng(5)
    net = tox.Network(5)
    net.p["word"] = r.normal(0, 0.5, net.p["word"].shape).astype(np.float32)
    p, S = {k: v.astype(np.float64) for k, v in net.p.items()}, tox.STATE
    sig = lambda x: 1 / (1 + np.exp(-x))

    def inputs(word):
        own = word.strip(tox.EDGE) or word
        v = tox.Vocabulary()
        v.of(own)
        (row,), grams, _ = v.rows()
        return np.concatenate([p["word"][row], p["gram"][grams].max(0)]) @ p["wx"] + p["bx"]

    def states(xs, u):
        h, out = np.zeros(S), []
        for x in xs:
            z, g = sig(x[:S] + h @ u[:, :S]), sig(x[S : 2 * S] + h @ u[:, S : 2 * S])
            h = (1 - z) * np.tanh(x[2 * S :] + g * (h @ u[:, 2 * S :])) + z * h
            out.append(h)
        return out

    def window(words):
        if not words:
            return p["b"][0]
        xs = [inputs(w) for w in words]
        both = [np.concatenate(x) for x in zip(states([x[: 3 * S] for x in xs], p["uf"]), states([x[3 * S :] for x in xs[::-1]], p["ub"])[::-1])]
        a = np.exp([h @ p["att"] for h in both])
        return sum(w * h for w, h in zip(a / a.sum(), both)) @ p["out"] + p["b"][0]

    texts = [b"", b"one", b"Some (words) here, twelve!", " ".join(f"w{i}é" for i in range(75)).encode()]
    want = []
    for t in texts:
        words = t.lower().split()
        starts = [0] if len(words) <= tox.WINDOW else [*range(0, len(words) - tox.WINDOW, tox.STRIDE), len(words) - tox.WINDOW]
        want.append(sig(max(window(words[a : a + tox.WINDOW]) for a in starts)))
    assert np.allclose(tox.scores(net, texts), want, atol=1e-4)


def test_where_a_window_begins_does_not_matter():
    """Toxic texts moved by 1 to 23 words, so that other windows cut them, are still found, and clean ones still not."""
    rows, test = corpus(1, 1200), corpus(2, 120)
    net = tox.train([t.encode() for _, t, _ in rows], [y for *_, y in rows], 1.0)
    before = tox.scores(net, [t.encode() for _, t, _ in test]) >= 0.5
    for k in (1, 5, 11, 17, 23):
        after = tox.scores(net, [(" ".join(["bakelo"] * k) + " " + t).encode() for _, t, _ in test]) >= 0.5
        assert np.mean(before == after) > 0.97, k
