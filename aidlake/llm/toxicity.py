"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, by_name, carried

#: Rows of each table of embeddings, sizes of an embedding and of a direction's state.
WORDS, GRAMS, DIM, STATE = 1 << 15, 1 << 15, 12, 8
#: Words of a window, words between two windows.
WINDOW, STRIDE = 32, 24
#: Labelled rows of each class that training may use, the longest text among them, windows of a gradient step, and
#: steps in all: few rows are passed over more often.
POSITIVES, NEGATIVES, LONGEST, BATCH, STEPS = 1_500, 2_000, 100_000, 128, 387
#: Windows scored at once, words gathered for that, and words embedded at once.
CHUNK, GATHER, EMBEDDED = 2_048, 400_000, 16_384

EDGE = b".,;:!?|\"'()[]{}<>*#"


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Vocabulary:
    """Words of a batch: numbers in order of appearance, then word rows and rows of their byte 4-grams."""

    def __init__(self):
        self.number = Numbers()

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word, rows of all 4-grams, where each word's 4-grams begin)."""
        words = [w.strip(EDGE) or w for w in self.number]
        row = (WordHashes(most=len(words) + 1).of(words) % np.uint64(WORDS)).astype(np.int64)
        buf = np.frombuffer(b"".join(b"\x01\x01" + w + b"\x02\x02" for w in words), np.uint8).astype(np.uint32)
        n = np.fromiter(map(len, words), np.int64, len(words)) + 4
        ends = np.cumsum(n)
        code = buf[:-3] * 16_777_619 ^ buf[1:-2] * 805_459_861 ^ buf[2:-1] * 3_674_653_429 ^ buf[3:] * 2_654_435_761
        code = (code ^ code >> np.uint32(15)) * np.uint32(2_246_822_519)
        code ^= code >> np.uint32(13)
        inside = np.ones(len(code), bool)
        for j in (3, 2, 1):
            cut = ends - j
            inside[cut[cut < len(code)]] = False
        starts = np.concatenate([[0], np.cumsum(n - 3)[:-1]])
        return row, (code[inside] % GRAMS).astype(np.int64), starts


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def window_words(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of each window's words, -1 beyond a text; document of each window)."""
    out, owner = [], []
    for d, w in enumerate(docs):
        if len(w) < WINDOW:
            out.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1)[None])
        else:
            out.append(w[windows(len(w))[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(out[-1]), d))
    return np.concatenate(out), np.concatenate(owner)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embeddings -> GRU in both directions -> attention pooling -> logit; float32 throughout."""

    def __init__(self, seed: int = 0):
        r, f = np.random.default_rng(seed), np.float32
        self.p = {
            "word": np.zeros((WORDS, DIM), f), "gram": r.normal(0, 0.05, (GRAMS, DIM)).astype(f), "wx": r.normal(0, 0.3, (2 * DIM, 6 * STATE)).astype(f), "bx": np.zeros(6 * STATE, f),
            "uf": r.normal(0, 0.3, (STATE, 3 * STATE)).astype(f), "ub": r.normal(0, 0.3, (STATE, 3 * STATE)).astype(f), "att": r.normal(0, 0.3, 2 * STATE).astype(f), "out": r.normal(0, 0.5, 2 * STATE).astype(f), "b": np.full(1, -2.0, f),
        }

    def embed(self, row, grams, starts, drop=None):
        """(embeddings of words, their 4-gram embeddings' max over a word)."""
        g = self.p["gram"][grams]
        chars = np.maximum.reduceat(g, starts)
        word = self.p["word"][row]
        return np.concatenate([word if drop is None else word * drop[:, None], chars], 1), g, chars

    def gru(self, x, live, u, keep=None):
        """States after each step of x (time, windows, 3 * STATE); live: 1 where there is a word."""
        h, out = np.zeros((x.shape[1], STATE), np.float32), np.empty((*x.shape[:2], STATE), np.float32)
        for t in range(len(x)):
            a = h @ u
            zr = sigmoid(x[t, :, : 2 * STATE] + a[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(x[t, :, 2 * STATE :] + r * a[:, 2 * STATE :])
            new = n + z * (h - n)
            if live is not None:
                new = np.where(live[t][:, None], new, h)
            if keep is not None:
                keep.append((h, z, r, n, a[:, 2 * STATE :]))
            h = out[t] = new
        return out

    def logits(self, proj: np.ndarray, idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit for each window idx (windows, time) of word numbers; proj: projected inputs of the words."""
        x, live = proj[idx.T], idx.T >= 0
        mask = None if live.all() else live
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self.gru(x[:, :, : 3 * STATE], mask, self.p["uf"], kf)
        hb = self.gru(x[::-1, :, 3 * STATE :], None if mask is None else mask[::-1], self.p["ub"], kb)[::-1]
        h = np.concatenate([hf, hb], 2)
        e = h @ self.p["att"]
        if mask is not None:
            e = np.where(live, e, -1e9)
        a = np.exp(e - e.max(0))
        if mask is not None:
            a *= live
        a /= np.maximum(a.sum(0), 1e-9)
        c = np.einsum("tn,tnk->nk", a, h)
        if keep is not None:
            keep |= {"x": x, "live": live, "kf": kf, "kb": kb, "h": h, "a": a, "c": c}
        return c @ self.p["out"] + self.p["b"][0]

    def project(self, row, grams, starts) -> np.ndarray:
        """Projected inputs of words, some at a time: the 4-grams' embeddings of all would be the largest array by far."""
        out = np.empty((len(row), 6 * STATE), self.p["bx"].dtype)
        ends = np.append(starts[1:], len(grams))
        for a in range(0, len(row), EMBEDDED):
            b = min(a + EMBEDDED, len(row))
            out[a:b] = self.embed(row[a:b], grams[starts[a] : ends[b - 1]], starts[a:b] - starts[a])[0] @ self.p["wx"] + self.p["bx"]
        return out

    def step(self, vocab, idx, y, weight, adam, rng):
        """A gradient step of the weighted logistic loss on windows."""
        p, S = self.p, STATE
        used, inv = np.unique(np.maximum(idx, 0), return_inverse=True)
        inv = np.where(idx >= 0, inv.reshape(idx.shape), -1)
        row, grams, starts, count = vocab
        own = np.repeat(starts[used], count[used]) + np.arange(count[used].sum()) - np.repeat(np.cumsum(count[used]) - count[used], count[used])
        g_rows, g_starts = grams[own], np.cumsum(count[used]) - count[used]
        drop = (rng.random(len(used)) > 0.3).astype(np.float32)
        emb, g, chars = self.embed(row[used], g_rows, g_starts, drop)
        proj = emb @ p["wx"] + p["bx"]
        k: dict = {}
        logit = self.logits(proj, inv, k)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        grad = {"b": d.sum(keepdims=True), "out": k["c"].T @ d}
        dc = d[:, None] * p["out"]
        da = np.einsum("nk,tnk->tn", dc, k["h"])
        de = k["a"] * (da - (k["a"] * da).sum(0))
        dh = k["a"][:, :, None] * dc[None] + de[:, :, None] * p["att"]
        grad["att"] = np.einsum("tn,tnk->k", de, k["h"])
        dx = np.zeros_like(k["x"])
        for name, kept, lo, order in (("uf", k["kf"], 0, range(len(dh))), ("ub", k["kb"], S, range(len(dh) - 1, -1, -1))):
            u, du, back = p[name], np.zeros_like(p[name]), np.zeros_like(dh[0, :, :S])
            for t, (h, z, r, n, q) in reversed(list(zip(order, kept, strict=True))):
                full = back + dh[t, :, lo : lo + S]
                live = k["live"][t][:, None]
                cur = full * live
                dn = cur * (1 - z) * (1 - n * n)
                dz, dr = cur * (h - n) * z * (1 - z), dn * q * r * (1 - r)
                dx[t, :, 3 * lo : 3 * lo + 3 * S] = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                du += h.T @ dg
                back = cur * z + full * ~live + dg @ u.T
            grad[name] = du
        flat, to = dx[k["live"]], inv.T[k["live"]]
        order = np.argsort(to, kind="stable")
        heads = np.flatnonzero(np.diff(to[order], prepend=-1))
        dproj = np.zeros_like(proj)
        dproj[to[order][heads]] = np.add.reduceat(flat[order], heads)
        grad["wx"], grad["bx"] = emb.T @ dproj, dproj.sum(0)
        demb = dproj @ p["wx"].T
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], row[used], demb[:, :DIM] * drop[:, None])
        top = (g == np.repeat(chars, count[used], 0)) * np.repeat(demb[:, DIM:], count[used], 0)
        grad["gram"] = np.zeros_like(p["gram"])
        np.add.at(grad["gram"], g_rows, top)
        grad["word"] += 1e-5 * p["word"]
        adam["t"] += 1
        for n, x in grad.items():
            m, v = adam.setdefault(n, (np.zeros_like(p[n]), np.zeros_like(p[n])))
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            p[n] -= adam["rate"] * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(v / (1 - 0.999 ** adam["t"])) + 1e-8)


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """The score of each text: the sigmoid of its windows' largest logit."""
    out, at = np.empty(len(texts)), 0
    while at < len(texts):
        vocab, docs, words = Vocabulary(), [], 0
        while at + len(docs) < len(texts) and words < GATHER:
            docs.append(vocab.of(texts[at + len(docs)]))
            words += len(docs[-1])
        if not vocab.number:
            vocab.of(b"-")
        proj = net.project(*vocab.rows())
        best = np.full(len(docs), -np.inf)
        lo = 0
        while lo < len(docs):  # windows are laid out for some documents at a time
            hi, n = lo, 0
            while hi < len(docs) and (hi == lo or n < 64 * CHUNK):
                n += len(docs[hi])
                hi += 1
            idx, owner = window_words(docs[lo:hi])
            whole = np.argsort(idx[:, -1] < 0, kind="stable")  # padded ones together
            for a in range(0, len(idx), CHUNK):
                part = whole[a : a + CHUNK]
                np.maximum.at(best, owner[part] + lo, net.logits(proj, idx[part]))
            lo = hi
        out[at : at + len(docs)] = 1 / (1 + np.exp(-best))
        at += len(docs)
    return out


def train(texts: list[bytes], labels: list[int], negative_weight: float, seed: int = 0) -> Network:
    """A network from labelled texts, by multiple instances: a text is as toxic as its worst window.

    The first windows are picked by the log-odds of their words' 4-grams; then each pass takes the worst window of
    each text by the network itself, and a random one of each clean text. Reruns agree.
    """
    net, rng, vocab = Network(seed), np.random.default_rng(seed), Vocabulary()
    docs = [vocab.of(t) for t in texts]
    y = np.array(labels)
    if len(y) == 0:
        return net
    if not vocab.number:
        vocab.of(b"-")
    row, grams, starts = vocab.rows()
    count = np.diff(np.append(starts, len(grams)))
    idx, owner = window_words(docs)
    seen = np.zeros((2, GRAMS))
    for d, w in enumerate(docs):
        used = np.unique(w)
        own = np.concatenate([grams[starts[i] : starts[i] + count[i]] for i in used]) if len(used) else []
        seen[y[d], np.unique(own).astype(np.int64)] += 1
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    word_odds = np.append(np.maximum.reduceat(odds[grams], starts), -np.inf)
    first = np.maximum(word_odds[idx].max(1), -1e9)
    order = np.lexsort((first, owner))
    ends = np.flatnonzero(np.diff(owner[order], append=-1))  # each document's worst window
    begins = np.concatenate([[0], ends[:-1] + 1])
    adam, n_clean = {"t": 0, "rate": 0.01}, int((y == 0).sum())
    weight = np.where(y == 1, 1.0, negative_weight)
    full = (row, grams, starts, count)
    passes = -(-STEPS // -(-(len(y) + n_clean) // BATCH))
    for epoch in range(passes):
        if epoch:
            proj = net.project(row, grams, starts)
            now = np.concatenate([net.logits(proj, idx[a : a + CHUNK]) for a in range(0, len(idx), CHUNK)])
            order = np.lexsort((now, owner))
        worst = order[ends]
        clean = np.flatnonzero(y == 0)
        other = order[begins[clean] + (rng.random(len(clean)) * (ends - begins + 1)[clean]).astype(int)]
        pick, of = np.concatenate([worst, other]), np.concatenate([np.arange(len(y)), clean])
        adam["rate"] = 0.01 if epoch < passes * 2 // 3 else 0.003
        mix = rng.permutation(len(pick))
        for a in range(0, len(mix), BATCH):
            b = mix[a : a + BATCH]
            net.step(full, idx[pick[b]], y[of[b]].astype(np.float32), weight[of[b]].astype(np.float32), adam, rng)
    return net


def fold(id_col: str, n: int):
    """crc32(id as text) mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Network:
    """A network fitted on labelled rows: `positives` and `negatives` of them at most, in the order of a hash.

    Their number is bounded by these parameters and their texts by LONGEST characters, so one task can hold them and
    train; the driver gets the weights, whose size is fixed. Clean rows are weighted so that the classes count as they
    occur. Rows with a null id, label or text teach nothing. Without both labels the network stays untrained.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    ids = None
    for y, most in ((1, positives), (0, negatives)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    text = docs.where(F.length(by_name(text_col)) <= LONGEST).select(by_name(id_col).alias("id"), by_name(text_col).cast("binary").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["t"], r["y"]) for b in batches for r in b.to_pylist())
        got = [sum(r[2] == y for r in rows) for y in (0, 1)]
        if all(got):
            net = train([r[1] for r in rows], [r[2] for r in rows], (n[0] / n[1]) / (got[0] / got[1]))
            out = io.BytesIO()
            np.savez(out, **net.p)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], ["weights"])

    found = text.join(F.broadcast(ids), "id").repartition(1).mapInArrow(work, "weights binary").first()  # ids: bounded above
    net = Network()
    if found:
        with np.load(io.BytesIO(found["weights"])) as weights:
            net.p = dict(weights)
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with score (double) in place of any such column: every whole text by all its overlapping windows.

    A null text scores as an empty one: a window without words, whose score is the output's bias. Rows are scored
    one by one, so ties and repeats score alike; an empty table stays empty; other columns are passed on, whatever
    their names.
    """
    row, back = carried(docs, {"score"})
    model = docs.sparkSession.sparkContext.broadcast(net.p)  # its size is fixed by WORDS, GRAMS, DIM and STATE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = model.value
        for b in batches:
            texts = b.column(1)
            got = np.concatenate([scores(own, [t or b"" for t in texts.slice(lo, 512).to_pylist()]) for lo in range(0, b.num_rows, 512)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], ["row", "score"])

    rows = docs.select(row, by_name(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(work, T.StructType([rows.schema["row"]]).add("score", "double")).select(*back, "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = fitted(docs, labels.where(fold("doc_id", 5) != 0))
    slim = docs.select("doc_id", "text")
    kept = score(slim, net)
    return kept.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
