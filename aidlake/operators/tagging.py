"""Help requests in posts by a linear-chain conditional random field: places, needs and numbers of people in context."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("other", "place", "need", "people")
WORD = re.compile(r"\d+|\w+|[^\w\s]")
#: Made-up posts that the model learns from, passes over them, step of a pass and pull towards zero.
POSTS, PASSES, STEP, PENALTY = 400, 60, 0.5, 1e-3

#: Sentences of made-up posts: {p} a place, {n} a need, {k} a number of people. This library's own.
PATTERNS = (
    "We are trapped near {p} , {k} people , need {n} !", "Please send {n} to {p} , {k} of us here", "{k} persons without {n} at {p}", "Help ! {p} needs {n} and {n}",
    "No {n} left in {p} since 3 days , {k} children", "My family of {k} waits for {n} around {p} .", "Road 7 is closed , call 112", "The weather in {p} is fine today", "Thanks to all helpers , 2 trucks came",
)
NEEDS = ("water", "food", "shelter", "medicine", "blankets", "rescue", "baby milk", "clean water", "warm clothes")


def words(text: str) -> list[str]:
    return WORD.findall(text)


def features(ws: list[str], i: int) -> list[str]:
    """A word's shape, ending and neighbours; rare words are known by what stands about them."""
    w = ws[i]
    near = lambda k: ws[i + k].lower() if 0 <= i + k < len(ws) else "<end>"
    shape = "number" if w.isdigit() else "capital" if w[:1].isupper() else "small" if w.isalpha() else "sign"
    return [f"w:{w.lower()}", f"shape:{shape}", f"-1:{near(-1)}", f"+1:{near(1)}", f"-2:{near(-2)}", f"shape-1:{shape}:{near(-1)}", f"shape+1:{shape}:{near(1)}"]


def made_post(r: random.Random) -> tuple[list[str], list[int]]:
    """A made-up post: its words and their tags."""
    name = lambda: " ".join("".join(r.choice("ba de ki lo mu ra si te vo".split()) for _ in range(r.randint(1, 3))).capitalize() for _ in range(r.randint(1, 2)))
    ws, tags = [], []
    for part in r.choice(PATTERNS).split(" "):
        said, tag = {"{p}": (name(), 1), "{n}": (r.choice(NEEDS), 2), "{k}": (str(r.randint(2, 900)), 3)}.get(part, (part, 0))
        own = words(said)
        ws += own
        tags += [tag] * len(own)
    return ws, tags


#: Posts that a task tags.
TASK = 10_000


class Field:
    """Weights of each feature for each tag, and of each tag after each other."""

    def __init__(self, number: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.number, self.emit, self.move = number, emit, move

    def scores(self, ws: list[str]) -> np.ndarray:
        at = [[self.number[f] for f in features(ws, i) if f in self.number] for i in range(len(ws))]
        return np.array([self.emit[a].sum(0) for a in at]).reshape(len(ws), len(TAGS))

    def decode(self, ws: list[str]) -> list[int]:
        """Viterbi: the likeliest tags together."""
        if not ws:
            return []
        s = self.scores(ws)
        best, back = s[0], []
        for row in s[1:]:
            every = best[:, None] + self.move
            back.append(every.argmax(0))
            best = every.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@lru_cache(1)
def trained(seed: int = 5) -> Field:
    """A field learnt from made-up posts by the gradient of their likelihood, from forward and backward sums."""
    r = random.Random(seed)
    posts = [made_post(r) for _ in range(POSTS)]
    number: dict[str, int] = {}
    known = [[[number.setdefault(f, len(number)) for f in features(ws, i)] for i in range(len(ws))] for ws, _ in posts]
    k = len(TAGS)
    field = Field(number, np.zeros((len(number), k)), np.zeros((k, k)))
    for _ in range(PASSES):
        g_emit, g_move = PENALTY * field.emit, PENALTY * field.move
        for at, (_, tags) in zip(known, posts, strict=True):
            s = np.array([field.emit[a].sum(0) for a in at])
            fwd, bwd = [s[0]], [np.zeros(k)]
            for row in s[1:]:
                fwd.append(log_sum(fwd[-1][:, None] + field.move, 0) + row)
            for row in s[:0:-1]:
                bwd.append(log_sum(field.move + row + bwd[-1], 1))
            bwd.reverse()
            z = log_sum(fwd[-1], 0)
            for i, a in enumerate(at):
                p = np.exp(fwd[i] + bwd[i] - z)
                p[tags[i]] -= 1
                np.add.at(g_emit, a, p / POSTS)
                if i:
                    pair = np.exp(fwd[i - 1][:, None] + field.move + s[i] + bwd[i] - z)
                    pair[tags[i - 1], tags[i]] -= 1
                    g_move += pair / POSTS
        field.emit -= STEP * 8 * g_emit
        field.move -= STEP * g_move
    return field


def spans(field: Field, text: str | None) -> dict[str, list[str]]:
    """Runs of words with one tag, in order."""
    ws = words(text or "")
    out: dict[str, list[str]] = {t: [] for t in TAGS[1:]}
    last = 0
    for w, tag in zip(ws, field.decode(ws), strict=True):
        if tag:
            if tag == last:
                out[TAGS[tag]][-1] += f" {w}"
            else:
                out[TAGS[tag]].append(w)
        last = tag
    return out


def help_spans(posts: DataFrame, text_col: str = "text") -> DataFrame:
    """posts with places, needs and people (arrays of strings) found by the field; a null text has none of them.

    The field is learnt once on the driver from made-up posts, a bounded number; it is a few hundred weights. Posts are
    dealt out to tasks of about TASK, as a small file may hold very many of them.
    """
    field = trained()
    posts = posts.repartition(max(1, -(-posts.count() // TASK)))
    number, emit, move = field.number, field.emit, field.move

    @F.pandas_udf("places array<string>, needs array<string>, people array<string>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Field(number, emit, move)
        for texts in batches:
            got = [spans(own, t) for t in texts]
            yield pd.DataFrame({"places": [g["place"] for g in got], "needs": [g["need"] for g in got], "people": [g["people"] for g in got]})

    rows = posts.withColumn("_found", tagged(F.col(text_col)))
    return rows.select(*posts.columns, "_found.places", "_found.needs", "_found.people")
