"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_name, carried

#: Labelled pages that the model is trained on, its passes and its penalty.
PAGES, PASSES, PENALTY = 1_000, 200, 0.0004

# Fixed values of the HTML standard: elements that do not break a line of text, that have no content, whose
# content is no text, and that a start tag of the same kind closes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")


@lru_cache(4096)
def names_of(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role."""
    return tuple(sorted({t for m in NAMED.finditer(attributes) for t in TOKEN.findall((m[1] or m[2] or m[3] or "").lower())}))


class Element:
    """An open element: what it adds to the features of the text inside it is worked out once, however deep it is."""

    __slots__ = ("up", "tag", "own", "new", "total")

    def __init__(self, up: Element | None, tag: str, new: tuple[str, ...]):
        self.up, self.tag, self.new, self.total = up, tag, new, None
        self.own = (f"in:{tag}", f"in:{up.tag}>{tag}" if up else f"in:{tag}")

    def path(self) -> Iterator[Element]:
        e: Element | None = self
        while e:
            yield e
            e = e.up


#: A leaf block: its text, the element about it (None at the top), characters inside links.
Block = tuple[str, Element | None, int]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order.

    A block is a run of text between tags that break lines; elements without text (RAW) and comments leave nothing.
    Unclosed and stray tags are taken as browsers take them: an end tag closes down to its start tag, if open. The
    work grows with the page's length, however deep its elements nest.
    """
    out: list[Block] = []
    stack: list[tuple[Element, tuple]] = []
    open_now: Counter = Counter()  # of tags and of the words of names
    parts: list[str] = []
    in_link, links, at = 0, 0, 0

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1][0] if stack else None, links))
            parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text)

    def push(tag: str, names: tuple) -> None:
        marks = (f"under:{tag}", *(f"name:{n}" for n in names))
        new = tuple(m for m in marks if not open_now[m])
        open_now.update(marks)
        stack.append((Element(stack[-1][0] if stack else None, tag, new), marks))

    def pop_to(size: int) -> None:
        while len(stack) > size:
            open_now.subtract(stack.pop()[1])

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag == "br":
            parts.append("\n")
            end_block()
            continue
        end_block()
        if closing:
            if open_now[f"under:{tag}"]:
                i = len(stack) - 1
                while stack[i][0].tag != tag:
                    i -= 1
                pop_to(i)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if tag in BLOCKS_END_P and stack and stack[-1][0].tag == "p":
            pop_to(len(stack) - 1)
        if tag in CLOSES_ITSELF:
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0].tag == tag:
                    pop_to(i)
                    break
                if stack[i][0].tag in ("ul", "ol", "dl", "table"):
                    break
        if tag not in VOID:
            push(tag, names_of(m[3] or m[6] or ""))
    end_block()
    return out


def bucket(n: float, steps: tuple) -> int:
    return sum(n >= s for s in steps)


def ancestor_features(element: Element | None) -> tuple[str, ...]:
    if element is None:
        return ("bias", "in:", "in:")
    return ("bias", *element.own, *sorted(f for e in element.path() for f in e.new))


def text_features(text: str, links: int) -> tuple[str, ...]:
    n = len(text)
    return (
        f"chars:{bucket(n, (10, 25, 50, 100, 200, 400, 800))}", f"linked:{bucket(links / n, (0.01, 0.3, 0.7, 0.99))}", f"stops:{min(3, sum(map(text.count, '.!?')))}",
        f"commas:{min(3, text.count(','))}", f"sign:{int('©' in text)}", f"digits:{bucket(sum(map(text.count, '0123456789')) / n, (0.01, 0.1, 0.3))}", f"end:{text[-1] if text[-1] in '.!?:' else ''}",
    )


def features(block: Block) -> tuple[str, ...]:
    return ancestor_features(block[1]) + text_features(block[0], block[2])


def context(found: list[Block]) -> list[tuple[str, ...]]:
    """Of each block of a page: its length beside the page's longest text that is no link, and how linked its neighbours are."""
    linked = [bucket(links / len(text), (0.3, 0.99)) for text, _, links in found]
    longest = max((len(b[0]) for b, n in zip(found, linked, strict=True) if not n), default=1)
    around = ["edge", *map(str, linked), "edge"]
    return [(f"share:{bucket(len(b[0]) / longest, (0.05, 0.15, 0.4, 0.999))}", f"before:{around[i]}", f"after:{around[i + 2]}") for i, b in enumerate(found)]


class Model:
    """Weights of main text over the rest for each feature, and the transitions' weights [from][to]."""

    def __init__(self, weights: dict[str, float], move: list[list[float]]):
        self.weights, self.move = weights, move

    def inside(self, element: Element | None) -> float:
        """What the elements about a block add, each one's share added up once on the way down from the top."""
        todo = []
        while element and element.total is None:
            todo.append(element)
            element = element.up
        total, w = element.total if element else 0.0, self.weights
        for e in reversed(todo):
            total = e.total = total + sum(w.get(f, 0.0) for f in e.new)
        return total

    def score(self, block: Block, near: tuple[str, ...] = ()) -> float:
        w, (text, element, links) = self.weights, block
        own = element.own if element else ("in:", "in:")
        return w.get("bias", 0.0) + self.inside(element) + sum(w.get(f, 0.0) for f in own + text_features(text, links) + near)

    def decode(self, found: list) -> list[bool]:
        """Viterbi: the most likely labels of a page's blocks together."""
        if not found:
            return []
        (aa, ab), (ba, bb) = self.move
        near = context(found)
        no, yes, back = 0.0, self.score(found[0], near[0]), []
        for b, c in zip(found[1:], near[1:], strict=True):
            s = self.score(b, c)
            no_from, yes_from = yes + ba > no + aa, yes + bb >= no + ab
            no, yes = (yes + ba if no_from else no + aa), (yes + bb if yes_from else no + ab) + s
            back.append((no_from, yes_from))
        label = yes >= no
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str) -> str:
        found = blocks(page)
        return " ".join(b[0] for b, main in zip(found, self.decode(found), strict=True) if main)


def train(pages: list[list[tuple[tuple[str, ...], bool]]]) -> Model:
    """A model from labelled pages: (features, is main text) of each block; penalised likelihood, gradient by
    forward and backward sums over all pages side by side."""
    number: dict[str, int] = {}
    for p in pages:
        for f, _ in p:
            for x in f:
                number.setdefault(x, len(number))
    n, t = len(pages), max(map(len, pages))
    live, y = np.zeros((t, n), bool), np.zeros((t, n), int)
    at, rows, cols = {}, [], []
    for j, p in enumerate(pages):
        for i, (f, main) in enumerate(p):
            live[i, j], y[i, j] = True, main
            at[i, j] = len(at)
            rows += [at[i, j]] * len(f)
            cols += [number[x] for x in f]
    place = np.zeros((t, n), int)
    for (i, j), k in at.items():
        place[i, j] = k
    rows, cols = np.array(rows), np.array(cols)
    total = len(at)
    w, move = np.zeros(len(number)), np.zeros((2, 2))
    pairs = live[1:] & live[:-1]
    seen_move = np.array([[(pairs & (y[:-1] == a) & (y[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    flat_y = np.zeros(total)
    flat_y[place[live]] = y[live]
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, PASSES + 1):
        emit = np.zeros((t, n, 2))
        emit[:, :, 1] = np.where(live, np.bincount(rows, w[cols], total)[place], 0)
        fwd, bwd = np.zeros((t, n, 2)), np.zeros((t, n, 2))
        fwd[0] = emit[0]
        for i in range(1, t):
            fwd[i] = np.where(live[i][:, None], emit[i] + np.logaddexp(fwd[i - 1][:, :1] + move[0], fwd[i - 1][:, 1:] + move[1]), fwd[i - 1])
        for i in range(t - 2, -1, -1):
            nxt = emit[i + 1] + bwd[i + 1]
            got = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
            bwd[i] = np.where(live[i + 1][:, None], got, 0)
        z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z)
        diff = np.zeros(total)
        diff[place[live]] = p1[live]
        g = np.bincount(cols, (diff - flat_y)[rows], len(w)) / n + PENALTY * w
        both = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                both[a, b] = np.exp(fwd[:-1, :, a] + move[a, b] + emit[1:, :, b] + bwd[1:, :, b] - z)[pairs].sum()
        gm = (both - seen_move) / n + PENALTY * move
        for x, grad, m, v in ((w, g, state[0], state[1]), (move, gm, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: float(w[i]) for f, i in number.items()}, move.tolist())


def labelled_page(rng: random.Random) -> list[tuple[str, bool]]:
    """A made-up page as pieces of html, each with whether its text is main text.

    Articles come in the ways pages mark them up, in named, nameless and nested containers, among menus, headers, sidebars, notices, adverts, forms, comments
    and footers; the words are invented, so only tags, names and the shape of texts can be learnt.
    """
    word = lambda: "".join(rng.choice("ba de ki lo mu ra si te vo na ch en er".split()) for _ in range(rng.randint(1, 4)))
    short = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    sentence = lambda: (" ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 20))) + rng.choice([".", ".", ".", "!", "?"])).capitalize()
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6)))
    some = lambda f, a, b: [x for _ in range(rng.randint(a, b)) for x in f()]
    off = lambda s: (s, False)
    attr = lambda *names: f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}"'

    def menu():
        tag = rng.choice(["nav", "nav", f"div{attr('menu', 'navbar', 'breadcrumb', 'nav')}", f"ul{attr('menu', 'nav')}"])
        items = "".join(f'<li><a href="/{word()}">{short()}</a></li>' for _ in range(rng.randint(3, 9)))
        yield off(f"<{tag}><ul>{items}</ul></{tag.split(' ')[0].split(chr(9))[0]}>")

    def advert():
        yield off(f"<div{attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{rng.choice([prose, sentence, short])()}</div>")

    def notice():
        yield off(f"<div{attr('notice', 'cookie', 'alert', 'consent', 'cookie-notice', 'newsletter')}><p>{sentence()}</p></div>")

    def head():
        inner = rng.choice([f"<h1>{short()}</h1>", f"<p>{sentence()}</p>", f"<div class='logo'>{short()}</div>"])
        yield off(f"<header>{inner}</header>" if rng.random() < 0.6 else f"<div{attr('header', 'masthead', 'topbar')}>{inner}</div>")

    def side():
        inner = f"<h3>{short()}</h3>" + rng.choice([f"<p>{prose()}</p>", f"<ul><li><a href='/'>{short()}</a></li><li><a href='/'>{short()}</a></li></ul>"])
        yield off(f"<aside>{inner}</aside>" if rng.random() < 0.5 else f"<div{attr('sidebar', 'related', 'widget', 'share', 'recommended')}>{inner}</div>")

    def form():
        yield off(f"<form><label>{short()}</label><select><option>{word()}</option></select><p>{sentence()}</p><button>{word()}</button><textarea>{short()}</textarea></form>")

    def comments():
        tag = rng.choice(["div", "section", "ol", "ul"])
        one = "li" if tag in ("ol", "ul") else rng.choice(["p", "div", "article"])
        said = "".join(f"<{one}>{prose()}</{one}>" for _ in range(rng.randint(1, 4)))
        yield off(f"<{tag}{attr('comments', 'comment', 'comment-list', 'replies', 'responses')}><h3>{short()}</h3>{said}</{tag}>")

    def foot():
        text = rng.choice(["&copy; ", "", "Copyright "]) + rng.choice([f"{word()}.example.com &middot; {sentence()}", short(), prose()])
        yield off(f"<footer>{text}</footer>" if rng.random() < 0.7 else f"<div{attr('footer', 'copyright', 'bottom')}><p>{text}</p></div>")

    def layout() -> list[str]:
        """Containers that say nothing of what is in them: nameless, with layout words or with invented names."""
        name = lambda: rng.choice(["", "", attr("page", "row", "col", "container", "wrapper", "inner", "grid", "box", "body", "block", "panel", "left", "right"), f' class="{word()}-{word()}"', f' id="{word()}"'])
        return [rng.choice(["div", "div", "div", "section"]) + name() for _ in range(rng.randint(1, 4))]

    def within(tags: list[str], inner: list[tuple[str, bool]]):
        yield off("".join(f"<{t}>" for t in tags))
        yield from inner
        yield off("".join(f"</{t.split(' ')[0]}>" for t in reversed(tags)))

    plain = rng.random()  # how this page marks paragraphs up: mostly as such, or by div, or by line breaks

    def paragraph():
        text = rng.choice([prose, prose, sentence, short])()
        kind = rng.random()
        if plain < 0.25:
            yield (f"<div>{text}</div>", True)
        elif plain < 0.32:
            yield (f"{text}<br>", True)
        elif kind < 0.7:
            yield (f"<p>{text}" + ("</p>" if rng.random() < 0.8 else ""), True)
        elif kind < 0.8:
            yield (f"<p><b>{text}<br>", True)
        elif kind < 0.87:
            yield (f"<h{rng.randint(2, 4)}>{short()}</h2>", True)
        elif kind < 0.94:
            yield ("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>", True)
        else:
            yield (rng.choice([f"<blockquote>{prose()}</blockquote>", f"<pre>{short()}</pre>", f"<table><tr><td>{word()}</td><td>{short()}</td></tr></table>", f"<div>{text}</div>"]), True)

    def article():
        named = rng.random() < 0.5
        tag = rng.choice(["article", "article", "article", "main", f"div{attr('content', 'article', 'post', 'entry-content', 'main', 'story', 'text')}", 'div role="main"'])
        tags = [tag] if named and rng.random() < 0.7 else layout() if not named else [*layout(), tag]
        yield off("".join(f"<{t}>" for t in tags))
        if rng.random() < 0.7:
            yield (f"<h1>{short()}</h1>", True)
        yield from some(paragraph, *rng.choice([(1, 1), (1, 1), (2, 4), (1, 12), (1, 12)]))
        for extra in (advert, side, form, comments, notice):
            if rng.random() < 0.12:
                yield from extra()
                yield from some(paragraph, 0, 4)
        yield off("".join(f"</{t.split(' ')[0]}>" for t in reversed(tags)))

    def around(f):
        """Other parts stand in such containers too."""
        return list(within(layout(), list(f()))) if rng.random() < 0.25 else list(f())

    wide = layout() if rng.random() < 0.35 else []
    out = [off(f"<html><head><title>{short()}</title><style>p{{}}</style></head><body>"), off("".join(f"<{t}>" for t in wide))]
    for f, p in ((notice, 0.2), (head, 0.4), (menu, 0.9), (advert, 0.5), (side, 0.2), (form, 0.15)):
        if rng.random() < p:
            out += around(f)
    out += article()
    for f, p in ((comments, 0.25), (side, 0.25), (form, 0.15), (advert, 0.2), (notice, 0.1), (menu, 0.15), (foot, 0.9)):
        if rng.random() < p:
            out += around(f)
    return out


def labelled(pieces: list[tuple[str, bool]]) -> list[tuple[tuple[str, ...], bool]]:
    """Features and labels of a labelled page's blocks: marks in the text carry the labels through the parser."""
    mark = "\ue000"
    page = "".join(re.sub(r">([^<]+)", lambda m: f">{mark}{m[1]}" if m[1].strip() else m[0], h) if main else h for h, main in pieces)
    marked = blocks(page)
    found = [(text.replace(mark, ""), up, links) for text, up, links in marked]
    return [(features(b) + c, mark in m[0]) for b, c, m in zip(found, context(found), marked, strict=True)]


@lru_cache(1)
def trained(seed: int = 11) -> Model:
    rng = random.Random(seed)
    return train([labelled(labelled_page(rng)) for _ in range(PAGES)])


def extract(df: DataFrame, html_col: str = "html", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """df with text_col (the main text) and n_chars (its code points) for html_col.

    A null page is taken as empty; a page without main text gives an empty text. Pages are read whole and one by
    one, very long and deeply nested ones too: repeats give equal texts, an empty table none. Other columns are
    passed on, whatever their names; those called like the results are replaced.
    """
    model = model or trained()
    row, back = carried(df, {html_col, text_col, "n_chars"})
    weights, move = model.weights, model.move

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, move)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts = [own.main_text((h or b"").decode("utf-8", "replace")) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    rows = df.select(row, by_name(html_col).cast("binary").alias("html"))
    out = rows.mapInArrow(work, T.StructType([rows.schema["row"]]).add("text", "string").add("n_chars", "long"))
    return out.select(*back, F.col("text").alias(text_col), "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
