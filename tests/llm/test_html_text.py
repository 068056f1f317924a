import random
import time

from aidlake.llm import html_text as h


def test_held_out_pages():
    r, wrong, total, whole = random.Random(77), 0, 0, 0
    model = h.trained()
    for _ in range(200):
        page = h.labelled_page(r)
        want = [m for _, m in h.labelled(page)]
        got = model.decode(h.blocks("".join(x for x, _ in page)))
        wrong += sum(a != b for a, b in zip(want, got, strict=True))
        total += len(want)
        whole += want == got
    assert wrong / total < 0.02 and whole > 150


def test_viterbi_is_the_best_path():
    model, r = h.trained(), random.Random(5)
    for _ in range(20):
        found = h.blocks("".join(x for x, _ in h.labelled_page(r)))[:10]
        score = lambda y: sum(model.score(b, c) for b, c, l in zip(found, h.context(found), y) if l) + sum(model.move[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(score([k >> i & 1 for i in range(len(found))]) for k in range(1 << len(found)))
        assert abs(score([int(x) for x in model.decode(found)]) - best) < 1e-9


def test_blocks():
    page = """<!doctype html><HTML><body CLASS='Main-Page'><script>if (a<b) "</p>"</script><!-- <p>no</p> --><p>One&nbsp;two &amp; t<b>hr</b>ee<br>four &lt;x&gt; <p id=z>five
        <ul><li>a<li>b</ul><style>p{}</style>tail < 5 &copy; &#x41;&#66; <img alt=">" src=x>end</body><p title="cut"""
    got = [(t, [e.tag for e in up.path()][::-1]) for t, up, _ in h.blocks(page)]
    assert got == [("One two & three", ["html", "body", "p"]), ("four <x>", ["html", "body", "p"]), ("five", ["html", "body", "p"]), ("a", ["html", "body", "ul", "li"]), ("b", ["html", "body", "ul", "li"]), ("tail < 5 © AB", ["html", "body"]), ("end", ["html", "body"])]
    assert h.blocks(page)[0][1].up.new == ("under:body", "name:main", "name:page")
    assert h.blocks("") == [] and h.blocks("<<<>>>") and h.blocks("<p")  == []


def test_article_without_the_rest(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Title</h1><p>First words, and more of them here.</p><p>Second &eacute;t&eacute;.</p></article><div class='comments'><p>Nice post, thank you.</p></div><footer>&copy; someone</footer></body></html>"
    rows = [(1, page, "x", 1), (1, page, "x", 1), (2, None, None, None), (3, "", None, None), (None, "<p>" + "word " * 200_000 + "</p>", None, None)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")).collect()
    assert [g.text for g in got[:2]] == ["Title First words, and more of them here. Second été."] * 2
    assert got[0].n_chars == len(got[0].text) and [g.text for g in got[2:4]] == ["", ""] and len(got) == 5
    assert h.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_work_grows_with_the_page_not_with_its_depth():
    def steps(n):
        began = time.process_time()
        found = h.blocks("<div class='a b'><p>x</i></li>" * n)
        assert len(found) == n and h.trained().decode(found) is not None
        return time.process_time() - began

    h.trained()
    assert steps(40_000) < 12 * steps(10_000) + 0.5


def test_scores_do_not_depend_on_the_way_they_are_added_up():
    model, r = h.trained(), random.Random(8)
    for _ in range(20):
        for b in h.blocks("".join(x for x, _ in h.labelled_page(r))):
            assert abs(model.score(b) - sum(model.weights.get(f, 0.0) for f in h.features(b))) < 1e-9


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("<p>One.</p>", "x", "y", "z")], "html string, _html string, `a.b` string, row string")
    got = h.extract(df).first()
    assert (got["_html"], got["a.b"], got["row"]) == ("x", "y", "z") and got.text in ("", "One.")
