import random
from array import array

import pyarrow as pa
import pytest

import corpus_pipeline
from aidlake.llm import pieces

sp = pytest.importorskip("sentencepiece")
MODEL = open(pieces.MODEL, "rb").read()
P = pieces.Pieces(MODEL)
TEXTS = ["Hello  world\nfoo\tbar \U0001f642 ", " ", "   a", "", "ñ\x00z", "a▁b", "▁", "naïve façade — “quoted”", "x" * 3000, "日本語 text", "a  b   c    d", "!!!??? ... ,,,"]


def ids(text):
    out = array("i")
    P.encode(text, out)
    return out.tolist()


def library():
    """The library's own unigram encoder with the same pieces and scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    m.trainer_spec.model_type = 1
    for i, s in P.scores.items():
        m.pieces[i].score = s
    return sp.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_exact_round_trip():
    r = random.Random(0)
    some = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD7FF), 0x2581, 32, 10])) for _ in range(r.randrange(200))) for _ in range(200)]
    for t in some:
        assert P.decode(ids(t)) == t.encode()


def test_same_best_score_as_the_library():
    lib, r = library(), random.Random(1)
    words = "the of anthropology ing tion réseau Straße niño 12345 foo_bar http://a.b/c x=y; ((( wonderful".split()
    cost = lambda s: sum(P.scores.get(i, P.unknown / 3) for i in s)
    same = 0
    for _ in range(300):
        t = " ".join(r.choice(words) + r.choice(["", "s", ",", "!"]) for _ in range(r.randrange(1, 12)))
        mine, theirs = ids(t), lib.encode(t)
        same += mine == theirs
        assert abs(cost(mine) - cost(theirs)) < 1e-2  # they can differ only among equal scores
    assert same > 290


def test_against_plain_dynamic_programming():
    table = {p.decode().replace(" ", "▁"): P.scores[i] for i, p in P.text.items() if i in P.scores}
    for w in ["▁hello", "▁▁▁wörld", "internationalisation", "zzzzqqq", "▁é́x"]:
        best = [0.0] + [-1e18] * len(w)
        for e in range(1, len(w) + 1):
            for b in range(e):
                s = table.get(w[b:e], P.unknown if e - b == 1 else None)
                if s is not None:
                    best[e] = max(best[e], best[b] + s)
        got = P.viterbi(w)
        if all(i in P.scores for i in got):
            assert abs(sum(P.scores[i] for i in got) - best[-1]) < 1e-9


def test_columns(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate([*TEXTS, None])] + [(None, "again", "x", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    out = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded == r.text for r in out) and len(out) == len(rows)
    assert [r.ids for r in out if r.text is None] == [None] and [r.ids for r in out if r.text == ""] == [[]]
    assert pieces.decode(pieces.encode(df.limit(0))).collect() == []


def test_large_models_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pieces, "LARGEST", 10)
    with pytest.raises(ValueError):
        pieces.encode(spark.createDataFrame([("a",)], "text string"))


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a b", "x", "y", "z")], "text string, _text string, `a.b` string, row string")
    got = pieces.decode(pieces.encode(df)).first()
    assert (got["_text"], got["a.b"], got["row"], got.text, got.decoded) == ("x", "y", "z", "a b", "a b")


def test_a_very_long_text_without_spaces():
    t = "abcdefghij" * 150_000
    assert P.decode(ids(t)) == t.encode()


def test_columns_decode_like_single_texts_and_chunks_are_kept_as_bytes():
    texts = ["", "a", "  two  spaces", "\u2581lit", "\u4e2d\U0001f600 x", " ", "end "]
    coded = []
    for t in texts:
        ids = array("i")
        P.encode(t, ids)
        coded.append(ids.tolist())
    lists = pa.array([None, *coded, None, []], pa.list_(pa.int32()))
    assert P.decode_all(lists).to_pylist() == [None, *texts, None, ""]
    assert P.decode_all(lists.slice(2, 4)).to_pylist() == [P.decode(c).decode() for c in coded[1:5]] and P.decode_all(lists.slice(0, 1)).to_pylist() == [None] and P.decode_all(lists.slice(0, 0)).to_pylist() == []
    for bad in ([10**6], [-1], [None]):
        with pytest.raises(KeyError):
            P.decode_all(pa.array([bad], pa.list_(pa.int32())))
    assert all(isinstance(ids, bytes) for ids in P.known.values())


def test_round_trip_in_one_worker(spark):
    """Both directions in one pass over the rows, so a task keeps one vocabulary and one set of remembered chunks."""
    rows = [(i, t, "x", [1]) for i, t in enumerate([*TEXTS, None])] + [(None, "again", "x", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = pieces.round_trip(df)
    two = pieces.decode(pieces.encode(df))
    assert sorted(map(str, got.select(two.columns).collect())) == sorted(map(str, two.collect()))
    assert pieces.round_trip(df.limit(0)).collect() == []
    same = pieces.round_trip(df.select("text", "doc_id"), back_col="text")
    assert sorted(same.columns) == ["doc_id", "ids", "text"] and all(r.text == rows[r.doc_id][1] for r in same.where("doc_id is not null").collect())


def test_the_pipeline_and_the_query_start_one_worker_a_task(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for df in (pieces.query(spark, str(tmp_path)), corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
