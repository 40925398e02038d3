"""Encoding and counting against the public SentencePiece library."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from logtide.llm import pieces, sentencepiece_codec, token_counts

with open(sentencepiece_codec.MODEL, "rb") as f:
    MODEL = f.read()
rng = random.Random(4)
ALPHABET = list("abcdehilnorst") + ["  ", " ", "\n", "\t", "\r", "ç", "é", "漢", "字", "🦄", ".", ",", "(", "1", "2", "_", "²", "”", "\x00", "e\u0301"]
RANDOM = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 120))) for _ in range(200)]
TEXTS = ["", " ", "   ", " a", "a ", "hello world", "Hello  world\n\nthe the", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 9000, "the quick brown " * 2000, *RANDOM]


def as_unigram():
    own = pieces.load_vocabulary(MODEL)
    scores = pieces.in_bits(own).scores
    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.piece in scores and p.type == 1:
            p.score = scores[p.piece]
    return m.SerializeToString()


def test_ids_equal_the_library():
    own, lib = sentencepiece_codec.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for t in TEXTS:
        ids = list(memoryview(own.encode(t)).cast("i"))
        assert ids == lib.encode(t), t
        assert own.decode(ids) == t


def test_unigram_models_equal_the_library():
    model = as_unigram()
    own, lib = sentencepiece_codec.Encoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in TEXTS[:60]:
        assert list(memoryview(own.encode(t)).cast("i")) == lib.encode(t), t


@pytest.mark.parametrize("merges", [True, False])
def test_streamed_windows(merges):
    v = pieces.load_vocabulary(MODEL if merges else as_unigram())
    for text in ("".join(rng.choice("abcdefghino") for _ in range(5000)), "x" * 3000, "internationalization" * 100):
        once = pieces.StreamingViterbi(v)
        whole = once.push(text) + once.finish()
        stream, out, most = pieces.StreamingViterbi(v), [], 0
        for i in range(0, len(text), 37):
            out += stream.push(text[i : i + 37])
            most = max(most, len(stream.text))
        assert out + stream.finish() == whole
        assert pieces.StreamingViterbi(v).stream(text) == whole
        if merges or text[0] != "x":  # paths of equal score through a run of one letter never meet
            assert most < 200 and stream.widest < 150  # committed as it goes along


def test_real_texts_go_through_a_bounded_window():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    own, lib = sentencepiece_codec.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for t in texts:
        assert list(memoryview(own.encode(t)).cast("i")) == lib.encode(t)
    assert own.window.pushes > 10_000 and own.window.widest <= 2 * own.v.longest


def test_parts_of_any_size():
    own, lib = sentencepiece_codec.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    counter = token_counts.Counter(MODEL)
    word = "".join(rng.choice("abcdefghino.,1é") for _ in range(7000))
    for text in (f"a {word} b  c", word, f"{word}   {word} ", " " * 3000 + word + " " * 2500 + "z", "a  " * 900):
        expected = lib.encode(text)
        for size in (1, 37, 1500, 100_000):
            assert list(memoryview(own.feed(text[i : i + size] for i in range(0, len(text), size))).cast("i")) == expected
        assert counter.count(text)[0] == len(expected)


def test_counts_equal_the_library():
    c = token_counts.Counter(MODEL)
    lib, uni = sentencepiece.SentencePieceProcessor(model_proto=MODEL), sentencepiece.SentencePieceProcessor(model_proto=as_unigram())
    for t in TEXTS:
        own, n, score = c.count(t)
        assert (own, n) == (len(lib.encode(t)), len(uni.encode(t))), t
        spelt = [uni.id_to_piece(i) for i in uni.encode(t)]
        unknown = sum(uni.is_byte(i) and int(p[1:-1], 16) & 0xC0 != 0x80 for i, p in zip(uni.encode(t), spelt))  # characters without a piece
        known = sum(uni.get_score(i) for i in uni.encode(t) if not uni.is_byte(i))
        assert score == known + unknown * (min(c.window.u.scores.values()) - 10), t


def test_pairs_left_alone_by_merging():
    v = pieces.load_vocabulary(MODEL)
    m = pieces.Merges(v)
    assert 0 < len(m.odd) < 50
    some = [p for p in v.ids if rng.random() < 0.05 or len(p) < 3] + ["漢", "\x01", *(p for p in v.ids if p.startswith("▁▁"))]
    close = {}
    for p in v.ids:
        close.setdefault(p[0], []).append(p)
    for _ in range(30_000):
        left = rng.choice(some)
        right = rng.choice(some if rng.random() < 0.5 else close.get(left[-1], some))
        assert m._undone(left, right) == m._merged(left, right), (left, right)
    assert all(m._undone("", p) == m._merged("", p) for p in some)


def test_cache_keeps_results(monkeypatch):
    r = pieces.Remembered(len, limit=3)
    for x in ["a", "bb", "ccc", "dddd", "a", "bb", "eeeee"] * 3:
        assert r[x] == len(x)
    assert len(r) + len(r.old) <= 6


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, "", "z"), (None, "é🦄", ""), (5, "the " * 30_000, "")], "doc_id long, text string, ids string")
    out = sentencepiece_codec.encode(df)
    got = {(r["doc_id"], r["n_tokens"]): r for r in out.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert got[(1, len(lib.encode("hello world")))]["ids"] == lib.encode("hello world")
    assert sum(r["n_tokens"] == 0 for r in out.collect()) == 2 and all(r["round_trip"] for r in out.collect())
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(out).where("doc_id in (1, 5)").collect()}
    assert back == {1: "hello world", 5: "the " * 30_000}
    full = sentencepiece_codec.append_ids(df)
    assert full.columns == ["doc_id", "text", "ids", "n_tokens"] and full.count() == 5
    counted = token_counts.count(df)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in counted.collect()) == sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out.collect())
    for f in (sentencepiece_codec.encode, token_counts.count, sentencepiece_codec.append_ids):
        assert f(df.limit(0)).count() == 0


def test_other_models_are_refused():
    m = pb.ModelProto()
    m.ParseFromString(MODEL)
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.load_vocabulary(m.SerializeToString())
