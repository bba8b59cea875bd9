import glob
import os

import pyarrow as pa
import pytest

from lexweave.llm import pieces

from .helpers import clashing, none, odd, words

MODELS = sorted(glob.glob(os.path.dirname(pieces.MODEL) + "/*.model"))
TEXTS = ["", " ", "  two  spaces ", "a", "Hello, world!", "\n\nline\n line\ttab", "Straße 北京市 \U0001f600 é é", "▁mark ▁▁ x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, words(3000, 5), "https://a.b/c?d=1&e=2 {json: [1, 2]}", "\x00\x01​"]


@pytest.mark.parametrize("path", MODELS)
def test_ids_equal_the_librarys(path):
    import sentencepiece

    try:
        model = pieces.Pieces.load(path)
    except ValueError:
        pytest.skip("a normalizer of another kind")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    values, start = encoder.encode(pa.array(TEXTS))
    back = decoder.decode(values, start)
    fits = pieces.same(pa.array(TEXTS), values, start, decoder)
    for t, a, b, text, ok in zip(TEXTS, start, start[1:], back, fits):
        assert values[a:b].tolist() == library.encode(t), t[:50]
        assert ok == (text == t)
        if "▁" not in t and "\x00" not in t and model.byte_ids:
            assert text == t


def test_round_trip_in_spark(spark):
    docs = clashing(odd(spark), "ids", "n_tokens", "round_trip")
    made = pieces.encode(docs, check=True)
    rows = made.collect()
    assert len(rows) == docs.count()
    assert all(r.round_trip is None if r.text is None else r.round_trip for r in rows)
    assert all((r.ids is None) == (r.text is None) and (r.ids is None or len(r.ids) == r.n_tokens) for r in rows)
    back = pieces.decode(made).collect()
    assert all(r.decoded == r.text for r in back)


def test_equal_texts_equal_ids_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(5)
    by_text: dict = {}
    for r in pieces.encode(df).collect():
        assert by_text.setdefault(r.text, list(r.ids)) == list(r.ids)
    assert pieces.encode(none(spark)).count() == 0


def test_viterbi_finds_the_best_score():
    model = pieces.Pieces("unigram", ["a", "b", "ab", "abc", "c", "bc", "▁"], {"a": -1, "b": -1.1, "ab": -1.5, "abc": -4, "c": -1.2, "bc": -1.4, "▁": -0.5}, {p: i for i, p in enumerate(["a", "b", "ab", "abc", "c", "bc", "▁"])})
    values, _ = pieces.Encoder(model).encode(pa.array(["abc"]))
    assert [model.names[i] for i in values] == ["▁", "a", "bc"]


def test_unigram_ids_equal_the_librarys(tmp_path):
    """A model written by hand (no training): pieces with scores, byte fallback, the identity normalizer."""
    import math
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(3)
    letters = "abcdef▁é"
    names = list(dict.fromkeys([*letters, *("▁" * rng.randint(0, 1) + "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(150))]))
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = 1, True, 0
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = "identity", False, True
    for name, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))]:
        m.pieces.add(piece=name, score=0.0, type=kind)
    for name in names:
        m.pieces.add(piece=name, score=-len(name) ** 0.5 * 3 - rng.random() * math.pi, type=1)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    model, library = pieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "abc def", " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 30))) for _ in range(300)), "aXb 北 é"]
    values, start = pieces.Encoder(model).encode(pa.array(texts))
    for t, a, b, back in zip(texts, start, start[1:], pieces.Decoder(model).decode(values, start)):
        assert values[a:b].tolist() == library.encode(t) and back == t
