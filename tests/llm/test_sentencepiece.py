"""Ids equal the public library's, for BPE and unigram models; decoding is the way back."""
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from penalytics.llm import sentencepiece_codec as S  # noqa: E402
from penalytics.llm.queries import MODEL_FILE  # noqa: E402
from penalytics.sources.tables import table_path  # noqa: E402


def model_bytes(kind):
    with open(MODEL_FILE, "rb") as f:
        data = f.read()
    if kind == "bpe":
        return data
    # the same vocabulary and scores, read as a unigram model (trainer_spec.model_type)
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")
    return data[:at] + b"\x18\x01" + data[at + 2:]


@pytest.fixture(scope="module", params=["bpe", "unigram"])
def pair(request):
    data = model_bytes(request.param)
    return S.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def texts():
    rng = random.Random(7)
    alphabet = "ab -*  1\n\té日x'the ﬁ　😀"
    yield from ("", " ", "  ", "a", "Hello  world", "日本語", "\x00\x01", "▁x", "aaaa" * 50)
    for _ in range(400):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))


def test_ids_equal_the_library(pair):
    codec, library = pair
    if codec.joins is None:  # ties between equally good paths are not defined: compare what they score
        for text in texts():
            mine, theirs = codec.encode(text).tolist(), library.encode(text)
            score = lambda ids: sum(codec.model.scores[i] for i in ids if codec.model.kinds[i] == S.NORMAL)
            assert mine == theirs or score(mine) == pytest.approx(score(theirs), rel=1e-6), text
    else:
        for text in texts():
            assert codec.encode(text).tolist() == library.encode(text), text


def test_decode(pair):
    codec, library = pair
    for text in texts():
        ids = codec.encode(text).tolist()
        assert codec.decode(ids) == library.decode(ids) == text.replace("▁", " ")


def test_stream_equals_whole_and_keeps_a_small_window(pair):
    codec, _ = pair
    rng = random.Random(3)
    text = codec.marked("".join(rng.choice("abc the in ing 12\n") for _ in range(5000)))
    encoder, ids, widest = S.Encoder(codec.model, codec.joins), [], 0
    at = 0
    while at < len(text):
        size = rng.randrange(1, 40)
        ids += encoder.feed(text[at: at + size])
        widest = max(widest, len(encoder.text))
        at += size
    ids += encoder.finish()
    assert ids == list(codec.stream([text]))
    assert widest <= 40 + 4 * codec.model.longest


def test_a_small_memo_gives_the_same(pair):
    codec, _ = pair
    small = S.Codec.__new__(S.Codec)
    small.__init__(model_bytes("bpe" if codec.joins else "unigram"), memo_spans=3)
    for text in list(texts())[:60]:
        assert small.encode(text).tolist() == codec.encode(text).tolist()


def test_documents(spark, small, docs_of):
    docs = spark.read.parquet(table_path(small, "documents"))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    expected = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    found = S.encode_documents(docs, MODEL_FILE).collect()
    assert {r.doc_id: r.token_ids for r in found} == expected
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in found)
    odd = S.encode_documents(docs_of([(1, None), (1, None), (None, ""), (2, "x" * 100_000)]), MODEL_FILE).collect()
    assert sorted(len(r.token_ids) for r in odd)[:3] == [0, 0, 0] and all(r.round_trip for r in odd)
