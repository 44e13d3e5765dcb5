import random
import time

import pyarrow as pa
import pytest

from barflow.llm import registry
from barflow.llm.sentencepiece_viterbi import Encoder, Pieces


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    path = registry.tokenizer("piece_bpe_32k.model")
    return Encoder(Pieces.read(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def texts():
    r = random.Random(8)
    yield "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(10_000))
    yield "".join(r.choice("中国人的一是在不了有和") for _ in range(4000))
    for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "the", "etaoin", "ああいうえお", "0123456789", "-=_", "x"):
        for n in (47, 48, 49, 513, 5000):
            yield "".join(r.choice(letters) for _ in range(n))
    yield "".join(r.choice(["ing", "tion", "國", "ß", "é", "http://", "\n", "a", " "]) for _ in range(3000))
    yield " ".join("".join(r.choice("abcé漢") for _ in range(r.randrange(1, 900))) for _ in range(50))
    yield "a" * 20_000


def test_words_of_any_length_equal_the_library(both):
    encoder, library = both
    for t in texts():
        ids, ends = encoder.encode(pa.array([t, "then plain words"]))
        assert ids[: ends[0]].tolist() == library.encode(t), t[:60]


def test_unspaced_text_is_batched(both):
    encoder, _ = both
    r = random.Random(9)
    encoder.encode(pa.array(["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(2000))]))
    text = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(100_000))
    began = time.perf_counter()
    encoder.encode(pa.array([text]))
    assert time.perf_counter() - began < 8
