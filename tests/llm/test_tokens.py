import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barflow.llm import registry, sentencepiece_viterbi, token_files

BPE, WORD = registry.tokenizer("piece_bpe_32k.model"), registry.tokenizer("word_bpe_49k.json")
HARD = ["", " ", "  a  b ", "\n\nx\n", "é😀𝔘x", "▁a▁▁b", "<s> </s>", "aaaaaaaaaaaaa" * 20, "hello\tworld", "日本語テキスト", "a\x01b \x01", "́a", "x" * 5000, "  \n ", "tail "]


def test_encoder_equals_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=BPE)
    r = random.Random(0)
    texts = HARD + ["".join(r.choice("abcdeilnorst  \n,.é") for _ in range(r.randrange(200))) for _ in range(300)]
    encoder = sentencepiece_viterbi.Encoder(sentencepiece_viterbi.Pieces.read(BPE))
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        want = lib.encode(texts)
        start = 0
        for t, e, w in zip(texts, ends.tolist(), want, strict=True):
            assert ids[start:e].tolist() == w, t
            start = e
        assert sentencepiece_viterbi.decode(encoder.p, ids, ends) == lib.decode(want)


def test_unigram_mode_maximises_scores():
    from functools import cache

    r = random.Random(3)
    pieces = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(40)} | set("abc"))
    scores = np.array([-r.random() * 5 for _ in pieces])
    p = sentencepiece_viterbi.Pieces(pieces, scores, np.ones(len(pieces), bool), np.full(256, -1), 0, unigram=True, dummy_prefix=False)
    for n in (1, 5, 12):
        words = ["".join(r.choice("abc") for _ in range(n)) for _ in range(20)]
        ids, count = sentencepiece_viterbi._viterbi(p, words)
        at = 0
        for w, k in zip(words, count.tolist(), strict=True):
            got = ids[at : at + k].tolist()
            at += k

            @cache
            def best(i, w=w):
                return 0.0 if i == len(w) else max((scores[j] + best(i + len(q)) for j, q in enumerate(pieces) if w.startswith(q, i)), default=-1e9)

            assert "".join(pieces[i] for i in got) == w and abs(scores[got].sum() - best(0)) < 1e-9


def test_encode_table(spark, docs, corpus, no_docs):
    out = sentencepiece_viterbi.encode(docs, BPE).collect()
    assert len(out) == len(corpus) and all(r.decoded_ok for r in out) and all(len(r.ids) == r.n_tokens for r in out)
    assert sentencepiece_viterbi.encode(no_docs, BPE).count() == 0


@pytest.mark.parametrize("file", [WORD, registry.tokenizer("byte_bpe_50k.json")])
def test_token_files_equal_tokenizer(spark, docs, corpus, file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    extra = [(100 + i, x) for i, x in enumerate([*HARD, "<|endoftext|>a", "It's 5 o'clock", "ΑΣ ΑΣΑ", "\x1cx\x85y　z"])]
    more = spark.createDataFrame([(i, x, None, None, 0) for i, x in extra], docs.schema)
    manifest = token_files.write(docs.unionByName(more), file, partitions=3)
    got = sorted(map(tuple, token_files.read(manifest).collect()), key=lambda r: r[1])
    rows = sorted([(i is not None, i or 0, x or "") for i, x in [*corpus, *extra]])
    at = 0
    assert len(got) == len(rows)
    for g, (some, i, x) in zip(got, rows, strict=True):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        assert g == (i if some else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), x
        at += len(ids)


def test_no_token_files_for_an_empty_table(spark, no_docs):
    assert token_files.read(token_files.write(no_docs, WORD)).count() == 0
