"""Token ids against the tokenizer, packing against its rules."""

import random
import zlib

import numpy as np
import pytest

from gazetta.llm.packing import Tokens, best_fit, pack

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    texts = ["it's 'tis don't! it'!", "<|startoftext|> a<|endoftext|>.", "ΑΣ. Σ", "é! é.", "İ! ı", "ab1! 12.", "…! a…", "", "  \n", "I'LL! 's", "ﬁ! Å."]
    texts += ["".join(rng.choice("ab'.,! <|̸́sStTéΣ1 _-") for _ in range(40)) for _ in range(500)]
    tokens = Tokens(PATH)
    ended = tokens.texts([t.encode() for t in texts])
    other = Tokens(PATH)
    other.ends[:] = False  # as of a vocabulary without ends of words
    assert ended == other.texts([t.encode() for t in texts])
    for text, got in zip(texts, ended, strict=True):
        assert got == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_best_fit_holds_and_uses_all():
    lengths = np.array([random.Random(2).randint(1, 100) for _ in range(500)])
    bins = best_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) <= -(-lengths.sum() // 100) * 1.05 + 1


@pytest.mark.parametrize("together", [50_000, 40])
def test_pack_round_trip(spark, together):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "news", "word,", "zzzz!"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "null id"), (7, rows[7][1]), (1000, None), (1001, ""), (1002, "x " * 300)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, size=64, together=together).collect()
    tokenizer = Tokens(PATH).tokenizer
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(w[3] for w in want) // 64)
    assert len(bins) <= least * 1.1 + 8


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
