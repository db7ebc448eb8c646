import random

import public_tokenizers as P
import pyarrow as pa
import pytest

from tests.llm.fixtures import texts
from tidemark.llm.tokens import Encoder

ODD = [None, "", " ", "  a", "a  b ", "a \n b", "x\n\ny z", "a b c", "it's  don't", "\x1c q \x1f", "<|endoftext|> <|startoftext|>", "é é ÀÉ", "́a b", "a  　b", "1234 5,6 _x_", "日本 語", "\u0085 n", "AΣ Σ.", "H\u0331. H\u0331", "²,³ ½;x", "a.\nB!\n\nc", "a\n b\n.", "i'm. I'M 'S", "a_.b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library_on_whole_texts(name):
    e = Encoder(P.path(name), kept=50)
    assert e.kind == ("led" if name[0] == "b" else "bare")
    rng = random.Random(3)
    signs = ["a", "B", " ", " ", "\n", "\t", "'s", "é", "9", " ", ".", " ", "\x1d"]
    many = ODD + texts(60) + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for _ in range(2):
        ids, starts = e.encode(pa.array(many, pa.string()))
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in many], add_special_tokens=False)]
        for k, w in enumerate(want):
            assert ids[starts[k] : starts[k + 1]].tolist() == w, many[k]
    assert e.encode(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_plain_pieces_go_to_the_library_in_groups(name, monkeypatch):
    e = Encoder(P.path(name))
    sent = []
    real = Encoder._by_library
    monkeypatch.setattr(Encoder, "_by_library", staticmethod(lambda tokenizer, units: sent.append(len(units)) or real(tokenizer, units)))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgéñßxyz") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    ids, starts = e.encode(pa.array([" ".join(words), "\x00 a\x00b \x00", *words[:200]]))
    assert sum(sent) < len(set(words)) / 10
    for k, text in enumerate([" ".join(words), "\x00 a\x00b \x00", *words[:200]]):
        assert ids[starts[k] : starts[k + 1]].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
