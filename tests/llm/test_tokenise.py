import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from obsq.llm.tokenise import Encoder, documents_ids  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "a", " a ", "a  b", "a\n b", "a \nb\n\nc\n", "\n", "a   b", "é été", "x  y", "don't we'll 's", "a <|endoftext|> b", "tab\t\tx", "日本 語 テ", "a\x1c b", "naïve\u0085 x", "   x", "ends ", "end\n", "It's,it's. 'tis a1b2"]


@pytest.mark.parametrize("most", [50, 2_000_000])
def test_equals_the_tokenizer(most):
    random.seed(3)
    letters = [" ", "\n", "a", "B", "é", "'s", "1", " ", "　", "语", ".", "\t", "\x1c", "​", "\U0001f600", " ", "x", "'", ",", "×", "ſ"]
    texts = ODD + ["".join(random.choices(letters, k=random.randint(1, 25))) for _ in range(3000)]
    encoder = Encoder(PATH, most)
    for lo in range(0, len(texts), 97):
        some = texts[lo : lo + 97]
        from obsq.llm.common import text_slices

        for row, data, offsets in text_slices(pa.array(some, pa.string()), 300):
            ids, count = encoder.ids(data, offsets)
            at = np.concatenate(([0], np.cumsum(count)))
            for k in range(len(count)):
                assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(some[row + k] or "", add_special_tokens=False).ids, some[row + k]


def test_an_end_id_follows_every_document():
    out = list(documents_ids(PATH, pa.array(["a", None, ""])))
    assert [c.tolist() for _, _, c in out] == [[2, 1, 1]]
    assert out[0][1].tolist()[1:] == [0, 0, 0]


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_clash_in_polynomial_hashes():
    """Two Thue-Morse words of 1,024 letters have one hash for any odd base modulo 2^64."""
    a, b = thue_morse(1024, 0), thue_morse(1024, 1)
    tokenizer = Encoder(PATH).tokenizer
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in (a, b, a + " " + b)]
    (_, ids, count), = documents_ids(PATH, pa.array([a, b, a + " " + b]))
    assert ids.tolist() == sum(want, []) and count.tolist() == list(map(len, want))


def test_equal_hashes_of_unlike_cuts(monkeypatch):
    from obsq.llm import common

    monkeypatch.setattr(common, "span_hashes", lambda data, start, end, lane=0: (end - start).astype(np.uint64))
    encoder = Encoder(PATH)
    ((_, data, offsets),) = common.text_slices(pa.array(["one two", "six ten", "one"]))
    ids, _ = encoder.ids(data, offsets)
    assert ids.tolist() == sum((encoder.tokenizer.encode(t).ids for t in ("one two", "six ten", "one")), [])


def test_long_words():
    texts = ["x" * 100_000 + " y", "x" * 99_999 + "z " + "ab" * 300]
    tokenizer = Encoder(PATH).tokenizer
    (_, ids, _), = documents_ids(PATH, pa.array(texts))
    assert ids.tolist() == sum(([*tokenizer.encode(t).ids, 0] for t in texts), [])
