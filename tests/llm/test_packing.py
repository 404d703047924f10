import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from obsq.llm import packing, token_output  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [(5, "one two three"), (3, None), (9, ""), (1, "word " * 3000), (7, "é\n\n x"), (7, "é\n\n x"), (2, "a b c d e f g")]
SCHEMA = "doc_id long, text string, start string, ids int"


def encode(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def docs(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in TEXTS], SCHEMA).repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64)
    raw = token_output.pack(ids, bits)
    assert len(raw) == bits * 126
    assert token_output.unpack(raw, bits)[:1003].tolist() == ids.tolist()


def test_reader_takes_any_span(tmp_path):
    ids = np.random.default_rng(0).integers(0, 50257, 1000).astype("<u4")
    with open(tmp_path / "x", "wb") as f:
        w = token_output.Writer(f, 16, 64)
        w.add(np.array([4, 5]), np.array([False, True]), np.array([300, 700]), ids)
        assert w.close() == (2, 1000)
    from obsq.llm.common import filesystem

    fs, at = filesystem(str(tmp_path / "x"))
    with fs.open_input_file(at) as stream:
        r = token_output.Reader(stream)
        for a, n in ((0, 1), (63, 2), (64, 64), (999, 1), (0, 1000), (5, 0)):
            assert r.span(a, n).tolist() == ids[a : a + n].tolist()
        assert r.document(1).tolist() == ids[300:].tolist() and r.null.tolist() == [False, True]


def test_token_output(spark):
    got = sorted(token_output.op2_token_output(spark, docs(spark), PATH).collect())
    at, want = 0, []
    for d, t in sorted(TEXTS, key=lambda x: x[0]):
        ids = encode(t)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_output.op2_token_output(spark, docs(spark).limit(0), PATH).count() == 0


def test_lengths():
    assert packing.lengths(2048 + 7, 1024) == [1024, 1024, 4, 2, 1]
    with pytest.raises(ValueError):
        packing.lengths(5, 1000)


@pytest.mark.parametrize("longest", [1024, 4, 1])
def test_packing(spark, longest):
    got = packing.op9_packing(spark, docs(spark), PATH, longest).collect()
    want = []
    for d, t in TEXTS:
        ids, at = encode(t), 0
        for n in packing.lengths(len(ids), longest):
            want.append((d, at, n, crc(ids[at : at + n]), len(ids)))
            at += n
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert sorted(r.sequence_id for r in got) == list(range(len(want)))
    assert {r["offset"] for r in got} == {0}
    by = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by] == sorted((r.length for r in got), reverse=True)
    assert packing.op9_packing(spark, docs(spark).limit(0), PATH).count() == 0
