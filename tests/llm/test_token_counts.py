import random

import pytest

from obsq.llm import queries
from obsq.llm.token_counts import LongestMatch, op8_token_counts, sentence_pieces

SCHEMA = "doc_id long, text string, n_words string"


def greedy(first, rest, word):
    at, n = 0, 0
    while at < len(word):
        entries = rest if at else first
        end = max((e for e in range(at + 1, len(word) + 1) if word[at:e] in entries), default=0)
        if not end:
            return 0
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_equals_greedy_longest_match(seed):
    r = random.Random(seed)
    letters = "abc"[: r.randint(1, 3)]
    some = lambda: {"".join(r.choices(letters, k=r.randint(1, 5))) for _ in range(r.randint(1, 12))}
    first, rest = some(), some()
    m = LongestMatch(first, rest)
    for _ in range(400):
        word = "".join(r.choices(letters + "d" * (r.random() < 0.1), k=r.randint(1, 12)))
        assert m.count(word) == greedy(first, rest, word), (first, rest, word)


def test_over_a_table(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    m = sentence_pieces(path)
    texts = ["The quick brown\tfox", None, "", " \n", "naïve façade 你好 \U0001f600 " * 3, "x" * 201 + " y", "word " * 20000]
    want = []
    for d, t in enumerate(texts):
        n = [m.count(w) if len(w) <= 200 else 0 for w in (t or "").split()]
        want.append((d, len(n), sum(max(x, 1) for x in n), n.count(0)))
    df = spark.createDataFrame([(d, t, "x") for d, t in enumerate(texts)] + [(3, texts[3], "y")], SCHEMA)
    assert sorted(map(tuple, op8_token_counts(df, path).collect())) == sorted([*want, want[3]])
    assert op8_token_counts(df.limit(0), path).count() == 0


def test_the_query_counts_words_of_any_length(spark, tmp_path):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    first, rest = {p[1:] for p in plain if p.startswith("▁")}, {p for p in plain if not p.startswith("▁")}
    most = max(map(len, first | rest))

    def pieces(word):
        at = n = 0
        while at < len(word):
            at = max(e for e in range(at + 1, min(len(word), at + most) + 1) if word[at:e] in (rest if at else first))
            n += 1
        return n

    long = ["x" * 201, "".join(random.Random(1).choices("abcdefghij0123", k=100_000))]
    spark.createDataFrame([(d, f"{w} y", "x") for d, w in enumerate(long)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op8_token_counts(spark, str(tmp_path)).collect()))
    assert got == [(d, 2, pieces(w) + pieces("y"), 0) for d, w in enumerate(long)]
