import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from obsq.llm.components import components
from obsq.llm.ngram_join import JaccardJoin, Scheme, op3_ngram_join, shingle_sets

SCHEMA = "doc_id long, text string, key string, node int"


def sets_of(texts, n=4):
    out = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute(texts):
    s = sets_of(texts)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        i = len(s[a] & s[b])
        if i and 100 * i >= 85 * (len(s[a]) + len(s[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(v), find(d)) for d, v in s.items()}


def near_copies(seed, families=12, most=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "É", "é", "The"]
    out, d = [], 100
    for _ in range(families):
        base = r.choices(words, k=r.choice([2, 3, 4, 5, 9, 30, 120, 300, 700]))
        for _ in range(r.randint(1, most)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = r.choices(words, k=r.randint(0, 2))
            out.append((d, r.choice([" ", "\n", "  "]).join(w)))
            d += r.randint(1, 3)
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = near_copies(seed) + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "x " * 9000), (9, "x " * 12000)]
    got = op3_ngram_join(spark.createDataFrame([(d, t, "k", 1) for d, t in texts], SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(JaccardJoin, "FEW", 3)
    monkeypatch.setattr(JaccardJoin, "BLOCK", 4)
    texts = near_copies(7, 6, 60)
    got = op3_ngram_join(spark.createDataFrame([(d, t, "k", 1) for d, t in texts], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_odd_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, None)]
    got = op3_ngram_join(spark.createDataFrame([(d, t, "k", 1) for d, t in rows], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (None, 0, None)]))
    assert op3_ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similar_sets_share_a_signature():
    r, scheme = np.random.default_rng(5), Scheme(85, 100)
    for size in [*range(7, 60), 100, 237, 1000]:
        for _ in range(6):
            both = r.integers(0, 1 << 63, size * 2, dtype=np.uint64)
            drop = int(r.integers(0, size * 15 // 100 + 1))
            a = np.sort(both[:size])
            more = size * 100 // 85 - size
            b = np.sort(both[drop:size]) if r.random() < 0.5 else np.sort(both[: size + int(r.integers(0, more + 1))])
            if r.random() < 0.4:  # substitutions
                x = int(size * 15 / 185)
                b = np.sort(np.concatenate((both[x:size], both[size : size + x])))
            o = len(np.intersect1d(a, b))
            assert 100 * o >= 85 * (len(a) + len(b) - o)
            row, key = scheme.signatures(2, np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)))
            assert np.array_equal(a, b) or np.intersect1d(key[row == 0], key[row == 1]).size


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, x) for x in range(5001, 5100)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)}}


def test_sets_are_whole_and_distinct():
    texts = ["a b c d e", None, "A b  c\td\ne a b c d", "x", ""]
    n = np.zeros(5, int)
    for first, rows, at, h in shingle_sets(pa.array(texts), 4):
        n[first : first + rows] = np.bincount(at, minlength=rows)
    assert n.tolist() == [2, 0, 5, 1, 0]


def test_words_that_clash_in_polynomial_hashes(spark):
    from tests.llm.test_tokenise import thue_morse

    a, b = thue_morse(1024, 0), thue_morse(1024, 1)
    rows = [(1, a), (2, b), (3, f"{a} one two three"), (4, f"{b} one two three")]
    got = op3_ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_sketches_never_differ_by_more_than_the_sets():
    from obsq.llm.ngram_join import sketch_distance, sketches

    r = np.random.default_rng(3)
    for n in (1, 5, 60, 200, 900, 9000):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        for part in (0.0, 0.1, 0.3, 1.0):
            b = a.copy()
            b[: int(n * part)] = r.integers(0, 1 << 63, int(n * part)).astype(np.uint64)
            b = np.unique(b[: max(1, int(n * r.uniform(0.5, 1)))])
            at = np.repeat([0, 1], [n, len(b)])
            made = [np.frombuffer(x.as_py(), np.uint8)[None, :] for x in sketches(np.arange(2), at, np.concatenate((np.sort(a), b)), 2)]
            far = len(set(a.tolist()) ^ set(b.tolist()))
            assert sketch_distance(*made)[0] <= far
            if part == 1.0 and n > 60:
                assert sketch_distance(*made)[0] > (n + len(b)) / 9


def test_order_in_one_integer_is_that_of_lexsort():
    from obsq.llm.ngram_join import _order

    r = np.random.default_rng(8)
    for bits in (0, 3, 12, 41):
        for last in (r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), r.integers(0, 90, 5000).astype(np.uint64)):
            a, b = r.integers(0, 1 << bits, 5000), r.integers(0, 4, 5000)
            got, want = _order([(a, bits), (b, 2)], last), np.lexsort((last, b, a))
            assert all(np.array_equal(z[got], z[want]) for z in (a, b, last))


def test_coarse_sketches_go_first_and_tell_no_similar_pair_apart(monkeypatch):
    import pandas as pd

    from obsq.llm import ngram_join

    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, int(r.integers(500, 560))).astype(np.uint64)) for _ in range(60)]
    sets += [s[: len(s) * 93 // 100] for s in sets[:10]] + [sets[0][:40], sets[0][:38], np.repeat(sets[1][:1], 1)]
    size = np.array([len(s) for s in sets])
    sketch = pd.Series(ngram_join.sketches(np.arange(len(sets)), np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets)).to_pylist())
    sketch[5] = None
    x, y = np.triu_indices(len(sets), 1)
    plain = np.array([a == 5 or b == 5 or abs(np.frombuffer(sketch[a], np.uint8).reshape(-1, w).sum(0).astype(int) - np.frombuffer(sketch[b], np.uint8).reshape(-1, w).sum(0)).sum() <= (size[a] + size[b]) * 15 // 185 for a, b in zip(x, y) for w in [min(len(sketch[a] or b"x" * 64), len(sketch[b] or b"x" * 64))]])
    seen, was = [], ngram_join.sketch_distance
    monkeypatch.setattr(ngram_join, "sketch_distance", lambda a, b: seen.append(a.size) or was(a, b))
    keep = ngram_join.near_by_sketches(sketch, size, x, y, 85, 100)
    similar = np.array([100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (size[a] + size[b] - o) for a, b in zip(x, y)])
    assert similar.sum() >= 10 and not (similar & ~keep).any()
    assert not (keep & ~plain).any()  # at least as sharp as the whole sketches alone
    assert sum(seen) < 1.5 * 64 * len(x)  # whole ones would be 256 or 512 bins a pair
