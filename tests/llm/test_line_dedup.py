import random

import pytest

from obsq.llm.line_dedup import deduplicated, op4_line_dedup

SCHEMA = "doc_id long, text string, key string, at int, __x int"


def n_words(line):
    return 0 if line.strip(" ") == "" else line.count(" ") + 1


def brute(rows, least):
    """Every run with enough words, at every place, against all earlier ones."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: x[0])
    seen, gone = {}, {}
    for d, t in docs:
        lines = t.split("\n")
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(lines[s:e])
                if sum(map(n_words, run)) >= least:
                    if run in seen:
                        gone.setdefault(d, set()).update(range(s, e))
                    else:
                        seen[run] = (d, s)
    return sorted((d, 0 if t is None else len(t.split("\n")), len(gone.get(d, ())), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))) for d, t in rows)


def some(seed, n=40):
    r = random.Random(seed)
    pool = [" ".join(r.choices("abcdefgh", k=r.choice([1, 2, 3, 4, 12]))) for _ in range(25)] + ["", " "]
    passages = [r.choices(pool, k=r.randint(2, 9)) for _ in range(4)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(r.randint(0, 5)):
            lines += r.choice(passages) if r.random() < 0.4 else [r.choice(pool)] if r.random() < 0.5 else [" ".join(f"u{r.random()}" for _ in range(r.randint(1, 12)))]
        rows.append((d, "\n".join(lines)))
    return rows + [(100, rows[0][1]), (101, "x " * 30000), (102, "x " * 30000), (103, "a\n" * 40)]


@pytest.mark.parametrize("seed,least", [(1, 10), (2, 5), (3, 1), (4, 25)])
def test_equals_brute_force(spark, seed, least):
    rows = some(seed)
    got = op4_line_dedup(spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], SCHEMA).repartition(4), least)
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_odd_rows(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(None, long), (4, long), (4, long), (2, None), (3, ""), (6, long + "\nmore"), (6, "other")]
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], SCHEMA)
    got = deduplicated(df)
    assert got.columns == df.columns + ["_lines", "_deleted"]
    assert sorted(str((r.doc_id, r.text, r._lines, r._deleted)) for r in got.collect()) == sorted(map(str, [(None, "", 1, 1), (4, long, 1, 0), (4, long, 1, 0), (2, None, 0, 0), (3, "", 1, 0), (6, "more", 2, 1), (6, "other", 1, 0)]))
    assert op4_line_dedup(df.limit(0)).count() == 0
