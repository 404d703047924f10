import itertools
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tests.llm.test_decontaminate import brute as leaks  # noqa: E402
from tests.llm.test_line_dedup import brute as lines  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    w = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    item = " ".join(w[:20])
    texts = {
        1: " ".join(w[30:90]), 2: " ".join(w[30:90]), 3: " ".join(w[30:88] + ["changed", "ending"]), 4: None, 5: "123 456", 6: "alone " + item + " tail",
        7: " ".join(w[100:140]) + "\n" + " ".join(w[140:160]), 8: " ".join(w[200:240]) + "\n" + " ".join(w[140:160]), 9: "short", 10: " ".join(w[250:399]), 11: "",
    }
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(d, t) for d, t in texts.items() if re.search("[a-z]", t or "")]
    kept = [(d, t) for d, n, gone, t in lines(kept, corpus_pipeline.MIN_WORDS) if not gone or gone < n]
    sets = {d: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for d, t in kept for x in [t.lower().split()]}
    gone = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            gone.add(b)
    kept = [(d, t) for d, t in kept if d not in gone]
    bad = {d for d, _ in leaks(kept, [(0, item)])}
    kept = [(d, t) for d, t in kept if d not in bad]
    assert {d for d, _ in kept} == {1, 7, 8, 9, 10}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), COLUMNS)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(kept)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tests.llm.test_packing import encode

    assert {r.doc_id: r.doc_tokens for r in out} == {d: len(encode(t)) for d, t in kept}
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))


def test_later_copies_of_short_lines_go(spark):
    texts = {1: "All rights reserved\nfirst\n", 2: "second\nAll rights reserved\n", 3: "All rights reserved", 4: "\n\nfourth"}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: (texts[1], len(texts[1])), 2: ("second\n", 7), 4: (texts[4], len(texts[4]))}


def test_decisions_are_by_row(spark, tmp_path):
    w = [f"word{i}" for i in range(200)]
    one, other, item = " ".join(w[:60]), " ".join(w[60:120]), " ".join(w[120:140])
    rows = [(None, one), (5, one), (9, one), (9, other), (3, " ".join(w[152:190]) + " " + item), (3, w[150]), (None, item), (None, w[151]), (5, one)]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS)

    def left(out):
        return sorted(str((r.doc_id, r.text)) for r in out.collect())

    assert left(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))) == sorted(map(str, [(5, one), (9, other), *rows[4:8]]))
    assert left(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == sorted(map(str, [*rows[:4], rows[5], *rows[7:]]))


CLASHING = "row long, component_id string, key long, at string, gone int, _lines string, _deleted long, `_language_pred` string, `_language_score` int, pipeline_key int, line_dedup_key string, line_dedup_gone int, lines int, deleted int, `a.b` int, _text string"


def test_extra_columns_with_the_names_of_ours(spark, tmp_path):
    w = [f"word{i}" for i in range(200)]
    item = " ".join(w[120:140])
    texts = [(1, "a b c\n" + " ".join(w[:60])), (2, "a b c\n" + " ".join(w[:60])), (3, "first " + item), (4, None), (5, ""), (6, "lonely words"), (6, "lonely words"), (None, "no id")]
    extra = (7, "c", 8, "at", 9, "l", 10, "p", 11, 12, "k", 13, 14, 15, 16, "t")
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *extra) for d, t in texts], f"{COLUMNS}, {CLASHING}")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, str(tmp_path)).collect(), df.schema)
        seen.append(sorted((r.doc_id or 0, r.text) for r in df.collect()))
        assert all(tuple(r)[5:] == extra for r in df.collect())
    lonely, first, no_id = (6, "lonely words"), (3, "first " + item), (0, "no id")
    assert seen[0] == sorted([(1, texts[0][1]), (2, texts[1][1]), first, lonely, lonely, no_id])
    assert seen[1] == sorted([(1, texts[0][1]), first, lonely, lonely, no_id])
    assert seen[2] == sorted([(1, texts[0][1]), first, lonely, no_id])
    assert seen[3] == sorted([(1, texts[0][1]), lonely, no_id])
    assert {r.doc_id for r in corpus_pipeline.pack(spark, df, str(tmp_path)).collect()} == {None, 1, 6}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name
    one = spark.createDataFrame([(1, "a text", "en", "s", 6)], COLUMNS)
    assert corpus_pipeline.decontaminate(spark, one, str(tmp_path)).count() == 1


def test_stages_begin_with_memory_handed_back(spark, monkeypatch):
    from obsq.llm.common import hand_back

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans())
    before = count()
    hand_back(spark)
    assert count() > before

    class Begun(Exception):
        pass

    def begun(session):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "hand_back", begun)
    for _, step in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            step(spark, None, "")


def test_line_dedup_runs_no_python_on_executors(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "a b\nc", "en", "s", 5), (2, "a b\nd", "en", "s", 5)], COLUMNS)
    frame, groups = type(docs), type(docs.groupBy())
    used = []
    for of, names in ((frame, ("mapInArrow", "mapInPandas")), (groups, ("applyInPandas", "applyInArrow"))):
        for name in names:
            monkeypatch.setattr(of, name, lambda self, *a, _was=getattr(of, name), _name=name, **k: used.append(_name) or _was(self, *a, **k))
    assert sorted(r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()) == ["a b\nc", "d"]
    assert not used
    corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert "mapInArrow" in used  # the watch works, and other stages trim their workers
