from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.helpers import frame, prose
from tests.llm.test_langid import PARTS, text

import random


def corpus(spark):
    rng = random.Random(6)
    texts, langs, sources = [], [], []
    for j in range(200):
        lang = rng.choice(list(PARTS))
        texts.append(text(lang, 60, rng))
        langs.append(lang)
        sources.append("hot" if j % 3 else rng.choice("abc"))
    texts += [texts[0], texts[1] + " end", "token=abcdefgh123 " + text("en", 40, rng), None, "123 456"]
    langs += [langs[0], langs[1], "en", None, "en"]
    sources += ["hot"] * 5
    return frame(spark, texts, langs=langs, sources=sources), texts


def test_stages(spark, tmp_path):
    docs, texts = corpus(spark)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, seen[-1], None).write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(d.columns == docs.columns for d in seen[:-1])
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert sorted(ids[1]) == [i for i in range(len(texts)) if i not in (203, 204)]  # null text, no letter
    assert sorted(ids[2]) == [i for i in sorted(ids[1]) if i not in (200, 201)]  # copies
    assert sorted(ids[3]) == sorted(ids[2])
    clean = {r.doc_id: r.text for r in seen[3].collect()}
    assert "abcdefgh123" not in clean[202] and clean[202].startswith("[SECRET]") and clean[5] == texts[5]
    assert set(ids[4]) == set(ids[3]) and max(Counter(ids[4]).values()) <= 2
    fill = defaultdict(int)
    for r in seen[5].collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and set(ids[5]) == set(ids[4])


def test_run(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_prose_is_deterministic():
    assert prose(5, 1) == prose(5, 1)


def test_empty_and_odd_tables(spark, tmp_path):
    from tests.llm.helpers import odd_texts

    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    texts = [*odd_texts(), "one more text of a few words"]
    frame(spark, texts, ids=[*range(len(texts) - 2), None, 5], langs=[None] * len(texts)).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    lettered = {i for i, t in enumerate(texts[:-2]) if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in rows} - {None} == lettered - {6}  # 6 repeats 5; without labels nothing else is rejected
