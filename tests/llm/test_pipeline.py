"""The pipeline's stages on planted documents, each against what it must do to them."""

import random

import pytest

import corpus_pipeline
from marlstone.llm import _base


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(120)) + "." for _ in range(120)]
    junk = [" ".join(f"{word().upper()}!! $$$" for _ in range(60)) for _ in range(60)]
    passage, item = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(40))
    texts = clean + junk + [clean[0], clean[1].replace(clean[1].split()[60], "changed"), f"{clean[2]} {passage} {clean[3][::-1]}", f"{clean[4][::-1]} {passage}", f"{clean[5][::-1]} {item}", None, ""]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, passage


def test_stages(spark, planted):
    path, texts, passage = planted
    docs, columns, kept = _base.table(spark, path, "documents"), ["doc_id", "text", "lang", "source", "n_chars"], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _base.written(stage(spark, docs, path))
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, near, repeats, leaks = kept
    assert sum(i in quality for i in range(120)) >= 118 and sum(i in quality for i in range(120, 180)) <= 2
    assert set(near) == set(quality) - {180, 181}
    changed = {i for i in repeats if repeats[i] != near[i]}
    assert changed == {182, 183} and set(near) - set(repeats) == set()
    assert passage in (repeats[182] or "") and passage not in repeats[183]
    assert set(leaks) == set(repeats) - {184}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in last} == set(leaks)


def test_run_on_empty_tables(spark, planted, tmp_path):
    path = planted[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
