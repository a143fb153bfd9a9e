"""The pipeline's stages keep what they should, on tables with odd rows."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(1)
    sentence = lambda n: " ".join("".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, sentence(30)) for i in range(5)]
    texts = {i: "\n".join(sentence(20) for _ in range(4)) for i in range(120)}
    for i in range(0, 60, 4):
        texts[i] = texts[i].replace(" ", " vileword ", 3)
    texts[200] = texts[61]
    texts[201] = f"{sentence(40)}\n{items[2][1]}\n{sentence(40)}"
    texts[202] = None
    texts[203] = ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i < 60 and i % 4 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    import corpus_pipeline as pipeline

    docs = pipeline.table(spark, folder, "documents")
    seen = []
    for name, stage in pipeline.STAGES:
        before = docs.columns
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: r for r in docs.collect()})
        assert name == pipeline.STAGES[-1][0] or docs.columns == before
    toxic = {i for i in range(0, 60, 4)}
    clean = {i for i in range(120)} - toxic
    assert len(toxic & set(seen[0])) <= 2 and clean <= set(seen[0])
    assert set(seen[1]) == set(seen[0]) and seen[1][200].text == "" and seen[1][61].n_chars == len(seen[1][61].text)
    assert seen[1][202].text is None
    assert set(seen[1]) - set(seen[2]) == {202, 203}  # as empty as 200, the first of them
    assert set(seen[2]) - set(seen[3]) == {201}
    assert clean <= set(seen[4]) and all(r.decoded_equal for r in seen[4].values())


def test_run(spark, folder):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, folder).count() > 90
