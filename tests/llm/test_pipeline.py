"""The pipeline's stages on a small folder of tables."""

import random

import pytest

import corpus_pipeline
from basaltql.llm import bpe
from basaltql.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(700)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, passage = prose(30), prose(90)
    texts = [prose(120) for _ in range(120)]
    toxic = set(range(0, 120, 4))
    for i in toxic:
        texts[i] = texts[i].replace(" ", " schurke ", 1)
    texts[61] = texts[1]
    texts[62] = f"{prose(80)} {item} {prose(60)}"
    texts[63], texts[65] = f"{prose(40)} {passage}", f"{passage} {prose(50)}"
    folder = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, toxic, passage


def test_stages(spark, tables):
    folder, texts, toxic, passage = tables
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(range(120)) - toxic - {61, 62}
    codec = bpe.codec(*vocabulary())
    assert all(codec.decode(got[i]).decode() == texts[i] for i in got if i != 65)
    assert len(codec.decode(got[65]).split()) in range(50, 61)


def test_odd_rows(spark, tables, tmp_path):
    """Nulls, empty texts, repeated rows, extra and clashing columns; then empty tables."""
    folder, texts, toxic, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(500, None), (501, ""), (502, "  "), (None, texts[1]), (1, texts[1]), (1, texts[2]), (503, "one")]
    more = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in odd], docs.schema)
    from pyspark.sql import functions as F

    both = docs.unionByName(more).withColumns({c: F.lit("x") for c in ("gone_0", "key_0", "spots_0", "version", "ids")})
    both.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = [(r.doc_id, len(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = [i for i, _ in got]
    assert {500, 501, 502, 503, None} <= set(ids) and not toxic & set(ids) and {i: n for i, n in got}[500] == 0
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, docs.limit(0), folder)
        assert stages.columns == docs.columns and stages.count() == 0
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 11)]
