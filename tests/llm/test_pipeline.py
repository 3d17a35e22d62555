"""The pipeline's stages, each against a plain version on its own input."""

import brute
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"passage{k}" for k in range(5, 30))), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, tables):
    import corpus_pipeline as c
    from slidespark.llm.toxicity import fit

    stages = dict(c.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    bench = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]

    out = stages["toxicity"](spark, docs, tables)
    model = fit(docs, labels)
    assert out.dtypes == docs.dtypes
    assert pairs(out) == sorted((r for r in pairs(docs) if model.score([(r[1] or "").encode()])[0] < 0.7), key=str)

    out = stages["line_dedup"](spark, docs, tables)
    assert out.dtypes == docs.dtypes
    plain = brute.op2(pairs(docs))
    assert sorted((i, brute.sha(t or "")) for i, t in pairs(out)) == sorted((r[0], r[3]) for r in plain)
    assert out.where(F.coalesce("n_chars", F.lit(0)) != F.coalesce(F.length("text"), F.lit(0))).count() == 0

    out = stages["jaccard_join"](spark, docs, tables)
    assert out.dtypes == docs.dtypes
    keep = {i for i, _, c_ in brute.op5(pairs(docs), 5, 80, 100) if i == c_}
    assert pairs(out) == [r for r in pairs(docs) if r[0] in keep]

    out = stages["decontamination"](spark, docs, tables)
    assert out.dtypes == docs.dtypes
    bad = {r[0] for r in brute.op8(pairs(docs), bench) if r[5]}
    assert bad and pairs(out) == [r for r in pairs(docs) if r[0] not in bad]

    packed = stages["packing"](spark, docs, tables)
    assert packed.count() >= docs.count()


def test_run(spark, tables):
    import corpus_pipeline as c

    out = c.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 20


def test_entry():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
