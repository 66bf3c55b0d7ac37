"""The pipeline's stages, one by one, on small tables."""

import os

import corpus_pipeline as P
from cases import PLAIN, documents, groups, odd_texts
from test_classifiers import corpus

from oddglass.llm import common


def tables(spark, place):
    docs, toxic, good = corpus(240, 5)
    docs += [(1000 + i, t) for i, (_, t) in enumerate(odd_texts())] + [(2000, "start " + PLAIN + " unlike words follow it here to the end of all")]
    frame = documents(spark, docs)
    frame.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, q, t) for (i, _), t, q in zip(docs, toxic, good)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, PLAIN), (2, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return docs, toxic


def test_stages(spark, place):
    docs, toxic = tables(spark, place)
    frame = common.table(spark, place, "documents")
    texts = dict(docs)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dups", "decontam", "secrets", "bpe"]
    kept = {r.doc_id for r in P.toxicity(spark, frame, place).collect()}
    bad = {i for i in range(240) if toxic[i]}
    assert len(bad & kept) <= 0.1 * len(bad) and len(kept - bad) >= 0.97 * (len(docs) - len(bad))
    left = {r.doc_id for r in P.near_duplicates(spark, frame, place).collect()}
    assert left == {i for i, c in groups(docs).items() if i == c}
    clean = {r.doc_id for r in P.decontaminate(spark, frame, place).collect()}
    assert {2000, 1000, 1001, 1002} & clean == set() and {i for i in range(240)} <= clean
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, frame, place)
        assert out.columns == frame.columns, name
    end = P.run(spark, place).collect()
    ids = {r.doc_id for r in end}
    assert len(ids) == len(end) and ids <= set(texts) and 2000 not in ids and len(ids & set(range(240))) > 160


def test_empty_tables(spark, place):
    documents(spark, []).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    assert P.run(spark, place).count() == 0


def test_guard_and_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(P.__file__)
