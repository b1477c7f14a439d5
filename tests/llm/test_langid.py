from pyspark.sql import functions as F

from tripleweave.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op4_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, good, kept, kept_good = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum((~F.col("rejected")).cast("int")), F.sum((~F.col("rejected") & (F.col("lang") == F.col("lang_pred"))).cast("int"))).first()
    assert n > 150 and good / n > 0.97 and kept / n > 0.97 and kept_good / kept > 0.985


def test_held_out_rows_are_not_learned_from(spark, table):
    import zlib

    rows = [(i, "held " * 50 if zlib.crc32(str(i).encode()) % 5 == 0 else "learned words here " * 20, "a", "xx") for i in range(200)]
    model = langid.fit(table(rows).where(~langid.held_out()))
    assert list(model.dictionaries) == ["xx"] and b"held" not in model.dictionaries["xx"]


def test_edges(spark, table, edge_rows):
    docs = table([*edge_rows, (50, "the cat and the dog and the house " * 40, "a", "en"), (51, "le chat et la maison et le chien " * 40, "a", "fr"), (52, "the lang is null", "a", None), (53, "½² Ⅷ 12", "a", "en")])
    model = langid.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (None, "und"), (53, "und"), (50, "en"), (51, "fr")} <= set(got)
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["rejected"]) for r in got.values())
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {50, 51} <= {r["doc_id"] for r in kept.collect()} and not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}


def test_empty(spark, table):
    model = langid.fit(table([]))
    assert model.dictionaries == {} and langid.identify(table([]), model).count() == 0
    assert langid.identify(table([(1, "words")]), model).first()["lang_pred"] == "und"


def test_labels_are_no_input(spark, table):
    rows = [(1, "the cat and the dog " * 30, "a", "en"), (2, "le chat et la maison " * 30, "b", "fr")]
    model = langid.fit(table(rows))
    swapped = table([(1, rows[0][1], "zz", "fr"), (2, rows[1][1], None, None)])
    assert sorted(map(tuple, langid.identify(table(rows), model).collect())) == sorted(map(tuple, langid.identify(swapped, model).collect()))
