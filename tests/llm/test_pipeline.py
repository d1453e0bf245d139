"""The stages on a small table, against what each operator alone decides."""

import corpus_pipeline as P
from tangentia.llm.jaccard_join import jaccard_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf).cache()
        seen.append(docs.count())
        if name == "near_duplicates":
            alone = jaccard_components(before, 5, 80, 100).filter("component_id = doc_id").count()
            assert docs.count() == alone
        if name != "sentencepiece":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.rdd, docs.schema)
    assert all(a >= b > 0 for a, b in zip(seen, seen[1:]))
    assert docs.columns == ["doc_id", "piece_ids", "n_pieces", "round_trip"] and docs.filter("not round_trip").count() == 0


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def ids(df):
    return sorted(r["doc_id"] or 0 for r in df.collect())


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (3, None), (None, "x y"), (4, ""), (4, ""), (None, text), (None, "x y"), (None, "p q r"), (7, "x y"), (8, "u v w"), (8, "v w x")]
    docs = spark.createDataFrame([(i, t, "en", "a", 5) for i, t in rows], KIND)
    assert ids(P.near_duplicates(spark, docs, "")) == [0, 1, 3, 4, 7, 8, 8]
    assert P.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_leaks_with_null_and_shared_ids(spark, tmp_path):
    passage = " ".join(f"b{k}" for k in range(30))
    spark.createDataFrame([(1, passage), (None, passage + " end of it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, passage), (None, "clean text of one"), (7, passage + " and more"), (7, "clean text of seven"), (8, None), (8, ""), (9, "x " + passage)]
    docs = spark.createDataFrame([(i, t, "en", "a", 5) for i, t in rows], KIND)
    out = P.decontaminate(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "clean text of one"), (7, "clean text of seven"), (8, ""), (8, "")]
    assert out.columns == docs.columns
    assert P.decontaminate(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_other_stages_of_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (2, long + " tail"), (None, long), (3, long), (4, None), (5, ""), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 5) for i, t in rows], KIND)
    assert P.toxicity(spark, docs, str(tmp_path)).count() == len(rows)
    out = {(r["doc_id"], r["text"]): r["n_chars"] for r in P.substrings(spark, docs, "").collect()}
    assert out == {(1, long): 5, (2, "tail"): 4, (None, long): 5, (4, None): 5, (5, ""): 5, (6, " "): 5}
    last = P.pieces(spark, docs, "").collect()
    assert len(last) == len(rows) and all(r["round_trip"] for r in last)
    for stage in (P.toxicity, P.substrings, P.pieces):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for c in ("row_key", "place", "score", "spans", "component_id", "n_words", "rid"):
        docs = docs.withColumn(c, P.F.lit("own"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
