"""The pipeline on a few documents whose fate is known."""

import random


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "sed", "ut", "magna"]) + rng.choice("abcdefgh") + rng.choice("ijkl") for _ in range(n))
    item, passage = prose(30), prose(60)
    docs = [(i, prose(100), "la", "s", 1) for i in range(20)]
    near = docs[3][1].split()
    near[50] = "changed"
    docs += [(100, " ".join(near), "la", "s", 1), (101, docs[4][1], "la", "s", 1), (102, "!!! 123", None, "s", 1), (103, None, "la", "s", None), (104, f"{prose(50)} {item} {prose(50)}", "la", "s", 1), (105, f"{prose(20)} {passage} {prose(9)}", "la", "s", 1), (106, f"{prose(20)} {passage} {prose(9)}", "la", "s", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r["doc_id"] for r in rows.collect()}
    clean = set(range(20)) | {105, 106}
    assert ids["language_id"] == clean | {100, 101, 104}
    assert ids["near_dedup"] == ids["substring_dedup"] == clean | {104}
    assert ids["decontamination"] == clean
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert passage in texts[105] and passage not in texts[106] and len(texts[106].split()) == 29
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == clean


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def staged(spark, rows, bench, tmp_path, name):
    """The rows of every stage, for documents with columns whose names the operators use themselves."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    clash = {"at": F.lit(3), "reference": F.lit(4), "row": F.lit(2), "family": F.lit(1), "component": F.lit(1), "length": F.lit(5), "rank": F.lit(6), "order": F.lit(8), "hashes": F.lit("h"), "score": F.lit(0.5), "words": F.lit("w"), "block": F.lit(0)}
    spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), {}
    for stage, function in corpus_pipeline.STAGES:
        got = function(spark, docs, f"{tmp_path}/{name}")
        assert stage == corpus_pipeline.STAGES[-1][0] or got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/{name}/{stage}")
        docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        out[stage] = docs.collect()
    return out


def test_stages_on_empty_tables(spark, tmp_path):
    assert all(rows == [] for rows in staged(spark, [], [], tmp_path, "none").values())
    text = " ".join(f"w{i}" for i in range(30))
    out = staged(spark, [(1, text, "la", "s", 1)], [], tmp_path, "no-items")
    assert all(len(rows) == 1 for rows in out.values())


def test_stages_without_a_language_with_repeats_nulls_and_long_texts(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    item, long_text = words(20), words(60_000)
    a, b = words(50), words(50)
    rows = [(1, a, None, "s", 1), (1, a, None, "s", 1), (2, a, None, "t", 1), (3, long_text, None, "s", 1), (4, None, None, None, None), (None, b, None, "s", 1), (None, b, None, "s", 1), (5, "", None, "s", 0), (6, "123 ...", None, "s", 1), (7, f"{words(40)} {item}", None, "s", 1)]
    out = staged(spark, rows, [(1, item), (2, None), (None, "  ")], tmp_path, "odd")
    # no row has a language: documents with a letter stay
    assert sorted(str(r["doc_id"]) for r in out["language_id"]) == sorted(map(str, [1, 1, 2, 3, None, None, 7]))
    # copies go, of rows of one id and text one stays
    assert sorted(str(r["doc_id"]) for r in out["near_dedup"]) == sorted(map(str, [1, 3, None, 7]))
    assert {r["text"] for r in out["substring_dedup"]} == {a, long_text, b, rows[-1][1]}
    assert sorted(str(r["doc_id"]) for r in out["decontamination"]) == sorted(map(str, [1, 3, None]))
    packed = out["best_fit_packing"]
    assert {str(r["doc_id"]) for r in packed} == {"1", "3", "None"} and max(r["length"] for r in packed) == 2048
    for r in packed:
        assert r["offset"] + r["length"] <= 2048
