import corpus_pipeline
from trendloom.llm.graph import components, stored


def test_stages_take_effect(spark, tmp_path):
    good = [" ".join(f"g{i}n{k}" for k in range(120)) for i in range(60)]
    item = " ".join(f"bench{k}" for k in range(20))
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(74, good[4].replace("g4n", "q4n") + " What IS the unit of heat? " + good[4].replace("g4n", "p4n")), (75, good[6].replace("g6n", "q6n") + " in the end " + good[6].replace("g6n", "p6n"))]
    rows += [(70, good[0]), (71, good[1] + " more"), (72, good[2][:700] + " " + " ".join(f"z{k}" for k in range(300))), (73, good[3].replace("g3", "h3") + " " + item)]
    toxic = [(100 + i, " ".join(f"t{i}m{k}" for k in range(30)) + " vermin scum") for i in range(20)]
    all_rows = [(i, t, "en", "s", len(t)) for i, t in rows + toxic] + [(None, None, None, None, None)]
    spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, *_ in all_rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "what is the unit of heat"), (3, "in the end")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert not [i for i in seen[0] if i is not None and i >= 100] and None in seen[0]
    assert 70 not in seen[1] and 71 not in seen[1] and len(seen[1]) == 65
    assert seen[2][72]["text"].startswith("g2n11 z0") and seen[2][5]["text"] == good[5]
    assert "bench3" not in seen[3][73]["text"] and seen[3][73]["n_chars"] == len(seen[3][73]["text"])
    assert "unit" not in seen[3][74]["text"] and "p4n1 " in seen[3][74]["text"] and seen[3][75]["text"] == rows[61][1]  # a short item goes, a phrase of three words stays
    assert set(seen[4]) == set(seen[3]) and seen[4][None]["n_tokens"] == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["label"] for r in components(spark, edges).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_stages_keep_columns_that_operators_use_as_names(spark, tmp_path):
    names = ("n_words", "n_removed", "kept", "n_hit", "items", "spans", "score", "id", "size")
    rows = [(i, " ".join(f"k{i % 5}n{j}" for j in range(70 + i)), "en", "s", 7, *[f"{n}{i}" for n in names]) for i in range(12)] + [(3, "again " * 60, None, None, None, *[None] * len(names))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(1, " ".join(f"k1n{j}" for j in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == spark.createDataFrame([], schema).columns
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes
            for r in docs.where("doc_id <> 3").collect():
                assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
        assert stored(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), "ids").count() == docs.count()
