import random

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path):
    r = random.Random(6)
    en = "river stone walks over green house morning light under small quiet road bread water window letter garden winter".split()
    de = "fluss stein geht über grün haus morgen licht unter klein ruhig straße brot wasser fenster brief garten winter".split()
    text = lambda words, n: " ".join(r.choices(words, k=n))
    rows = [(i, text(en if i % 3 else de, r.randint(20, 120)), "en" if i % 3 else "de", f"s{i % 4}", 0) for i in range(200)]
    item = text(en, 14)
    rows += [(500, rows[7][1], "en", "s1", 0), (501, rows[7][1] + " end", "en", "s1", 0), (502, text(en, 30) + " " + item + " " + text(en, 30), "en", "s2", 0),
             (503, None, "en", "s2", 0), (504, "12345 !!", "en", "s2", 0), (505, text(en, 40) + " password: hunter2hunter2 " + text(en, 5), "en", "s3", 0),
             (None, text(en, 40), "en", "s3", 0)]
    rows = [(*x[:4], None if x[1] is None else len(x[1])) for x in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows = write(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
        seen[name] = {x.doc_id: x for x in docs.collect()}
    every = {x[0] for x in rows}
    assert set(seen["language"]) == every - {503, 504}
    gone = set(seen["language"]) - set(seen["near_duplicates"])
    assert {500, 501} <= gone and 7 not in gone
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {502}
    assert set(seen["secrets"]) == set(seen["decontamination"])
    masked = seen["secrets"][505]
    assert "hunter2" not in masked.text and "[SECRET]" in masked.text and masked.n_chars == len(masked.text)
    assert all(seen["secrets"][i].text == seen["decontamination"][i].text for i in seen["secrets"] if i != 505)
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == set(seen["secrets"])
    assert sum(p.length for p in packed) == sum({p.doc_id: p.doc_tokens for p in packed}.values())
