"""Ids and long columns stay exact beside nulls, in every operator and stage; samples with repeated texts; clashing names."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rulelake.llm import decontaminate, fertility, instances, language, packing, repeats, resample, secrets, signature

BIG = 1 << 53
LONG = "the stone by the water and the light of winter gardens with letters on it " * 14
ROWS = [(None, "no id at all but a text"), (BIG, "first " + LONG), (BIG + 1, "Completely other words stand here, none shared. " + LONG[300:700]), (BIG + 3, None), (-BIG - 1, "short one")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


OPERATORS = {
    "op1": lambda d: packing.pack(d.withColumn("source", F.lit("a"))),
    "op3": lambda d: signature.similar_groups(d, 3, 90),
    "op4": lambda d: language.identify(d, language.train(d.withColumn("lang", F.lit("en")))),
    "op5": lambda d: fertility.rules(d),
    "op7": lambda d: decontaminate.contamination(d, d.select(F.lit(1).alias("item_id"), "text")),
    "op9": lambda d: secrets.scan(d),
    "op10": lambda d: repeats.remove_repeats(d),
    "op11": lambda d: instances.scores(d, None),
    "op12": lambda d: resample.resample(d, d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_beside_a_null(docs, name):
    assert {r.doc_id for r in OPERATORS[name](docs).select("doc_id").collect()} == {i for i, _ in ROWS}


def test_ids_that_differ_in_the_last_bit_are_two_documents(spark):
    rows = [(None, "x"), (BIG, LONG), (BIG + 1, "other " + LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    removed = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    alone = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs.where("doc_id IS NOT NULL")).collect()}
    assert removed == alone | {None: 0} and removed[BIG + 1] > removed[BIG] and removed[BIG + 1] >= len(LONG)
    apart = spark.createDataFrame([(None, "x"), (BIG, LONG), (BIG + 1, "quite another text without any of these shingles in it at all")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in signature.similar_groups(apart, 3, 90).collect()} == {None: None, BIG: BIG, BIG + 1: BIG + 1}


WIDE = ("doc_id long, text string, lang string, source string, n_chars long, extra long, small int, flag boolean, at timestamp, on date, price decimal(20,2), "
        "tags array<long>, gone long, key long, twice long, c0 long")


def wide(spark, ids=None):
    r = []
    for i in range(12):
        t = None if i == 5 else " ".join(f"{w}{i}" if k % 3 else w for k, w in enumerate(LONG.split()[:60]))
        null = i % 4 == 0
        r.append((BIG + i if ids is None else ids[i], t, "en", "s", None if null else len(t or ""), None if null else BIG + 1 + i, None if null else i, None if null else i % 2 == 0, dt.datetime(2300, 1, 1, 3, 4, 5, i),
                  dt.date(1, 1, 1), decimal.Decimal("123456789012345678.90"), [BIG + i, None], BIG + i, i, None, 7))
    return spark.createDataFrame(r, WIDE).coalesce(1)


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES[:-1]])
@pytest.mark.parametrize("repeated", [False, True])
def test_stages_leave_all_columns_as_they_are(spark, tmp_path, stage, repeated):
    docs = wide(spark, [BIG + i // 2 if i < 4 else BIG + i for i in range(12)] if repeated else None)
    spark.createDataFrame([(1, "nothing that occurs in these documents anywhere at all you see")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    out = dict(pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = out.collect()
    assert all(before[r.doc_id, r.text] == r for r in kept) and len(kept) == (11 if stage == "language" else 12)


def test_masked_texts_count_their_characters_exactly(spark):
    docs = spark.createDataFrame([(BIG + 1, "password = abcdefgh12345 end", BIG + 1), (None, None, None)], "doc_id long, text string, n_chars long").coalesce(1)
    assert sorted(map(tuple, secrets.masked(docs).collect()), key=repr) == sorted([(BIG + 1, "[SECRET] end", 12), (None, None, None)], key=repr)


def test_samples_are_bounded_and_never_empty_with_repeated_texts(spark):
    same = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the water and the stone").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(60_000).select((F.col("id") + 100_000).alias("doc_id"), F.lit("das wasser und der stein").alias("text"), F.lit("de").alias("lang"))
    model = language.train(same.unionByName(other), rows=200)
    assert model.predict(["stone and water", "wasser und stein"])[0] == ["en", "de"]
    assert abs(secrets.train(same.withColumn("doc_id", F.lit(None).cast("long")), sample=50)).sum() > 0
