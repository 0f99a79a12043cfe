import random

from pyspark.sql import functions as F

from llm import simhash_golay as S
from llm._common import join_counted
from llm.shingle_jaccard import drop_similar, similar_documents
from tests.llm import brute


def test_all_pairs_of_the_similarity_are_linked(spark):
    rng, rows = random.Random(4), []
    passage = [f"p{k}" for k in range(40)]
    for base in range(8):
        words = [f"{base}w{rng.randrange(400)}" for _ in range(rng.choice([20, 60, 150]))] + passage
        for _ in range(25):
            w = words[:]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w[: len(w) - rng.randint(0, 12)])))
    rows += [(2000, None), (2001, " \n"), (2002, "A b c"), (2003, "a b C"), (2004, "a b"), (None, "a b c"), (None, "é z"), (2005, "w " * 9000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, print int")
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(brute.similar_classes(rows), key=key)
    assert sorted(((r.id, r.component_id) for r in similar_documents(docs).collect()), key=key) == want
    kept = drop_similar(docs)
    of_groups = {c for i, c in want if c is not None}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(of_groups)
    assert kept.where("doc_id is null").count() == len({t for i, t in rows if i is None} - {"a b c"})  # a text without an id stays unless it is like another
    assert similar_documents(docs.limit(0)).count() == 0


def test_pipeline_stage_takes_out_a_copy_with_a_changed_word(spark):
    from corpus_pipeline import near_dedup

    words = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, " ".join(words[:70]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(spark, docs, "").collect()) == [1, 3]


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    texts = [" ".join(f"{p}{k}" for k in range(30)) for p in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[3]), (None, texts[2])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _nth int")
    for kept in (drop_similar(docs), S.drop_near_duplicates(docs)):
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", texts[0]), ("None", texts[1]), ("5", texts[2]), ("5", texts[3])])


def test_a_key_that_many_rows_share_is_split_and_loses_none(spark):
    left = spark.createDataFrame([(k % 50 if k % 3 else 7, k) for k in range(9000)], "key int, v int")
    right = left.groupBy("key").count().withColumnRenamed("count", "rows").withColumn("w", F.col("key") * 2)
    got = join_counted(left, right, ["key"], "rows")
    assert got.columns == ["key", "v", "w"] and got.count() == 9000 and got.where("w != 2 * key").count() == 0 and got.select("v").distinct().count() == 9000
    assert join_counted(left.limit(0), right, ["key"], "rows").count() == 0


def test_many_copies_of_an_original_with_changes_of_their_own(spark):
    rng, original = random.Random(7), [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(original))]
    for i in range(1, 400):
        w = original[:]
        for _ in range(3):
            w[rng.randrange(120)] = f"x{i}y{rng.randrange(99)}"
        rows.append((i, " ".join(w[: 120 - rng.randint(0, 3)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.component_id) for r in similar_documents(docs).collect()) == sorted(brute.similar_classes(rows))
