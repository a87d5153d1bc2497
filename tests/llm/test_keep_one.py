from collections import Counter

from lattiq.llm import jaccard_join


def text(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def kept(spark, docs):
    return Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_different_texts_of_null_and_repeated_ids_all_stay(spark):
    docs = [(None, text("a")), (None, text("b")), (0, text("c")), (7, text("d")), (7, text("e")), (8, text("f")), (None, None), (7, "")]
    assert kept(spark, docs) == Counter(docs)


def test_copies_of_null_and_repeated_ids_go(spark):
    near = text("a", 60)
    docs = [(None, text("b")), (None, text("b")), (0, text("c")), (5, text("c")), (7, near), (7, near + " z"), (7, text("d")), (9, near), (3, text("e")), (3, text("f"))]
    got = kept(spark, docs)
    assert sum(n for (i, t), n in got.items() if t.startswith("a0 ")) == 1 and got[9, near] == 0
    assert got[None, text("b")] == got[0, text("c")] == got[7, text("d")] == got[3, text("e")] == got[3, text("f")] == 1 and sum(got.values()) == 6


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, text("a"), 5, "x", None), (2, text("a"), 6, "y", 1.0), (3, text("b"), 7, "z", 2.0)], "doc_id long, text string, __d int, __H string, comp double")
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_no_table_of_a_step_is_left(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    jaccard_join.linked_groups(spark.createDataFrame([(1, text("a")), (2, text("a") + " z"), (3, text("b"))], "doc_id long, text string")).collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert left <= {"features", "classes", "components", "shared", "apart"}, left
