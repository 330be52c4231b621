from pyspark.sql import functions as F

from creditlake.llm import sampling as S


def test_an_id_with_many_rows_gives_one(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(200)] + [(i, f"other {i}") for i in range(8, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 20)] * 2, "doc_id long, y int")
    got = S.labelled(docs, labels, "y", F.lit(True), 13, F.col("text")).collect()
    assert sorted(r.doc_id for r in got) == list(range(7, 20)) and all(r.y == r.doc_id % 2 for r in got)
    # one id's labels, however many
    for one in range(8):
        df = spark.createDataFrame([(one, f"text {i}") for i in range(50)], "doc_id long, text string")
        labels = spark.createDataFrame([(one, 1)] * 100, "doc_id long, y int")
        assert S.labelled(df, labels, "y", F.lit(True), 5, F.col("text")).count() == 1
