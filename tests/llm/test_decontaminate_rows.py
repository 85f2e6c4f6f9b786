"""Whole rows pass through decontamination with their texts once, in one pass or several, whatever the text's type."""

from pyspark.sql import functions as F

from cairn.llm import decontaminate


def inputs(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, 5, " ".join(words)), (2, 6, "one two"), (None, 7, None), (3, 8, " ".join(words[10:25])), (3, 9, "x " + " ".join(words[5:14]))]
    docs = spark.createDataFrame(rows, "doc_id long, n int, text string").repartition(2)
    return docs, spark.createDataFrame([("a", " ".join(words[8:20])), ("b", "one two"), ("c", " ".join(words[22:36]))], "item_id string, text string"), rows


def test_a_text_travels_once(spark):
    docs, bench, _ = inputs(spark)
    found = decontaminate.contamination(docs, bench, rest=True)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("cast(text") == 0
    assert found.columns == ["doc_id", "n_words", "spans", "items", "row"]


def test_rows_pass_whole(spark):
    docs, bench, rows = inputs(spark)
    for block in (12, 1_000_000):
        kept = decontaminate.decontaminate(docs, bench, block_words=block)
        assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[2], rows[4]], key=str)
        as_bytes = decontaminate.decontaminate(docs.withColumn("text", F.col("text").cast("binary")), bench, block_words=block)
        assert sorted(r.n for r in as_bytes.collect()) == [7, 9]
