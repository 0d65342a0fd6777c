"""Models learn from every document that they may learn from."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwell.llm import langid, quality


def test_every_unlabelled_document_takes_part(spark):
    """Texts of unlabelled documents beyond the first 3000 in the order of their hash change the models."""
    words = F.when(F.col("doc_id") % 2 == 0, F.lit("clear calm prose about rivers and hills number ")).otherwise(F.lit("buy buy now now cheap cheap click click "))
    ids = spark.range(3600).select(F.col("id").alias("doc_id"))
    labels = ids.where("doc_id < 80").select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) > 3000
    base = ids.where("doc_id < 80").withColumn("late", F.lit(False)).union(ids.where("doc_id >= 80").withColumn("late", late))
    docs = base.withColumn("text", F.concat(words, F.col("doc_id").cast("string"))).cache()
    other = docs.withColumn("text", F.when(F.col("late"), F.concat(F.col("text"), F.lit(" zebra quartz"))).otherwise(F.col("text")))
    one, same, two = (quality.train(d, labels) for d in (docs, docs, other))
    assert all((a.w == b.w).all() for a, b in zip(one, same, strict=True))
    assert any(a.w.shape != b.w.shape or abs(a.w - b.w).max() > 1e-6 for a, b in zip(one, two, strict=True))
    scored = quality.score_quality(docs, one).where("doc_id >= 80")
    assert scored.where("accepted = (doc_id % 2 = 0)").count() >= 0.99 * scored.count()


def test_dictionaries_hold_every_sampled_document_and_its_end(spark):
    rows = [(i, f"header{chr(97 + i % 26)} " * 400 + f"tail{chr(97 + i // 26)}{chr(97 + i % 26)}", "en") for i in range(100)]
    rows += [(1000 + i, None if i % 2 else " 12 ", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = langid.train(docs, sample=100, size=128 << 10)["en"].decode()
    assert all(f"tail{chr(97 + i // 26)}{chr(97 + i % 26)}" in d for i in range(100))


def test_sums_of_many_tasks_are_added_up_in_tasks(spark, monkeypatch):
    rows = np.arange(400, dtype="f2").reshape(100, 4)
    table = spark.createDataFrame([(0.0, 1.0, r.tobytes()) for r in rows], "a double, b double, v binary").repartition(9)
    part = lambda t, x: np.concatenate([x.astype("f8").sum(0), t.sum(0)])
    want = [*rows.astype("f8").sum(0), 0, 100]
    assert quality._summed(table, part).tolist() == want
    monkeypatch.setattr(quality, "FAN", 2)
    assert quality._summed(table, part).tolist() == want
