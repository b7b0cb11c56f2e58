"""A corpus of a few chunks that several tests search."""

from pyspark.sql import functions as F

from siftline.providers import HashedWords

TEXTS = {1: "solar financing for schools in the north. It pays.", 2: "wind parks and permits of the state", 3: "solar panels on roofs. More text here.", 4: "budget of the year and the plan", 5: "solar financing again, other words"}


def corpus(spark):
    rows = [(i, i % 2, i, "", t, None, "EN") for i, t in TEXTS.items()]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, page int, title string, content string, context string, language string")
    return df.withColumn("embedding", HashedWords().embed(F.col("content")))
