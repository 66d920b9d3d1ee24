"""Small frames that several tests build."""


def questions_frame(spark, texts):
    return spark.createDataFrame([(f"q{i}", text) for i, text in enumerate(texts)], "query_id string, question string")
