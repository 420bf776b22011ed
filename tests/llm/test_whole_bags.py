from tessella.llm import quality_mil


def test_all_passages_of_a_document_teach(spark, monkeypatch):
    n = 701
    docs = spark.createDataFrame([(0, "a" * quality_mil.PASSAGE * n), (1, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality_mil, "train", lambda bags, y, w: sorted(map(len, bags)))
    assert quality_mil.learn(docs, labels) == [1, n]
