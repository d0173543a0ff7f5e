import numpy as np

from anamnesis.operators import embedding as E


def test_embedder_and_prototypes(spark):
    embed = E.hashing_embedder(128)
    assert np.allclose(np.linalg.norm(embed(["a b c", "x"]), axis=1), 1) and not embed([""]).any()
    protos = spark.createDataFrame([("topic:tea", "green tea and black tea"), ("topic:sea", "ships on the open sea")], "label string, text string")
    rows = spark.createDataFrame([(1, "green tea and black tea", 0), (2, "ships on the open sea today", 0), (3, None, 0), (4, "quite another thing", 0)], "id long, text string, v int")
    vectors = E.embedded(rows, "id", embed)
    assert [r.id for r in vectors.where("v is null").collect()] == [3]
    got = {r.id: r.labels for r in E.prototype_labels(vectors, E.embedded(protos, "label", embed)).collect()}
    assert got == {1: ["topic:tea"], 2: ["topic:sea"]}
