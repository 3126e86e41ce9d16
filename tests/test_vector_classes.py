"""Linear support vectors: scores as columns find what the model's own transform finds."""

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StringIndexer, VectorAssembler

from stratalite.operators import learning


def test_scores_are_columns(spark, capfd):
    rows = [(i, "abc"[i % 3], float(i % 3 * 4 + i % 5 / 3), float((i % 3 == 1) * 3 - i % 7 / 4)) for i in range(90)]
    known = spark.createDataFrame(rows, "id long, label string, b0 double, b1 double")
    cells = known.unionByName(spark.createDataFrame([(100, "a", None, 1.0), (101, None, 0.5, 0.5)], known.schema))
    found = learning.classify(known, cells, ["b0", "b1"], "label", "vectors")
    assert found.columns == [*cells.columns, "found"]
    found.explain()
    plan = capfd.readouterr().out
    vector = VectorAssembler(inputCols=["b0", "b1"], outputCol="features", handleInvalid="skip")
    names = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(known)
    model = OneVsRest(classifier=LinearSVC(maxIter=50), labelCol="_y", predictionCol="_p").fit(vector.transform(names.transform(known)))
    want = {r.id: names.labels[int(r["_p"])] for r in model.transform(vector.transform(cells)).collect()}
    assert {r.id: r.found for r in found.collect()} == want and len(want) == 91
    assert "Project" in plan and "UDF" not in plan
