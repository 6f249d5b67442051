"""The quality ranking learns from every labelled document, and its threshold is that of all their scores."""

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import quality


def test_every_labelled_document_is_learned_from(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows, known = quality.label_rows(labels, "quality", 4, 2)
    features = quality.labelled_features(docs, rows)
    assert features.count() == sum(known.values()) > 5800 and set(known) == {0, 1}
    assert {tuple(r.x) for r in features.where("doc_id IS NULL" if "doc_id" in features.columns else "_doc < 3").collect()} <= {tuple(quality.text_features(f"word {i}")) for i in range(3)}


def test_groups_agree_with_one_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROUP", 300)
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, quality.FEATURES))
    y = (x[:, 0] - 2 * x[:, 1] + rnd.normal(size=3000) > 0.3).astype(int)
    features = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "_doc long, y int, x array<double>")
    one = quality.fit_pairs(x, y, y.mean())
    for df in (features, features.repartition(5, "y")):
        many = quality.fit_all(df, {1: int(y.sum()), 0: int((1 - y).sum())}, float(y.mean()))
        assert np.corrcoef(one.raw(x), many.raw(x))[0, 1] > 0.999 and abs((many.score(x) >= 0.7).mean() - y.mean()) < 1e-3
    s = np.sort(np.round(many.raw(x), 9))
    scored = spark.createDataFrame([(int(b), float(v)) for b, v in zip(y, np.round(many.raw(x), 9), strict=True)], "y int, s double")
    place = int(np.ceil(3000 * 0.4 - 1e-9)) - 1
    for most in (1, 10_000):
        assert abs(quality.quantile(scored, {0: 1 / 3000, 1: 1 / 3000}, 0.4 - 1e-9, most) - (s[place] + s[place + 1]) / 2) < 1e-9
