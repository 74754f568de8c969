"""The trees that add spans learn from all candidates."""

from pagemill.llm import pii


def test_all_candidates_train_and_calibrate(monkeypatch, spark):
    seen = []

    class Trees(pii.GBTClassifier):
        def fit(self, rows):
            seen.append((rows.count(), rows.agg({self.getOrDefault("weightCol"): "sum"}).first()[0] if self.hasParam("weightCol") and self.isDefined("weightCol") else rows.count()))
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    rows = [(i, f"mail a{i}@ex{i % 7}.com or x{i % 5}@y, call +49 30 1234 {i:04d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    total = pii._candidates(pii._scan(docs, ["doc_id"])).count()
    found = pii.find_personal_data(docs, ["doc_id"]).collect()
    assert total >= 12_000 and sorted(r["doc_id"] for r in found) == list(range(4000))
    assert all(r["n_email"] == 1 and r["n_phone"] == 1 for r in found)
    distinct, weight = seen[0]
    assert 0.7 * total < weight < 0.8 * total and distinct < weight / 2
