"""The plans that the driver holds for near duplicates: each has one step of the work, not all before it again."""

from ledgerwood.llm import graph, minhash


def test_plans_of_near_duplicates_stay_small(spark, monkeypatch):
    sizes, written = {}, graph.staged

    def staged(df, name, keep=True):
        sizes[name] = max(sizes.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return written(df, name, keep)

    monkeypatch.setattr(graph, "staged", staged)
    monkeypatch.setattr(minhash, "staged", staged)
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{base} x{i}") for i in range(20)] + [(99, "other words")], "doc_id bigint, text string")
    kept = minhash.without_near_duplicates(docs)
    sizes["kept"] = kept._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 99]
    assert max(sizes.values()) <= 120, sizes
