from probatum.llm import common


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, written = [], common.written

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(common, "written", recorded)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
