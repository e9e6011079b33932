"""Learning reads every labelled row, in blocks that the driver never holds."""

import inspect

import numpy as np

from normweave.llm import quality_ranking as Q


def test_quality_learns_from_all_blocks(spark, sf, monkeypatch):
    """Nothing caps the labelled rows; blocks of a few rows give a model like one block's, and its threshold is the exact quantile."""
    assert "limit" not in inspect.getsource(Q.fit) and "most" not in inspect.signature(Q.fit).parameters
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(Q, "BLOCK_ROWS", 40)
    parts = Q.fit(labels, docs)
    monkeypatch.setattr(Q, "BLOCK_ROWS", 20_000)
    whole = Q.fit(labels, docs)
    f = np.array([r.f for r in Q.features(docs.join(labels.where("quality IS NOT NULL").select("doc_id").distinct(), "doc_id")).collect()])
    assert np.corrcoef(f @ parts.weights, f @ whole.weights)[0, 1] > 0.9
    good = np.quantile(f @ whole.weights, labels.where("quality = 0").count() / labels.where("quality IS NOT NULL").count())
    assert abs(good - whole.threshold) < 1e-6


def test_exact_quantile_of_many_values(spark):
    values = np.sort(np.concatenate((np.random.default_rng(1).normal(size=30_000), np.full(15_000, 0.25))))
    scores = spark.createDataFrame([(float(v),) for v in values], "s double")
    for q in (0.0, 0.1234, 0.6, 0.75, 1.0):
        assert abs(Q._quantile(scores, q) - np.quantile(values, q)) < 1e-12


def test_texts_meet_labels_the_same_way_at_any_size(spark, monkeypatch):
    """Few labels are not broadcast either, so the disk that learning takes is in proportion to its input."""
    from normweave.llm import quality_ranking as q

    plans, real = [], q.features
    monkeypatch.setattr(q, "features", lambda docs, *names: (plans.append(docs._jdf.queryExecution().executedPlan().toString()), real(docs, *names))[1])
    docs = spark.createDataFrame([(i, f"word {i}" * (1 + i % 3)) for i in range(20)], "doc_id long, text string")
    model = q.fit(spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "doc_id long, quality double"), docs)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    assert q.score(docs, model).count() == 20


def test_sums_meet_in_groups_without_a_second_python_worker(spark, monkeypatch):
    """A task that learns runs in one Python worker, not in a chain of two, each with memory of its own; any number of groups gives the sums."""
    rng = np.random.default_rng(3)
    f = rng.normal(size=(90, len(Q.FEATURES))).astype(np.float32)
    rows = spark.createDataFrame([(i, i % 2, f[i].tolist()) for i in range(90)], "id long, good int, f array<float>")
    monkeypatch.setattr(Q, "BLOCK_ROWS", 12)
    blocks = Q._blocks(rows).cache()
    assert blocks.count() > 4 and sum(len(bytes(r.good)) for r in blocks.collect()) == 90

    def chained(self):
        raise AssertionError("a second worker")

    monkeypatch.setattr(type(rows), "rdd", property(chained))
    for groups in (1, 3):
        assert np.allclose(Q._summed(blocks, groups, lambda f, good, block: np.append(f.sum(axis=0), good.sum()), f.shape[1] + 1), np.append(f.sum(axis=0), 45), atol=1e-4)
    blocks.unpersist()
