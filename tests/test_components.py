"""Components of the weight search come out of blocks of samples."""
from pressgrid.plans import replay as R

SAMPLE = "sample_id string, history array<string>, positive string, negatives array<string>"
CATALOG = "article_id string, category string, published_at string, embedding array<double>, trust double, freshness double"


def test_components_of_odd_samples(spark):
    samples = spark.createDataFrame([("s", ["x", "none", "y"], "y", ["x", "none"]), ("opposite", ["x", "z"], "x", ["y"]),
                                     ("unread", ["none"], "x", ["y"]), (None, ["x"], "x", ["y"])], SAMPLE)
    catalog = spark.createDataFrame([("x", "A", "", [1.0, 0.0], 0.2, 0.0), ("y", "unknown", "", [0.0, 1.0], 0.4, 1.0), ("z", "B", "", [-0.5 ** 0.2, 0.0], 0.5, 0.5)], CATALOG)
    out = R.candidate_components(samples, catalog, 2)
    assert "profile" not in out.columns and "[profile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.sample_id, r.cpos): (r.article_id, r.semantic, r.interest, r.trust, r.freshness) for r in out.collect()}
    # the read without an article has no say: y was read last, x two reads before; a profile of length 0 is worth 0
    assert got == {("s", 0): ("y", 1.0, 1.0, 1.0, 1.0), ("s", 1): ("x", 0.0, 0.0, 0.0, 0.0),
                   ("opposite", 0): ("x", 0.0, 1.0, 0.0, 0.0), ("opposite", 1): ("y", 0.0, 0.0, 1.0, 1.0)}


def test_no_vector_is_joined_to_candidates(spark):
    samples = spark.createDataFrame([("s", ["x"], "y", ["x"])], SAMPLE)
    catalog = spark.createDataFrame([("x", "A", "", [1.0], 0.2, 0.0), ("y", "B", "", [1.0], 0.4, 1.0)], CATALOG)
    plan = R.candidate_components(samples, catalog, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Project" in line and "embedding#" in line and "sample_id#" in line for line in plan.splitlines())
    assert plan.count("FlatMapCoGroupsInArrow") == 2
