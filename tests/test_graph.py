"""The graph's rows are dealt once, and much named candidates are combined before."""

from claimspark.operators import graph
from tests.test_projection import shuffles


def rows(spark):
    observations = spark.createDataFrame([("desk", "o1", "2026-01-01T00:00:00Z")], "source_id string, observation_id string, observed_at string")
    event = "observation_id string, candidate_key string, source_event_key string, artist_external_id string, artist_name string, venue_external_id string, venue_name string, date string, start_time string"
    events = spark.createDataFrame([("o1", f"event:{k}", str(k), "a", f"Act {k % 2}", "v", "Room", "2026-09-01", None) for k in range(4)], event)
    return observations, events, spark.createDataFrame([(str(k), "A", "V", f"E{k}") for k in range(4)], "source_event_key string, artist_id string, venue_id string, event_id string")


def test_edges_are_dealt_by_id_once(spark):
    observations, events, projections = rows(spark)
    links = graph.observed(observations, events)[1]
    assert shuffles(links) == 1 and "partial_max" in (plan := links._jdf.queryExecution().executedPlan().toString()) and plan.index("partial_max") < plan.index("Exchange hashpartitioning(")
    assert links.count() == 1 + 3 * 4 and graph.resolved(events, projections)[1].count() == 2 + 3 * 4


def test_nodes_of_much_named_candidates(spark):
    observations, events, projections = rows(spark)
    got = {r["id"]: (r["label"], r["data"]) for r in graph.observed(observations, events)[0].unionByName(graph.resolved(events, projections)[0]).collect()}
    assert len(got) == 2 + 2 + 4 + 2 + 4 and got["artist:a"] == ("Act 0", {"externalId": "a"}) and got["canonical-artist:A"] == ("Act 0", {"canonicalId": "A"})
