import pytest
from conftest import SF, oracle_rows, spark_rows

from opinara.plans.deeper import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    assert rows == oracle_rows(ORACLES[name], columns)


def test_topics_assign_every_review_once(spark):
    got = QUERIES["topic_kmeans"](spark, SF).collect()
    assert len({r.review_id for r in got}) == len(got) and {r.topic for r in got} <= set(range(6))
    assert len({r.name for r in got}) == len({r.topic for r in got}) and all(0 <= r.relevance <= 1 for r in got)


def test_every_oracle_has_rows(spark):
    from conftest import oracle_rows as rows

    for name in ("recommendations", "root_cause_claims", "emerging_themes", "competitor_summary", "finding_reconcile", "page_records", "identity_matches", "citation_check", "dup_links", "evidence_ids"):
        columns = sorted(QUERIES[name](spark, "/root/testdata/sf0.01").columns)
        assert rows(ORACLES[name], columns, "/root/testdata/sf0.01"), name
