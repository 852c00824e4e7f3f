"""Plans of queries whose rules are costly: nothing is evaluated twice or by a few tasks."""

from pagelens.operators.classify import classify_response
from pagelens.plans.registry import queries

RESPONSE = "url string, landed_url string, status int, headers map<string,string>, title string, body string, source string"


def test_rules_are_not_tested_once_more_before_rows_are_made(spark):
    rows = spark.createDataFrame([("u", "u", 503, {"retry-after": "5"}, "Just a moment...", None, None), ("v", "v", 200, {}, "", "words " * 100, "")], RESPONSE)
    done = classify_response(rows)
    assert "Filter" not in [line.split()[1] for line in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip().startswith("+-")]
    assert {r["url"] for r in done.collect()} == {"u", "v"}


def test_small_tables_are_dealt_out_before_costly_rules(spark):
    done = queries()["h9_classify_submission"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in done._jdf.queryExecution().optimizedPlan().toString()
