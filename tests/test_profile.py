from resgov.plans.profile import plan_summary
from resgov.plans.queries import queries

SF = "/root/testdata/sf0.001"


def test_plan_summary_reads_the_physical_plan(spark):
    s = plan_summary(queries()["decision_history"](spark, SF))
    assert s["shuffles"].get("rangepartitioning") == 1 and s["shuffles"].get("hashpartitioning") == 1
    assert s["windows"] == 1 and not s["python"]
    s = plan_summary(queries()["registry_fold"](spark, SF))
    assert s["partial_aggregates"] and "SortAggregate" in s["aggregates"]
    s = plan_summary(queries()["registry_as_of"](spark, SF))
    assert any(f.startswith("LessThanOrEqual(o_orderdate") for f in s["pushed_filters"])
