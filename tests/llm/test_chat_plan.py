"""What the driver plans for op9: texts are parsed once, not in each branch that reads the lines."""

from conftest import DATA

from tickloom.llm import queries


def test_lines_are_made_once(spark):
    out = queries.op9_chat_format(spark, DATA)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "Generate" not in plan and plan.count("SortMergeJoin") <= 2
    assert out.count() > 0
