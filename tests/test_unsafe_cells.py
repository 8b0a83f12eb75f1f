"""The formula screen judges each cell once and as before; its tests make their own rows."""

from ratebook.operators import validation as v

CELLS = ["=1", "  =1", "\t\n+x", "-5", " -5.5 ", "-5x", "", "  ", None, "\thello", "a cmd|b", "Use PowerShell", "paddEd", "x|CALC", "plain", "+1e5", "@", "-inf", "%a"]
FLAGGED = {"=1", "  =1", "\t\n+x", "-5x", "a cmd|b", "Use PowerShell", "paddEd", "x|CALC", "@", "%a"}


def test_marked_cells(spark):
    df = spark.createDataFrame(list(enumerate(CELLS)), "policy_id long, note string")
    assert {CELLS[r.policy_id] for r in v.unsafe_cells(df).collect()} == FLAGGED


def test_one_search_for_all_patterns(spark):
    """Only marked cells are tried as a number, and a cell is searched twice, not once a pattern."""
    df = spark.createDataFrame([(1, "x")], "policy_id long, note string")
    plan = v.unsafe_cells(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") == 0 and "case when" in plan
