from credence.operators import panel


def test_rows_of_the_eliminated_factor_are_not_multiplied_before_the_exchange(spark):
    """Its levels take no part in grouping sets, whose rows leave a task unreduced; they are counted once dealt out."""
    rows = spark.createDataFrame([("g", k % 40, k % 3, k % 5, 0.1 * k, float(k % 7)) for k in range(400)], "series_id string, a int, b int, c int, x double, y double")
    made = panel.panel_effects(rows, {"a": 2.0, "b": 2.0, "c": 2.0}, {"x": 1.0}, "y", 1.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    expands = [line for line in plan if "Expand [" in line]
    assert expands and not any("level_0" in line for line in expands)
    assert made.count() == 40 + 3 + 5 + 1
