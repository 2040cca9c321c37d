"""What an update over large tables may not do again and again."""

from quadloom.streaming import changes


def test_nothing_is_parsed_before_notifications_are_distinct(spark):
    """The optimizer moved the conditions on parsed notifications, and so the parsing, below the grouping: every repetition was parsed."""
    found = changes.distinct_changes(spark.createDataFrame([("boxes:1",), ("boxes:1",)], "payload string"))
    before, grouping, below = found._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate [payload")
    assert grouping and "Variant" in before and "Variant" not in below and "split" not in below
    assert found.count() == 1
