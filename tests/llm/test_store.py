"""What is staged can be deleted as a whole, and staged again."""

from __future__ import annotations

import os

from quire.llm import store


def test_clear(spark):
    table = store.stage(spark.range(10).toDF("x"), "numbers")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 10 and os.path.exists(path)
    store.clear(spark)
    assert not os.path.exists(path)
    assert store.stage(spark.range(3).toDF("x"), "numbers").count() == 3
