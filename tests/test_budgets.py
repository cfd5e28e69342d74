"""Ends of contexts at line ends, rows without a floor."""

import pytest

from hearthledger.operators import budgets


@pytest.mark.parametrize("size", range(4, 9))
def test_last_text_ends_at_a_line_end(spark, size):
    rows = [(1, 0, "first"), (1, 1, "x" * size), (2, 5, "b"), (2, None, "last"), (2, 4, "a"), (3, 1, None), (3, 2, "y")]
    got = {r.chat: r.text for r in budgets.last_text(spark.createDataFrame(rows, "chat int, floor int, text string"), ["chat"], ["floor"], "text", 6).collect()}
    assert got == {1: ("first\n" + "x" * size)[-6:], 2: "b\nlast", 3: "\ny"}
