import hand_rows
import pytest


@pytest.mark.parametrize("name", sorted(hand_rows.CASES))
def test_hand_rows(spark, name):
    make, wanted = hand_rows.CASES[name]
    assert [r["result"] for r in make(spark).orderBy("place").collect()] == wanted
