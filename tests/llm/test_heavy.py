import random
from collections import Counter

import pandas as pd
import pytest

from keyloom.llm.heavy import frequent, merge_counters, summary


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_bounds_hold_and_frequent_items_are_exact(spark, parts):
    rnd = random.Random(parts)
    values = ["hot"] * 2000 + [f"h{i}" for i in range(8) for _ in range(150)] + [f"t{rnd.randint(0, 3000)}" for _ in range(4000)] + [None] * 500 + [""] * 90
    rnd.shuffle(values)
    counts = Counter(v for v in values if v is not None)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)
    total = sum(counts.values())
    for r in summary(df, "v", 60).collect():
        if r.item is None:
            assert r.total == total and r.floor <= total / 60 * 2
        else:
            assert r.n - r.error <= counts[r.item] <= r.n
    got = {r.item: r.n for r in frequent(df, "v", 1 / 100, 150).collect()}
    assert got == {k: n for k, n in counts.items() if n * 100 >= total}


def test_what_has_no_counter_is_below_the_floor():
    rnd, exact, kept, floor = random.Random(1), Counter(), pd.DataFrame({"item": [], "n": [], "error": []}).astype({"n": "int64", "error": "int64"}), 0
    for _ in range(30):
        batch = Counter(rnd.choices("abcdefghijklmnopqrstuvwxyz", weights=range(1, 27), k=50))
        exact += batch
        new = pd.DataFrame({"item": list(batch), "n": list(batch.values()), "error": 0})
        kept, floor = merge_counters([kept, new], [floor, 0], 8)
        has = dict(zip(kept["item"], zip(kept["n"], kept["error"])))
        assert len(has) <= 8
        for item, n in exact.items():
            assert has[item][0] - has[item][1] <= n <= has[item][0] if item in has else n <= floor


def test_empty_nulls_ties_and_bad_arguments(spark):
    schema = "v string, item string, n long, part long"
    assert frequent(spark.createDataFrame([], schema), "v", 0.1).collect() == []
    assert frequent(spark.createDataFrame([(None, "a", 1, 1)], schema), "v", 0.1).collect() == []
    tie = spark.createDataFrame([(x, "a", 1, 1) for x in "abcd"], schema)
    assert sorted(r.item for r in frequent(tie, "v", 0.25).collect()) == list("abcd")
    with pytest.raises(ValueError):
        frequent(tie, "v", 0.1, capacity=5)
