"""Results that are kept for a while."""

import pytest

from spindrift.operators.cached import PAGE_SECONDS, SEARCH_SECONDS, TimedResults


def test_results_expire(spark):
    now, built = [0.0], []

    def build(n):
        built.append(n)
        return spark.range(n)

    c = TimedResults(2, lambda: now[0])
    first = c.get("page", PAGE_SECONDS, lambda: build(3))
    assert first.is_cached and c.get("page", PAGE_SECONDS, lambda: build(4)).count() == 3
    c.get(("search", "x"), SEARCH_SECONDS, lambda: build(5))
    now[0] = 90.0
    assert c.get("page", PAGE_SECONDS, lambda: build(6)).count() == 3 and len(c) == 1
    now[0] = 180.0
    assert c.get("page", PAGE_SECONDS, lambda: build(7)).count() == 7
    assert not first.is_cached and built == [3, 5, 7]


def test_the_one_used_longest_ago_goes_first(spark):
    c = TimedResults(2, lambda: 0.0)
    a, b = (c.get(k, 9, lambda n=n: spark.range(n)) for k, n in (("a", 11), ("b", 12)))
    c.get("a", 9, lambda: spark.range(0))
    c.get("c", 9, lambda: spark.range(13))
    assert len(c) == 2 and a.is_cached and not b.is_cached
    with pytest.raises(ZeroDivisionError):
        c.get("d", 9, lambda: 1 / 0)
    assert len(c) == 2
    with pytest.raises(ValueError, match="most"):
        TimedResults(0)
