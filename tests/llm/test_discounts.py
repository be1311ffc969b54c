import math

import pytest

from pairforge.llm import katz_lm


def plain(n, cut=5):
    """Turing's estimates up to the first unusable one, then those of a least-squares line in logarithms."""
    xs, ys = [math.log(r) for r in range(1, cut + 2)], [math.log(n[r]) for r in range(1, cut + 2)]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    line = {r: math.exp(my + slope * (math.log(r) - mx)) for r in range(1, cut + 2)}

    def factor(m, r):
        tail = (cut + 1) * m[cut + 1] / m[1]
        return ((r + 1) * m[r + 1] / (r * m[r]) - tail) / (1 - tail)

    raw = {r: factor(n, r) for r in range(1, cut + 1)}
    bad = min((r for r in raw if not 0 < raw[r] < 1), default=cut + 1)
    return [raw[r] if r < bad else factor(line, r) for r in range(1, cut + 1)]


# Counts of counts of the training fold of sf0.01, which has copies of texts: unigrams, bigrams.
@pytest.mark.parametrize("n", [[0, 51654, 14844, 5474, 2713, 2570, 1129], [0, 206781, 32217, 5097, 1904, 2579, 670]])
def test_discounts_are_good_turing_on_copies(n):
    d = katz_lm.discounts(n)
    assert d[1:6] == pytest.approx(plain(n))
    assert ((d[1:6] > 0) & (d[1:6] < 1)).all() and d[6] == 1
    high = 6 * n[6] / n[1]
    assert d[1] == pytest.approx((2 * n[2] / n[1] - high) / (1 - high))


def test_discounts_of_small_tables():
    for n in ([0] * 7, [0, 3, 0, 0, 0, 0, 0], [0, 0, 5, 0, 1, 0, 0], [0, 1, 1, 1, 1, 1, 1], [0, 9, 2, 0, 1, 0, 0]):
        assert ((katz_lm.discounts(n)[1:6] > 0) & (katz_lm.discounts(n)[1:6] < 1)).all()
