"""Best-fit packing against every possible packing, and its lookahead against plain filling."""

import random

from kamishi.llm import packing

SIZES = (8, 16, 32)


def price(c):
    return packing.bin_cost(c, 2, 64)


def total(lengths, placed, sizes):
    used = {}
    for (b, start), n in zip(placed, lengths, strict=True):
        assert used.get(b, 0) == start
        used[b] = start + n
    return sum(price(packing.downsized(u, sizes)) for u in used.values())


def best(lengths, sizes):
    """Least cost over all partitions into bins."""
    least = [float("inf")]

    def go(i, bins):
        if i == len(lengths):
            least[0] = min(least[0], sum(price(packing.downsized(u, sizes)) for u in bins))
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= sizes[-1]:
                go(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return least[0]


def test_near_the_best_packing():
    r = random.Random(1)
    joint = optimum = single = 0
    for _ in range(120):
        lengths = sorted((r.randint(1, r.choice([6, 12, 30])) for _ in range(r.randint(1, 7))), reverse=True)
        mine = total(lengths, packing.best_fit(lengths, SIZES, price), SIZES)
        low = best(lengths, SIZES)
        assert low - 1e-9 <= mine <= 1.5 * low
        joint, optimum = joint + mine, optimum + low
        single += total(lengths, packing.best_fit(lengths, SIZES[-1:], price), SIZES)
    assert joint < 1.06 * optimum and joint < 0.97 * single


def test_each_size_is_opened():
    """Over many lengths the joint choice beats every single size, and does not open one size only."""
    r = random.Random(2)
    lengths = sorted((min(4096, int(r.lognormvariate(5.3, 1.1)) + 1) for _ in range(5000)), reverse=True)
    placed = packing.best_fit(lengths)
    used = {}
    for (b, _), n in zip(placed, lengths, strict=True):
        used[b] = used.get(b, 0) + n
    final = [packing.downsized(u) for u in used.values()]
    assert set(final) == set(packing.CAPACITIES)
    alone = packing.best_fit(lengths, packing.CAPACITIES[-1:])
    held = {}
    for (b, _), n in zip(alone, lengths, strict=True):
        held[b] = held.get(b, 0) + n
    assert sum(map(packing.bin_cost, final)) < 0.97 * sum(packing.bin_cost(packing.downsized(u)) for u in held.values())


def test_lookahead():
    r = random.Random(3)
    for _ in range(200):
        left = sorted((r.randint(1, 20) for _ in range(r.randint(0, 15))), reverse=True)
        ahead = packing.Lengths(left)
        gone = left[: len(left) // 3]
        for n in gone:
            ahead.left[n] -= 1
        room = r.randint(0, 60)
        held = 0
        for n in left[len(gone) :]:
            held += n if held + n <= room else 0
        assert ahead.fill(room) == held
