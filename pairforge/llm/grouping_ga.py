"""The grouping genetic algorithm of best-fit packing: whole bins are the genes.

An individual is a packing of the items 0 .. n - 1 (their lengths given) into bins of one capacity. Small
pure functions over lists; ``bestfit_packing`` runs them inside Spark tasks, one island a task.
"""

from __future__ import annotations

import random
from itertools import accumulate

#: (bins as lists of item numbers, tokens in each bin)
Packing = tuple[list[list[int]], list[int]]


class Gaps:
    """Open bins by the room they have left; a bit mask of rooms finds the smallest that is enough."""

    def __init__(self, fills: list[int], capacity: int):
        self.capacity, self.mask, self.at = capacity, 0, [[] for _ in range(capacity + 1)]
        for b, fill in enumerate(fills):
            self.put(b, capacity - fill)

    def put(self, b: int, room: int) -> None:
        if room:
            self.at[room].append(b)
            self.mask |= 1 << room

    def take(self, length: int) -> int | None:
        """The bin with the least room of at least ``length``; it is taken out."""
        above = self.mask >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        held = self.at[room]
        b = held.pop()
        if not held:
            self.mask &= ~(1 << room)
        return b


def best_fit(packing: Packing, items: list[int], lengths: list[int], capacity: int) -> Packing:
    """Each item, in the order given, into the open bin that it fills best, or into a new one."""
    bins, fills = packing
    gaps = Gaps(fills, capacity)
    for i in items:
        n = lengths[i]
        b = gaps.take(n)
        if b is None:
            b = len(bins)
            bins.append([i])
            fills.append(n)
        else:
            bins[b].append(i)
            fills[b] += n
        gaps.put(b, capacity - fills[b])
    return bins, fills


def falling(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def fitness(packing: Packing) -> tuple[int, int]:
    """Fewer bins first, then fuller ones: the greater, the better."""
    return -len(packing[0]), sum(f * f for f in packing[1])


def least_bins(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins.

    For every k up to half the capacity: items over half the capacity never meet, and those of k tokens or
    more only fit into the room of the ones that leave as much (the bound L2 of Martello and Toth).
    """
    count, tokens = [0] * (capacity + 1), [0] * (capacity + 1)
    for n in lengths:
        count[n] += 1
    count, tokens = list(accumulate(count)), list(accumulate(n * c for n, c in enumerate(count)))
    half, most = capacity // 2, 0
    for k in range(half + 1):
        large = count[capacity] - count[half]
        room = (count[capacity - k] - count[half]) * capacity - (tokens[capacity - k] - tokens[half])
        small = tokens[half] - (tokens[k - 1] if k else 0)
        most = max(most, large + max(0, -(-(small - room) // capacity)))
    return most


def crossover(mother: Packing, father: Packing, lengths: list[int], capacity: int, rnd: random.Random) -> Packing:
    """The mother with a share of the father's well-filled bins put in whole.

    Bins of the mother that hold any of the injected items go, and so do a few of her emptiest; what was in
    them and was not injected is displaced, and best-fitted again, the longest first.
    """
    bins, fills = father
    order = sorted(range(len(bins)), key=lambda b: -fills[b])
    well = order[: max(1, len(order) * 9 // 10)]
    size = max(1, int(len(well) * rnd.uniform(0.02, 0.2)))
    chosen = rnd.sample(well, min(size, len(well)))
    injected = {i for b in chosen for i in bins[b]}
    kept, kept_fills, displaced = [list(bins[b]) for b in chosen], [fills[b] for b in chosen], []
    whole = []
    for b, held in enumerate(mother[0]):
        if injected.isdisjoint(held):
            whole.append(b)
        else:
            displaced += [i for i in held if i not in injected]
    # Dissolve the emptiest: their items may fit the gaps that the others leave.
    whole.sort(key=lambda b: -mother[1][b])
    keep = len(whole) - min(len(whole), 1 + len(mother[0]) // rnd.choice((16, 32, 64)))
    for b in whole[keep:]:
        displaced += mother[0][b]
    for b in whole[:keep]:
        kept.append(list(mother[0][b]))
        kept_fills.append(mother[1][b])
    return best_fit((kept, kept_fills), falling(displaced, lengths), lengths, capacity)


def founders(lengths: list[int], capacity: int, size: int, rnd: random.Random) -> list[Packing]:
    """Best-fit packings: of items by falling length, and of orders that are shuffled ever further from it."""
    items, found = falling(list(range(len(lengths))), lengths), []
    for k in range(size):
        order = sorted(items, key=lambda i: -lengths[i] + rnd.random() * capacity * k / (2 * size)) if k else items
        found.append(best_fit(([], []), order, lengths, capacity))
    return found


def evolve(population: list[Packing], lengths: list[int], capacity: int, generations: int, rnd: random.Random) -> list[Packing]:
    """``generations`` crossovers; a child takes the place of the worst if it is better. The best comes first.

    Ends as soon as a packing has as few bins as any can have.
    """
    least = least_bins(lengths, capacity)
    scored = sorted(((fitness(p), k, p) for k, p in enumerate(population)), reverse=True)
    number = len(scored)
    for _ in range(generations):
        if len(scored[0][2][0]) <= least or len(scored) < 2:
            break
        a, b = rnd.sample(range(len(scored)), 2)
        child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], lengths, capacity, rnd)
        score = fitness(child)
        if score > scored[-1][0] and all(score != s for s, _, _ in scored):
            scored[-1] = (score, number, child)
            number += 1
            scored.sort(reverse=True)
    return [p for _, _, p in scored]
