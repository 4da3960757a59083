"""SuperMinHash signatures (Ertl 2017) of many sets at once.

Each element walks a random permutation of the signature's slots: in round j it offers the value j + r
(r uniform in [0, 1)) to the j-th slot of its permutation, and a slot keeps its smallest offer. Offers of
later rounds are larger than all earlier ones, so a set is done after the round in which its last slot
was filled: that is the early stop. Slots of one element never coincide, which is what lowers the variance
against independent hash functions. Rounds run in step for all sets of a chunk.
"""

import numpy as np

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """(sets, slots) values. ``elements``: 64-bit hashes, distinct within a set; ``owner``: the set of each.
    ``slots`` is at most 256. A set without elements keeps the unset value in all slots."""
    best = np.full(sets * slots, _UNSET)
    places = None
    for j in range(slots):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            drawn = mixed(elements + _GAMMA * np.uint64(j + 1))
        # The low half draws a position among the slots not yet walked, the high half is r.
        k = (j + (((drawn & _LOW) * np.uint64(slots - j)) >> _32)).astype(np.intp)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(elements))
            slot = places[rows, k].astype(np.intp)
            places[rows, k] = places[:, j]
        np.minimum.at(best, owner * slots + slot, (np.uint64(j) << _32) | (drawn >> _32))
        open_sets = (best.reshape(sets, slots) == _UNSET).any(axis=1)
        stay = open_sets[owner]
        if j == 0:
            left, first = int(stay.sum()), k[stay]
            places = np.broadcast_to(np.arange(slots, dtype=np.uint8), (left, slots)).copy()
            places[np.arange(left), first] = 0
        elif not stay.all():
            places = places[stay]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
    return best.reshape(sets, slots)


def bands(signature: np.ndarray, count: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; equal keys mean equal bands, up to hash collisions."""
    sets, slots = signature.shape
    parts = signature.reshape(sets, count, slots // count)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (sets, count)).copy()
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = mixed(key * np.uint64(0x100000001B3) ^ parts[:, :, i])
    return key.view(np.int64)
