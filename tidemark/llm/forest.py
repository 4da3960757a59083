"""A forest of random-projection trees over unit vectors, and its search through one priority queue."""

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one numbering. Node i splits by ``normals[i]`` at ``offsets[i]``; ``children[i]`` holds the
    nodes below (left, right). A leaf has children (-1, leaf number)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaf_tree: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.leaf_tree)


def build(points: np.ndarray, trees: int, leaf_points: int, seed: int) -> Forest:
    """Split at the median along the difference of two random points, until a node has ``leaf_points`` or fewer."""
    random = np.random.default_rng(seed)
    dim = points.shape[1]
    normals, offsets, children, roots, leaf_tree = [], [], [], [], []

    def node(tree, members):
        here = len(children)
        children.append(None)
        normals.append(np.zeros(dim))
        offsets.append(0.0)
        halves = None
        for _ in range(3 if len(members) > leaf_points else 0):
            a, b = points[random.choice(members, 2, replace=False)]
            normal = a - b
            size = np.linalg.norm(normal)
            along = points[members] @ normal
            middle = np.median(along)
            left = along < middle
            if size > 0 and 0 < left.sum() < len(members):
                normals[here], offsets[here] = normal / size, middle / size
                halves = members[left], members[~left]
                break
        if halves is None:
            leaf_tree.append(tree)
            children[here] = (-1, len(leaf_tree) - 1)
        else:
            children[here] = (node(tree, halves[0]), node(tree, halves[1]))
        return here

    for tree in range(trees):
        roots.append(node(tree, np.arange(len(points))))
    return Forest(np.array(normals), np.array(offsets), np.array(children), np.array(roots), np.array(leaf_tree))


def route(forest: Forest, points: np.ndarray) -> np.ndarray:
    """(points, trees): the leaf of each point in each tree."""
    out = np.empty((len(points), len(forest.roots)), dtype=np.int64)
    for t, root in enumerate(forest.roots):
        at = np.full(len(points), root)
        while True:
            inner = np.flatnonzero(forest.children[at, 0] >= 0)
            if not len(inner):
                break
            here = at[inner]
            right = np.einsum("ij,ij->i", points[inner], forest.normals[here]) >= forest.offsets[here]
            at[inner] = forest.children[here, right.astype(int)]
        out[:, t] = forest.children[at, 1]
    return out


def search(forest: Forest, points: np.ndarray, sizes: np.ndarray, wanted: int) -> list:
    """The leaves to look into for each point: nodes of all trees wait in one queue, the one whose worst margin
    on the way down is best comes first, until the leaves taken hold ``wanted`` entries. ``sizes``: entries of
    each leaf. A tree's leaf is entered at most once, so the whole forest is the most that can be taken."""
    margins = points @ forest.normals.T - forest.offsets
    children = forest.children.tolist()
    sizes = sizes.tolist()
    out = []
    for own in margins:
        own = own.tolist()
        queue = [(-np.inf, int(r)) for r in forest.roots]
        taken, held = [], 0
        while queue and held < wanted:
            bound, at = heapq.heappop(queue)
            left, right = children[at]
            if left < 0:
                taken.append(right)
                held += sizes[right]
                continue
            margin = own[at]
            heapq.heappush(queue, (max(bound, margin), left))
            heapq.heappush(queue, (max(bound, -margin), right))
        out.append(taken)
    return out
