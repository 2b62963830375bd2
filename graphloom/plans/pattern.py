"""The query graph: small, connected, simple; lives on the driver."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass
class Node:
    """A vertex of a search tree over the pattern."""

    level: int = 0
    parent: int = -1
    children: list[int] = field(default_factory=list)


class Pattern:
    """Labels by vertex (0, 1, ...) and undirected edges. Loops and repeated edges are dropped."""

    def __init__(self, labels, edges):
        self.labels = tuple(int(x) for x in labels)
        self.n = len(self.labels)
        if not self.n:
            raise ValueError("a pattern needs a vertex")
        self.edges = tuple(sorted({(min(a, b), max(a, b)) for a, b in edges if a != b}))
        self.adj: list[list[int]] = [[] for _ in range(self.n)]
        for a, b in self.edges:
            if not 0 <= a < self.n or not 0 <= b < self.n:
                raise ValueError(f"edge ({a}, {b}) has no vertex")
            self.adj[a].append(b)
            self.adj[b].append(a)
        for near in self.adj:
            near.sort()

    def degree(self, v: int) -> int:
        return len(self.adj[v])

    def connected(self) -> bool:
        return len(self.bfs(0)[0]) == self.n

    def needs(self, v: int) -> dict[int, int]:
        """How many neighbours of each label vertex v has."""
        out: dict[int, int] = {}
        for w in self.adj[v]:
            out[self.labels[w]] = out.get(self.labels[w], 0) + 1
        return out

    def induced(self, vertices) -> "Pattern":
        """The subgraph on the given vertices, renumbered in their order."""
        place = {v: k for k, v in enumerate(vertices)}
        return Pattern([self.labels[v] for v in vertices], [(place[a], place[b]) for a, b in self.edges if a in place and b in place])

    def bfs(self, root: int) -> tuple[list[int], list[Node]]:
        tree, order, todo = [Node() for _ in range(self.n)], [], deque([root])
        seen = {root}
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in self.adj[v]:
                if w not in seen:
                    seen.add(w)
                    tree[w] = Node(tree[v].level + 1, v)
                    tree[v].children.append(w)
                    todo.append(w)
        return order, tree

    @staticmethod
    def preorder(tree: list[Node], root: int) -> list[int]:
        out, todo = [], [root]
        while todo:
            v = todo.pop()
            out.append(v)
            todo += reversed(tree[v].children)
        return out

    def core_numbers(self) -> list[int]:
        left, core, k = {v: self.degree(v) for v in range(self.n)}, [0] * self.n, 0
        while left:
            v = min(left, key=lambda u: (left[u], u))
            k = max(k, left.pop(v))
            core[v] = k
            for w in self.adj[v]:
                if w in left:
                    left[w] -= 1
        return core
