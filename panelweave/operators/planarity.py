"""Planarity of small graphs, by growing an embedding path by path.

Each biconnected block is embedded on its own: start from a cycle, keep the list of faces, and lay a
path of a remaining fragment into a face that borders all its contacts, a forced one first. A fragment
without such a face proves that the graph isn't planar."""

from __future__ import annotations

from collections import defaultdict


def blocks(adjacent: dict[int, set[int]]) -> list[set[tuple[int, int]]]:
    """Edge sets of the biconnected components."""
    order, low, out, stack = {}, {}, [], []
    for root in adjacent:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        walk = [(root, None, iter(adjacent[root]))]
        while walk:
            v, parent, rest = walk[-1]
            for u in rest:
                if u == parent:
                    continue
                if u not in order:
                    order[u] = low[u] = len(order)
                    stack.append((v, u))
                    walk.append((u, v, iter(adjacent[u])))
                    break
                if order[u] < order[v]:
                    stack.append((v, u))
                    low[v] = min(low[v], order[u])
            else:
                walk.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= order[parent]:
                        block = set()
                        while True:
                            e = stack.pop()
                            block.add((min(e), max(e)))
                            if e == (parent, v):
                                break
                        out.append(block)
    return out


def _path(adjacent, start, goals, through) -> list[int]:
    """A shortest path from start to one of goals, inner nodes within ``through``."""
    came, queue = {start: None}, [start]
    for v in queue:
        for u in adjacent[v]:
            if u in goals and u != start and (v != start or u in adjacent[start]):
                path = [u, v]
                while came[v] is not None:
                    v = came[v]
                    path.append(v)
                return path[::-1]
            if u in through and u not in came:
                came[u] = v
                queue.append(u)
    return []


def _block_is_planar(edges: set[tuple[int, int]]) -> bool:
    adjacent = defaultdict(set)
    for a, b in edges:
        adjacent[a].add(b), adjacent[b].add(a)
    n = len(adjacent)
    if n < 5 or len(edges) < 9:
        return True
    if len(edges) > 3 * n - 6:
        return False
    a, b = next(iter(edges))
    adjacent[a].discard(b), adjacent[b].discard(a)
    cycle = _path(adjacent, a, {b}, set(adjacent) - {b})
    adjacent[a].add(b), adjacent[b].add(a)
    placed = set(cycle)
    drawn = {(min(x, y), max(x, y)) for x, y in zip(cycle, cycle[1:] + cycle[:1], strict=True)}
    faces = [list(cycle), list(cycle)]
    while len(drawn) < len(edges):
        fragments = []  # (contacts, inner nodes, an edge if there are none)
        for x, y in edges - drawn:
            if x in placed and y in placed:
                fragments.append(({x, y}, set(), (x, y)))
        seen = set()
        for v in adjacent:
            if v in placed or v in seen:
                continue
            inner, contacts, todo = {v}, set(), [v]
            for w in todo:
                for u in adjacent[w]:
                    if u in placed:
                        contacts.add(u)
                    elif u not in inner:
                        inner.add(u)
                        todo.append(u)
            seen |= inner
            fragments.append((contacts, inner, None))
        choice = None
        for contacts, inner, edge in fragments:
            fit = [i for i, f in enumerate(faces) if contacts <= set(f)]
            if not fit:
                return False
            if choice is None or len(fit) < len(choice[0]):
                choice = (fit, contacts, inner, edge)
            if len(fit) == 1:
                break
        fit, contacts, inner, edge = choice
        if edge:
            path = list(edge)
        else:
            start = next(iter(contacts))
            first = next(u for u in adjacent[start] if u in inner)
            path = [start, *_path(adjacent, first, contacts - {start}, inner)]
        face = faces.pop(fit[0])
        i, j = face.index(path[0]), face.index(path[-1])
        if i > j:
            i, j, path = j, i, path[::-1]
        middle = path[1:-1]
        faces += [face[: i + 1] + middle + face[j:], face[i : j + 1] + middle[::-1]]
        drawn |= {(min(x, y), max(x, y)) for x, y in zip(path, path[1:], strict=False)}
        placed |= set(path)
    return True


def is_planar(edges) -> bool:
    """Whether the undirected graph of ``edges`` (pairs; loops and repeats do no harm) is planar."""
    adjacent = defaultdict(set)
    for a, b in edges:
        if a != b:
            adjacent[a].add(b), adjacent[b].add(a)
    return all(_block_is_planar(b) for b in blocks(dict(adjacent)))
