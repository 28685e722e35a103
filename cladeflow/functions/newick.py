"""Trees as arrays of parents, and as Newick text.

Node 0 is the first taxon and the root. Taxon 1 is node 1; taxon t from 2 on is node 2t - 2 and hangs on the inner node
2t - 1 that came with it. ``parents[v]`` is the node above v, and an edge is named by the node below it.
"""

from __future__ import annotations

import re


def start() -> list[int]:
    return [-1, 0]


def taxa(parents: list[int]) -> int:
    return len(parents) // 2 + 1


def taxon_of(node: int) -> int | None:
    """The taxon of a node; None for an inner one."""
    if node < 2:
        return node
    return None if node % 2 else node // 2 + 1


def node_of(taxon: int) -> int:
    return taxon if taxon < 2 else 2 * taxon - 2


def insert(parents: list[int], edge: int) -> list[int]:
    """The tree with the next taxon hung on the edge above node ``edge``."""
    leaf = len(parents)
    out = [*parents, leaf + 1, parents[edge]]
    out[edge] = leaf + 1
    return out


def children(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for v, p in enumerate(parents):
        if p >= 0:
            out[p].append(v)
    return out


def preorder(parents: list[int]) -> list[int]:
    """Nodes with every parent before its children."""
    below, out, stack = children(parents), [], [0]
    while stack:
        v = stack.pop()
        out.append(v)
        stack += reversed(below[v])
    return out


def to_newick(parents: list[int], names: list[str] | None = None) -> str:
    """Canonical text: rooted at the first taxon, children by their least taxon. Taxa are counted from 1 without ``names``."""
    below = children(parents)
    text: dict[int, tuple[int, str]] = {}
    for v in reversed(preorder(parents)):
        t = taxon_of(v)
        if t is not None:
            text[v] = (t, names[t] if names else str(t + 1))
        else:
            parts = sorted(text[c] for c in below[v])
            text[v] = (parts[0][0], "(" + ",".join(p for _, p in parts) + ")")
    if len(parents) == 2:
        return f"({text[0][1]},{text[1][1]})"
    top = below[0][0]
    return "(" + ",".join([text[0][1], *(p for _, p in sorted(text[c] for c in below[top]))]) + ")"


TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[(),;]|[^\s(),;:']+)(?::[^,();]*)?")


def from_newick(text: str, names: dict[str, int]) -> list[int]:
    """Parents of a tree whose labels are in ``names`` (label to taxon from 0). Polytomies are made binary from the left.

    Raises ValueError for text that is no tree of exactly these taxa."""
    stack: list[list] = [[]]
    tokens = TOKEN.findall(text.strip())
    for k, token in enumerate(tokens):
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) < 2:
                raise ValueError("unbalanced tree")
            done = stack.pop()
            stack[-1].append(done)
        elif token not in ",;":
            if k and tokens[k - 1] == ")":
                continue  # a name of an inner node
            if token.strip("'") not in names:
                raise ValueError(f"unknown taxon {token}")
            stack[-1].append(names[token.strip("'")])
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("unbalanced tree")
    near: dict[object, set] = {}
    count = [0]

    def link(a, b):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def build(x):
        if isinstance(x, int):
            return x
        parts = [build(y) for y in x]
        while len(parts) > 1:
            count[0] += 1
            node = ("inner", count[0])
            link(node, parts[0])
            link(node, parts[1])
            parts[:2] = [node]
        return parts[0]

    build(stack[0][0])
    # the node made last has two links: join what it links
    if count[0]:
        a, b = near.pop(("inner", count[0]))
        near[a].discard(("inner", count[0]))
        near[b].discard(("inner", count[0]))
        link(a, b)
    found = sorted(x for x in near if isinstance(x, int))
    if found != list(range(len(names))) or len(found) < 2:
        raise ValueError("taxa are missing or repeated")
    return _grown(near, len(found))


def _grown(near: dict, n: int) -> list[int]:
    """Parents in the numbering by insertion: taxa are taken off from the last and put back in order."""
    near = {k: set(v) for k, v in near.items()}
    undo = []
    for t in range(n - 1, 1, -1):
        (inner,) = near.pop(t)
        near[inner].discard(t)
        a, b = near.pop(inner)
        near[a].discard(inner)
        near[b].discard(inner)
        near[a].add(b)
        near[b].add(a)
        undo.append((t, inner, a, b))
    name = {0: 0, 1: 1}
    parents = start()
    for t, inner, a, b in reversed(undo):
        x, y = name[a], name[b]
        edge = x if parents[x] == y else y
        name[t], name[inner] = len(parents), len(parents) + 1
        parents = insert(parents, edge)
    return parents


def problems(parents: list[int]) -> str | None:
    """What keeps an array from being a tree; None if nothing does."""
    if len(parents) < 2 or len(parents) % 2:
        return "wrong number of nodes"
    if parents[0] != -1 or any(not 0 <= p < len(parents) for p in parents[1:]):
        return "a parent is no node"
    below = children(parents)
    for v, c in enumerate(below):
        expected = 1 if v == 0 else 2 if taxon_of(v) is None else 0
        if len(c) != expected:
            return f"node {v} has {len(c)} children"
    return None if len(preorder(parents)) == len(parents) else "not connected"
