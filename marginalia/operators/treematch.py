"""Patterns over element trees, as small immutable values that enumerate all their matches.

A node pattern matches one element; a sequence pattern matches a prefix of siblings.  ``label`` names a match; the result is a tree of
(label, node, matches below).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from marginalia.operators.dom import Node


@dataclass(frozen=True)
class Match:
    """A match: its label, its node, and the labelled matches within."""

    label: str | None
    node: Node | None
    below: tuple["Match", ...] = ()

    def __getitem__(self, key):
        hits = [m for m in self.below if m.label == key] if isinstance(key, str) else [self.below[key]]
        if not hits:
            raise KeyError(key)
        return hits[0]

    def __contains__(self, label) -> bool:
        return any(m.label == label for m in self.below)

    def written(self) -> str:
        """Nested labels, as text."""
        inner = ", ".join(m.written() for m in self.below)
        return f'"{self.label}"' + (f": <{inner}>" if inner else "")


def _labelled(matches: tuple[Match, ...], label: str | None, node: Node | None) -> tuple[Match, ...]:
    return matches if label is None else (Match(label, node, matches),)


class Seq:
    """A pattern over siblings."""

    def run(self, nodes: tuple[Node, ...]) -> Iterator[tuple[tuple[Match, ...], tuple[Node, ...]]]:
        raise NotImplementedError

    def __add__(self, other: "Seq") -> "Seq":
        return Then(self, other)

    def __or__(self, other: "Seq") -> "Seq":
        return AnyOf(self, other)


@dataclass(frozen=True)
class Then(Seq):
    first: Seq
    second: Seq

    def run(self, nodes):
        for a, rest in self.first.run(nodes):
            for b, left in self.second.run(rest):
                yield a + b, left


@dataclass(frozen=True)
class AnyOf(Seq):
    first: Seq
    second: Seq

    def run(self, nodes):
        yield from self.first.run(nodes)
        yield from self.second.run(nodes)


@dataclass(frozen=True)
class Empty(Seq):
    def run(self, nodes):
        yield (), nodes


def maybe(pattern: Seq) -> Seq:
    """The pattern, or nothing."""
    return AnyOf(pattern, Empty())


def seq(*patterns: Seq) -> Seq:
    out: Seq = Empty()
    for p in patterns:
        out = Then(out, p)
    return out


@dataclass(frozen=True)
class NodePattern(Seq):
    """One element: by tag, classes and text, with a pattern for its children."""

    tags: tuple[str, ...] | None = None
    classes: tuple[str, ...] | None = None
    text: str | None = None
    full: bool = True
    name: str | None = None
    children: Seq | None = None
    either: tuple["NodePattern", ...] = ()

    def matches(self, node: Node) -> Iterator[tuple[Match, ...]]:
        if self.either:
            for p in self.either:
                for found in p.matches(node):
                    yield _labelled(found, self.name, node)
            return
        if self.tags is not None and node.tag not in self.tags:
            return
        if self.classes is not None and not set(self.classes) & set(node.classes):
            return
        if self.text is not None and not (re.fullmatch if self.full else re.match)(self.text, node.text or ""):
            return
        if self.children is None:
            yield _labelled((), self.name, node)
        elif isinstance(self.children, NodePattern):
            for c in node.children:
                for found in self.children.matches(c):
                    yield _labelled(found, self.name, node)
        else:
            for found, rest in self.children.run(tuple(node.children)):
                if not rest:
                    yield _labelled(found, self.name, node)

    def run(self, nodes):
        if nodes:
            for found in self.matches(nodes[0]):
                yield found, nodes[1:]

    def __pow__(self, label: str) -> "NodePattern":
        return replace(self, name=label) if self.name is None else NodePattern(either=(self,), name=label)

    def __or__(self, other):
        return NodePattern(either=(self, other)) if isinstance(other, NodePattern) else AnyOf(self, other)

    def __truediv__(self, children: Seq) -> "NodePattern":
        """Any one child that matches a node pattern, or all children by a sequence pattern; chains go down."""
        if self.children is not None and isinstance(self.children, NodePattern):
            return replace(self, children=self.children / children)
        return replace(self, children=children)

    def with_class(self, *classes: str) -> "NodePattern":
        return replace(self, classes=classes)

    def with_text(self, pattern: str, full: bool = True) -> "NodePattern":
        return replace(self, text=pattern, full=full)


def tag(*names: str) -> NodePattern:
    return NodePattern(tags=names)


any_tag = NodePattern()


def match(pattern: NodePattern, node: Node) -> Iterator[Match]:
    """All matches of a pattern at a node, under a nameless root."""
    for found in pattern.matches(node):
        yield Match(None, node, found)


def same_tree(a: Node, b: Node) -> bool:
    """Equal tags, texts and children; attributes and tails don't count."""
    return canonical(a) == canonical(b)


def canonical(node: Node) -> str:
    """A subtree as a string that is equal for equal trees, so that searching for one is an equality join."""
    out: list[str] = []
    stack: list[Node | None] = [node]
    while stack:
        n = stack.pop()
        if n is None:
            out.append("</>")
            continue
        out.append(f"<{n.tag}>{n.text}")
        stack.append(None)
        stack.extend(reversed(n.children))
    return "".join(out)


def find_equal(root: Node, goal: Node) -> Iterator[Node]:
    """The nodes of a tree, in document order, that are equal to another one; each subtree is digested once, from below."""
    import hashlib

    def digests(top: Node) -> dict[int, bytes]:
        found: dict[int, bytes] = {}
        stack = [(top, False)]
        while stack:
            n, done = stack.pop()
            if not done:
                stack.append((n, True))
                stack.extend((c, False) for c in n.children)
                continue
            own = f"{n.tag}\x1f{n.text}\x1f".encode("utf-8", "surrogatepass") + b"".join(found[id(c)] for c in n.children)
            found[id(n)] = hashlib.blake2b(own, digest_size=16).digest()
        return found

    wanted, every = digests(goal)[id(goal)], digests(root)
    for n in root.iter():
        if every[id(n)] == wanted:
            yield n
