"""Compressed radix tries over text or bytes, walked without recursion so that long keys are no problem."""

from __future__ import annotations


class Node:
    """An edge's label, the children by their label's first element and the value of the key that ends here."""

    __slots__ = ("label", "children", "value", "size")

    def __init__(self, label, value=None, size: int = 0):
        self.label, self.children, self.value, self.size = label, {}, value, size


def common(a, b, at: int = 0) -> int:
    """How many elements ``a`` and ``b[at:]`` have in common from their start, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    if b.startswith(a[:high], at):
        return high
    while high - low > 1:  # a[:low] agrees, a[:high] doesn't
        mid = (low + high) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


def insert(root: Node, key) -> Node:
    """The node where ``key`` ends, made where the trie lacks it; its value is left to the caller.

    ``size`` of the nodes above counts the keys below; a key must be inserted once for that.
    """
    node, at, n = root, 0, len(key)
    while at < n:
        node.size += 1
        child = node.children.get(key[at])
        if child is None:
            child = node.children[key[at]] = Node(key[at:], None, 1)
            return child
        if key.startswith(child.label, at):
            at += len(child.label)
            node = child
            continue
        shared = common(child.label, key, at)
        upper = Node(child.label[:shared], None, child.size)
        node.children[key[at]] = upper
        child.label = child.label[shared:]
        upper.children[child.label[0]] = child
        at += shared
        node = upper
    node.size += 1
    return node


def ends(node: Node, at: int):
    """(rest of the key from ``at`` of the node's label, value) of every key below."""
    todo = [(node, node.label[at:])]
    while todo:
        node, text = todo.pop()
        if node.value is not None:
            yield text, node.value
        todo.extend((child, text + child.label) for child in node.children.values())


def coincide(a: Node, i: int, b: Node, j: int):
    """(value in a, value in b) of the keys that both subtries hold, read from ``i`` and ``j`` of their labels.

    The walk follows both at once and leaves a branch where one lacks it, so it takes no
    longer than the smaller of the two.
    """
    todo = [(a, i, b, j)]
    while todo:
        a, i, b, j = todo.pop()
        x, y = len(a.label) - i, len(b.label) - j
        if x > y:
            if not a.label.startswith(b.label[j:] if j else b.label, i):
                continue
            child = b.children.get(a.label[i + y])
            if child is not None:
                todo.append((a, i + y, child, 0))
        elif y > x:
            if not b.label.startswith(a.label[i:] if i else a.label, j):
                continue
            child = a.children.get(b.label[j + x])
            if child is not None:
                todo.append((child, 0, b, j + x))
        else:
            if a.label[i:] != b.label[j:]:
                continue
            if a.value is not None and b.value is not None:
                yield a.value, b.value
            few, many = (a, b) if len(a.children) <= len(b.children) else (b, a)
            for first in few.children:
                if first in many.children:
                    todo.append((a.children[first], 0, b.children[first], 0))
