"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

from collections.abc import Sequence

WORD = 8
SHALLOW = 24


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8 if differ else n


class _Branch:
    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth = depth
        #: next byte, or -1 for the end of the string -> branch or list of string numbers
        self.children: dict[int, _Branch | list[int]] = {}


def _byte(text: bytes, at: int) -> int:
    return text[at] if at < len(text) else -1


def blind_trie(strings: Sequence[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Order of ``members`` and the common prefix of each with the one before it (0 for the first).

    A branch keeps only the depth at which strings part. A string goes down blindly to some leaf, is compared with it once,
    and is then hung in at the depth where they part.
    """
    root: _Branch | list[int] = [members[0]]
    for number in members[1:]:
        text = strings[number]
        node = root
        while isinstance(node, _Branch):
            child = node.children.get(_byte(text, node.depth))
            node = child if child is not None else next(iter(node.children.values()))
        other = strings[node[0]]
        if text == other:
            node.append(number)
            continue
        parted = common_prefix(text, other)
        above: _Branch | None = None
        node = root
        while isinstance(node, _Branch) and node.depth < parted:
            above, node = node, node.children[_byte(text, node.depth)]
        if isinstance(node, _Branch) and node.depth == parted:
            node.children[_byte(text, parted)] = [number]
            continue
        branch = _Branch(parted)
        branch.children[_byte(other, parted)] = node
        branch.children[_byte(text, parted)] = [number]
        if above is None:
            root = branch
        else:
            above.children[_byte(text, above.depth)] = branch
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[_Branch | list[int], int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, list):
            order += node
            shared += [depth] + [len(strings[node[0]])] * (len(node) - 1)
        else:
            # the first child shares with what came before the branch, the others part at its depth
            below = sorted(node.children.items())
            stack += [(child, node.depth) for _, child in reversed(below[1:])]
            stack.append((below[0][1], depth))
    return order, shared


def deep_shallow(strings: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """Order of all strings, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if not members:
            continue
        if len(members) == 1 or depth >= SHALLOW:
            part, prefix = blind_trie(strings, members) if len(members) > 1 else (members, [0])
            if order:
                prefix[0] = common_prefix(strings[order[-1]], strings[part[0]])
            order += part
            shared += prefix
            continue
        pivot = strings[members[len(members) // 2]][depth : depth + WORD]
        low, same, high = [], [], []
        for number in members:
            word = strings[number][depth : depth + WORD]
            (same if word == pivot else low if word < pivot else high).append(number)
        # strings which end inside this word are equal to its end
        stack.append((high, depth))
        stack.append((same, depth + WORD if len(pivot) == WORD else SHALLOW))
        stack.append((low, depth))
    return order, shared
