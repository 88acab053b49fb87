"""Double-array tries.

A trie over sequences of dense ids lies in two arrays.  The child of the node
at slot s by id c is at slot BASE[s] + c, and it is there only if CHECK of that
slot is s.  Nodes are placed level by level; a node with one child takes the
first free slot, one with more a base at which all their slots are free.
"""

from __future__ import annotations

_FREE, _TRIES = -1, 32


class DoubleArray:
    """``rows``: distinct sequences of small integers, those with a common
    beginning next to one another and a sequence before its extensions.
    ``order``: all slots in use, the root (slot 0) first, every node before its children."""

    def __init__(self, rows: list[list[int]]):
        self.base, self.check, self.order, self._cursor = [0], [-2], [0], 0
        queue = [(0, 0, len(rows), 0)]
        for slot, low, high, depth in queue:
            while low < high and len(rows[low]) == depth:
                low += 1
            if low == high:
                continue
            codes, cuts = [], []
            for i in range(low, high):
                code = rows[i][depth]
                if not codes or codes[-1] != code:
                    codes.append(code)
                    cuts.append(i)
            cuts.append(high)
            base = self._place(codes)
            self.base[slot] = base
            for k, code in enumerate(codes):
                child = base + code
                self.check[child] = slot
                self.order.append(child)
                queue.append((child, cuts[k], cuts[k + 1], depth + 1))

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.check.extend([_FREE] * more)
            self.base.extend([0] * more)

    def _place(self, codes: list[int]) -> int:
        check = self.check
        while self._cursor < len(check) and check[self._cursor] != _FREE:
            self._cursor += 1
        if len(codes) == 1:
            self._grow(self._cursor + 1)
            return self._cursor - codes[0]
        low, high = min(codes), max(codes)
        slot, end = self._cursor, len(check)
        for _ in range(_TRIES):
            while slot < end and check[slot] != _FREE:
                slot += 1
            base = slot - low
            if all(base + c >= end or check[base + c] == _FREE for c in codes):
                break
            slot += 1
        else:
            base = end - low
        self._grow(base + high + 1)
        return base

    def step(self, slot: int, code: int) -> int:
        """The child of a node; -1 if it has none by that id."""
        child = self.base[slot] + code
        return child if 0 <= child < len(self.check) and self.check[child] == slot else -1

    def walk(self, row: list[int]) -> list[int]:
        """The slots from the root along a sequence, as far as the trie has it."""
        out = [0]
        for code in row:
            child = self.step(out[-1], code)
            if child < 0:
                break
            out.append(child)
        return out
