"""Cheapest edits of a conversation, with edit prefixes shared as linked nodes.

A role sequence is legal if its initials match ``(s?(ua)+)?``. The states of that
pattern: 0 nothing yet, 1 after s, 2 after u, 3 after ua; 0 and 3 may end. For every
row and state the programme keeps the cheapest edits so far, of equally cheap ones the
ASCII-least audit (one letter an edit: Delete, Insert, Keep, Rerole).

An audit is a node: a letter after a parent. Nodes share their prefixes, carry a rolling
hash of the whole audit and their ancestors at distances 1, 2, 4, ... Two audits are
compared by a binary search for their longest common prefix on these hashes; the prefix
is verified letter by letter down to the node that both share, and audits whose hashes
collide are compared in full.

Audits that are compared have consumed the same rows, ended in the same state and cost
the same. One is never a proper prefix of the other (the rest would be inserts, which
cost), so whatever follows both, the smaller one stays smaller, and the programme may
forget the other.
"""

from __future__ import annotations

from typing import NamedTuple

#: The role (initial) that an insert or rerole adds in a state leads to this state.
FORWARD = (2, 2, 3, 2)
ADDED = ("user", "user", "assistant", "user")
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BASE, MODULUS = 911382323, (1 << 61) - 1


class Row(NamedTuple):
    """A row as the programme sees it."""

    initial: str
    must_go: bool
    truncated: bool


class Trail:
    """An audit's last letters (one or, for a whole segment, several) and all before."""

    __slots__ = ("code", "depth", "letters", "size", "up")

    def __init__(self, parent: Trail | None = None, letters: str = ""):
        self.letters = letters
        if parent is None:
            self.depth, self.size, self.code, self.up = 0, 0, 0, []
            return
        self.depth, self.size, code = parent.depth + 1, parent.size + len(letters), parent.code
        for letter in letters:
            code = (code * BASE + ord(letter)) % MODULUS
        self.code = code
        self.up = [parent]
        while len(self.up[-1].up) >= len(self.up):
            self.up.append(self.up[-1].up[len(self.up) - 1])

    def above(self, distance: int) -> Trail:
        node = self
        while distance:
            low = distance & -distance
            node, distance = node.up[low.bit_length() - 1], distance - low
        return node

    def nodes(self, below: Trail | None = None) -> list[Trail]:
        """The nodes from the root, or from the child of ``below``, to this one."""
        out, node = [], self
        while node is not below and node.up:
            out.append(node)
            node = node.up[0]
        return out[::-1]

    def text(self) -> str:
        return "".join(n.letters for n in self.nodes())


def _alike(a: Trail, b: Trail) -> bool:
    return a.code == b.code and a.size == b.size


def _verified(a: Trail, b: Trail) -> bool:
    """Whether the prefixes that end in two nodes of one depth are equal node by node."""
    while a is not b:
        if a.letters != b.letters:
            return False
        a, b = a.up[0], b.up[0]
    return True


def smaller(a: Trail, b: Trail) -> bool:
    """Whether audit ``a`` comes before ``b`` in ASCII order."""
    if a is b:
        return False
    depth = min(a.depth, b.depth)
    x, y = a.above(a.depth - depth), b.above(b.depth - depth)
    if not _alike(x, y):
        for k in range(depth.bit_length() - 1, -1, -1):
            if k < len(x.up) and not _alike(x.up[k], y.up[k]):
                x, y = x.up[k], y.up[k]
        if _verified(x.up[0], y.up[0]) and not x.letters.startswith(y.letters) and not y.letters.startswith(x.letters):
            return x.letters < y.letters
    return a.text() < b.text()


def better(new: tuple[int, Trail], old: tuple[int, Trail] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and smaller(new[1], old[1]))


def _with_inserts(states: list) -> list:
    """The states with what inserts after them reach; two in a row are enough, and none
    leads back cheaper."""
    for s, t in ((0, 2), (1, 2), (2, 3), (3, 2)):
        if states[s] is not None:
            cost, trail = states[s]
            if states[t] is None or cost + INSERT <= states[t][0]:
                new = (cost + INSERT, Trail(trail, "I"))
                if better(new, states[t]):
                    states[t] = new
    return states


def start() -> list:
    """The states before a conversation's first row."""
    return _with_inserts([(0, Trail()), None, None, None])


def entered(state: int) -> list:
    """The states at a segment's start when its predecessor ended in ``state``."""
    return [(0, Trail()) if s == state else None for s in range(4)]


def advance(states: list, rows: list[Row]) -> list:
    """The states after ``rows``."""
    for row in rows:
        found: list = [None] * 4
        for s, held in enumerate(states):
            if held is None:
                continue
            cost, trail = held
            moves = [(s, cost + DELETE, "D")]
            if not row.must_go:
                stays = cost + (TRUNCATED if row.truncated else 0)
                moves.append((FORWARD[s], stays + REROLE, "R"))
                if row.initial in KEPT[s]:
                    moves.append((KEPT[s][row.initial], stays, "K"))
            for t, price, letter in moves:
                old = found[t]
                if old is None or price < old[0]:
                    found[t] = (price, trail, letter)
                elif price == old[0] and smaller(Trail(trail, letter), Trail(old[1], old[2])):
                    found[t] = (price, trail, letter)
        states = _with_inserts([None if x is None else (x[0], Trail(x[1], x[2])) for x in found])
    return states


def finish(states: list) -> tuple[int, Trail]:
    """The cheapest edits among the states that may end."""
    best = None
    for s in ENDS:
        if states[s] is not None and better(states[s], best):
            best = states[s]
    return best


def edited(rows: list[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[tuple[str, str, str]], int]:
    """``(role, text, edit)`` of the rows that ``audit`` leaves, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
        elif letter == "I":
            out.append((ADDED[state], "", letter))
            state = FORWARD[state]
        else:
            role, text = rows[at]
            at += 1
            if letter == "R":
                role, state = ADDED[state], FORWARD[state]
            else:
                state = KEPT[state][role[:1]]
            out.append((role, text, letter))
    return out, state
