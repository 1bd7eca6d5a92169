"""Cheapest repair of one conversation's turns by iterative-deepening A* (operator 13).

A row is one code letter: its role's initial (``s u a``, ``o`` for any other), upper case if the text is
truncated; ``1 2 3 4`` for rows of ``s u a o`` that must go.  Edits are Delete 3, Insert 2, Keep 0, Rerole 2,
and 1 more for a truncated row that stays.  The kept, reroled and inserted roles must read ``(s?(ua)+)?``.
State 0 is the start, 1 follows ``s``, 2 follows ``u``, 3 follows ``a``; the role that an Insert or a Rerole
gives is the one the state asks for.
"""

from __future__ import annotations

from functools import lru_cache

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: state after a role's initial, where it is allowed
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
        (AFTER_A, "u"): AFTER_U}
#: state after the role that it asks for
ASKED = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
_CLASS = {**{c: c for c in "suao"}, **{c.upper(): c for c in "suao"}, **dict(zip("1234", "suao"))}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60
#: cheapest end of a conversation after its last row
_ENDING = {START: (0, ""), AFTER_A: (0, ""), AFTER_U: (2, "I"), AFTER_S: (4, "II")}


def illegal_pairs(codes: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    plain = [_CLASS[c] for c in codes]
    return sum(a + b not in _LEGAL for a, b in zip(plain, plain[1:]))


class Search:
    """One run of rows.  The estimate of what is left counts disjoint faults, each of which needs an edit of its
    own: 3 for a row that must go, 1 for a truncated one, 2 for a foreign role and for neighbours that cannot
    stand side by side (a matching of them, read off from the end)."""

    def __init__(self, codes: str):
        self.codes, n = codes, len(codes)
        self.roles = [None if c in "1234" else _CLASS[c] for c in codes]
        self.extra = [TRUNCATED if c in "SUAO" else 0 for c in codes]
        self.base = [0] * (n + 1)           # forced costs from a place on
        self.faults = [0] * (n + 2)         # disjoint faults among the rows from a place on
        self.later = [n] * (n + 1)          # next row that may stay
        after = n                           # the row that may stay behind the present one
        for i in range(n - 1, -1, -1):
            role = self.roles[i]
            if role is None:
                self.base[i], self.faults[i], self.later[i] = self.base[i + 1] + DELETE, self.faults[i + 1], after
                continue
            best = self.faults[i + 1] + (role == "o")
            if after < n and role + self.roles[after] not in _LEGAL:
                best = max(best, 1 + self.faults[after + 1])
            self.base[i], self.faults[i] = self.base[i + 1] + self.extra[i], best
            self.later[i] = after = i

    def estimate(self, at: int, state: int, goal: int | None) -> int:
        if goal == START or goal == AFTER_S:        # no way back to these: all other rows must go
            left = len(self.codes) - at
            if state == goal:
                return DELETE * left
            return DELETE * (left - 1) if state < goal and left else _NEVER
        row = self.later[at]
        if row == len(self.codes):
            if goal is None:
                return self.base[at] + _ENDING[state][0]
            return self.base[at] + (0 if state == goal else 2)
        most = self.faults[row]
        if (state, self.roles[row]) not in NEXT:
            most = max(most, 1 + self.faults[row + 1])
        return self.base[at] + 2 * most

    def cheapest(self, state: int = START, goal: int | None = None) -> tuple[int, str] | None:
        """(cost, audit) of the cheapest edits from ``state``, the least audit of several.  ``goal`` None: up to the end
        of the conversation; else to that state right behind the last row.  None if there is no way."""
        n = len(self.codes)
        if n == 0:
            return _ENDING[state] if goal is None else ((0, "") if goal == state else None)
        failed: dict[tuple[int, int], int] = {}         # (place, state) -> largest budget without a way
        bound = self.estimate(0, state, goal)
        limit = DELETE * n + 8                          # deleting all and inserting what is asked costs less
        while bound <= limit:
            audit = self._within(bound, state, goal, failed)
            if audit is not None:
                return bound, audit
            bound += 1
        return None

    def _edits(self, at: int, state: int, goal: int | None):
        """(letter, cost, next place, next state) in ASCII order."""
        inside = at < len(self.codes)
        if inside:
            yield "D", DELETE, at + 1, state
        if inside or goal is None:
            yield "I", INSERT, at, ASKED[state]
        if inside and self.roles[at] is not None:
            kept = NEXT.get((state, self.roles[at]))
            if kept is not None:
                yield "K", self.extra[at], at + 1, kept
            yield "R", REROLE + self.extra[at], at + 1, ASKED[state]

    def _within(self, bound: int, state: int, goal: int | None, failed: dict) -> str | None:
        """First accepting path of depth-first search that costs ``bound`` at most."""
        n = len(self.codes)
        path: list[str] = []
        stack = [(0, state, bound, self._edits(0, state, goal))]
        while stack:
            at, now, budget, edits = stack[-1]
            if at == n and (now in (START, AFTER_A) if goal is None else now == goal):
                return "".join(path)
            for letter, cost, to, then in edits:
                left = budget - cost
                if left < 0 or failed.get((to, then), -1) >= left or self.estimate(to, then, goal) > left:
                    continue
                path.append(letter)
                stack.append((to, then, left, self._edits(to, then, goal)))
                break
            else:
                failed[at, now] = max(budget, failed.get((at, now), -1))
                stack.pop()
                if path:
                    path.pop()
        return None


@lru_cache(maxsize=20_000)
def whole(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation of a few rows; common ones are searched once."""
    return Search(codes).cheapest()


def block(codes: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state behind, cost, audit) of a part of a conversation, where there is a way."""
    search, out = Search(codes), []
    for a in (START,) if first else range(4):
        for z in range(4):
            found = search.cheapest(a, z)
            if found is not None:
                out.append((a, z, *found))
    return out


def joined(parts: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The same for consecutive parts.  A part's audit ends with the edit of its last row, so no audit between
    two states begins another, and the least audits join to the least."""
    total = parts[0]
    for part in parts[1:]:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for a, m, cost, audit in total:
            for b, z, more, tail in part:
                if b == m:
                    found = (cost + more, audit + tail)
                    if (a, z) not in best or found < best[a, z]:
                        best[a, z] = found
        total = [(a, z, *found) for (a, z), found in sorted(best.items())]
    return total


def ended(ways: list[tuple[int, int, int, str]]) -> tuple[int, str]:
    """(cost, audit) of a conversation whose parts were joined."""
    return min((cost + _ENDING[z][0], audit + _ENDING[z][1]) for a, z, cost, audit in ways if a == START)


class Replay:
    """The repaired roles of a conversation, row by row, from its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _asked(self) -> str:
        role = "assistant" if self.state == AFTER_U else "user"
        self.state = ASKED[self.state]
        return role

    def inserted(self) -> list[str]:
        """Roles of the empty turns that stand here."""
        out = []
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            out.append(self._asked())
        return out

    def row(self, role: str) -> str | None:
        """The role under which the next row stays; None: it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        if edit == "R":
            return self._asked()
        self.state = NEXT[self.state, role[:1]]
        return role
