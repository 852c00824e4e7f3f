"""Refs in keyed state: the state is asked and told no more than it needs."""

from __future__ import annotations

from collections import Counter

from pagelens.operators.refs import RefBook
from pagelens.streaming.stateful import KeyMap


class State:
    """A map state that counts what it is asked."""

    def __init__(self) -> None:
        self.held, self.calls = {}, Counter()

    def containsKey(self, key):
        self.calls["contains"] += 1
        return key in self.held

    def getValue(self, key):
        self.calls["get"] += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls["update"] += 1
        self.held[key] = value


def reads(k, n=4):
    return [(i, [("id", f"{k % 3}-{i}"), ("name", f"n{i}")]) for i in range(n)]


def test_a_scope_asks_once_for_a_key_and_writes_it_once():
    state, plain, count, got, want = State(), RefBook(), None, [], []
    for call in range(3):
        before = Counter(state.calls)
        known = KeyMap(state, new=count is None)
        book = RefBook(known, count or 0)
        for k in range(6):
            got += book.bind(reads(call + k))
            want += plain.bind(reads(call + k))
        known.flush()
        count = book.count
        done = state.calls - before
        assert done["update"] <= 16 and done["contains"] <= (16 if call else 0)
    assert got == want
    assert {k: v for (k,), (v,) in state.held.items()} == plain.known
