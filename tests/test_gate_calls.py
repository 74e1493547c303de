"""The gate's calls to the state store grow with steps and batches, not with rows."""
import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest

from jobscope.streaming import gate

FIELDS = [f.name for f in gate.MEASUREMENT_SCHEMA.fields]


class Store:
    """Value and map state of one key, with a count of calls."""

    def __init__(self):
        self.calls, self.value, self.map = Counter(), None, {}
        call = lambda name, fn: lambda *a: (self.calls.update([name]), fn(*a))[1]
        best = SimpleNamespace(get=call("get", lambda: self.value), exists=call("exists", lambda: self.value is not None),
                               update=call("update", lambda v: setattr(self, "value", v)))
        seen = SimpleNamespace(containsKey=call("contains", lambda k: k in self.map), getValue=call("read", self.map.__getitem__),
                               keys=call("keys", lambda: iter(list(self.map))), clear=call("clear", self.map.clear),
                               updateValue=call("put", self.map.__setitem__))
        self.getValueState, self.getMapState = lambda *a: best, lambda *a: seen


def batch(rows):
    """(recordid, accuracy, node, total) as the processor may be given them."""
    return pd.DataFrame([{**dict.fromkeys(FIELDS), "recordid": r, "accuracy": a, "target_node": n, "tot": t, "row": str(r)} for r, a, n, t in rows])


def kept(processor, rows):
    out = [b for b in processor.handleInputRows((1, 0), iter([batch(rows)]), None)]
    return sorted(int(x) for b in out for x in (b["row"] if "row" in b else b["recordid"]))


def test_calls_do_not_grow_with_rows():
    store, processor = Store(), gate.GateProcessor(None)
    processor.init(store)
    for i in range(4):
        rows = [(i * 500 + k, 1, "n1", 1000 * i + 2 * k + 1) for k in range(500)]
        assert kept(processor, rows) == [r[0] for r in rows]
    assert sum(store.calls.values()) <= 4 * 5
    assert kept(processor, [(9000, 1, "n1", 1), (9001, 1, "n1", 2), (9002, 1, "n2", 1), (9003, 1, "n1", 2001)]) == [9001, 9002]
    assert sum(store.calls.values()) <= 5 * 5 + 4


@pytest.mark.parametrize("seed", range(30))
def test_rows_are_judged_as_one_by_one(seed, monkeypatch):
    monkeypatch.setattr(gate, "CHUNK_ENTRIES", 3, raising=False)
    rnd = random.Random(seed)
    store, processor, best, seen, number = Store(), gate.GateProcessor(None), -1, set(), 0
    processor.init(store)
    for _ in range(8):
        rows, want = [], []
        for _ in range(rnd.randint(1, 25)):
            number += 1
            row = (number, rnd.choice([0, 0, 0, 1, 1, 2]), rnd.choice(["a", "b", None]), rnd.choice([0, rnd.randint(-3, 12), number]))
            rows.append(row)
            if row[3] and row[1] >= best and row[1:] not in seen:
                best = row[1]
                seen.add(row[1:])
                want.append(number)
        rnd.shuffle(rows)
        assert kept(processor, rows) == want
