"""Resolver of flat reference arrays: a JSON array whose containers hold indices into itself."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags of two-element arrays that stand for the value referred to.
WRAPPERS = frozenset(["Reactive", "ShallowReactive", "Ref", "ShallowRef", "EmptyRef", "EmptyShallowRef"])
#: Places of the output that are filled at most: shared entries are written at each of their places, and a few
#: nested ones would make a short text endless.
MOST = 1 << 20


def unflatten(text):
    """Canonical JSON of the graph that slot 0 leads to (its `data`, a single key unwrapped).

    Works through the slots with a stack, so depth is no limit. A reference back into a container
    that is still open is null in the output, as JSON has no cycles; so are negative references,
    which stand for absent values. None if the text is no such array, or if its output would have more
    than MOST places.
    """
    try:
        slots = json.loads(text)
        root = slots[0]["data"]
    except (ValueError, TypeError, LookupError):
        return None

    def is_ref(x):
        return isinstance(x, int) and not isinstance(x, bool)

    def follow(x):
        """(value, slot) behind a reference, wrappers and dates undone; a value that is none is itself."""
        seen = set()
        while is_ref(x):
            if not 0 <= x < len(slots) or x in seen:
                return None, None
            seen.add(x)
            value = slots[x]
            tagged = isinstance(value, list) and len(value) == 2 and isinstance(value[0], str)
            if tagged and value[0] in WRAPPERS:
                x = value[1]
            elif tagged and value[0] == "Date":
                return value[1], None
            else:
                return value, x
        return x, None

    holder, filled = [None], 0
    work, open_ = [("fill", root, holder, 0)], set()
    while work:
        what, ref, target, place = work.pop()
        if what == "close":
            open_.discard(ref)
            continue
        filled += 1
        if filled + len(work) > MOST:
            return None
        value, slot = follow(ref)
        if isinstance(value, (list, dict)) and slot is not None:
            if slot in open_:
                continue
            open_.add(slot)
            made = [None] * len(value) if isinstance(value, list) else dict.fromkeys(value)
            target[place] = made
            work.append(("close", slot, None, None))
            work += [("fill", x, made, k) for k, x in (enumerate(value) if isinstance(value, list) else value.items())]
        else:
            target[place] = value
    out = holder[0]
    if isinstance(out, dict) and len(out) == 1:
        out = next(iter(out.values()))
    return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def resolve(texts: pd.Series) -> pd.Series:
    """Column form of unflatten, in Arrow batches."""
    return texts.map(lambda t: None if t is None else unflatten(t))
