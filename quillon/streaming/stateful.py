"""Keyed state on streams: the hot set with a time to live and a cap, and mailboxes that a poll drains."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import CAP, TTL_MS


def hot_sets(uses: DataFrame, owner: str, ttl: int = TTL_MS, cap: int = CAP) -> DataFrame:
    """(owner, version, names) after each micro-batch; uses have name and t in ms. The version rises when membership changes.

    State is bounded by the cap: each owner keeps `cap` names and their last use.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, held = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
        before = set(held)
        if state.hasTimedOut:
            held = {}
        now = max(held.values(), default=0)
        for frame in frames:
            for name, t in zip(frame["name"], frame["t"]):
                held[name] = max(int(t), held.get(name, 0))
                now = max(now, int(t))
            held = dict(sorted(((n, t) for n, t in held.items() if now - t < ttl), key=lambda x: (-x[1], x[0]))[:cap])
        version += set(held) != before
        if held:
            state.update((version, json.dumps(held)))
            state.setTimeoutDuration(ttl)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"owner": [str(key[0])], "version": [version], "names": [sorted(held)]})

    return uses.groupBy(owner).applyInPandasWithState(update, "owner string, version bigint, names array<string>", "version bigint, held string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def mailboxes(events: DataFrame, box: str) -> DataFrame:
    """(box, t, messages) for each poll; events have kind ('send' or 'poll'), body and t. A poll takes all that waits, oldest first."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        for kind, body, t in zip(rows["kind"], rows["body"], rows["t"]):
            if kind == "send":
                waiting.append(body)
            else:
                out.append((str(key[0]), int(t), waiting))
                waiting = []
        state.update((json.dumps(waiting),))
        yield pd.DataFrame(out, columns=["box", "t", "messages"])

    return events.groupBy(box).applyInPandasWithState(update, "box string, t bigint, messages array<string>", "waiting string", "append", GroupStateTimeout.NoTimeout)
