"""The few records that a conversation keeps in mind: keyed state with protected entries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def remember(held: dict[str, list], turn: int, offered: list[tuple[str, bool]], size: int, idle: int) -> None:
    """One turn: what is idle goes, what is offered is refreshed or joins.

    held: node_id to [last turn, protected]. A new record takes the place of the
    unprotected one that was relevant longest ago, the smaller id first; where all
    are protected it doesn't join.
    """
    for k in [k for k, (last, safe) in held.items() if not safe and turn - last >= idle]:
        del held[k]
    for node, safe in offered:
        if node in held:
            held[node][0] = max(held[node][0], turn)
            continue
        if len(held) >= size:
            free = [(last, k) for k, (last, s) in held.items() if not s]
            if not free:
                continue
            del held[min(free)[1]]
        held[node] = [turn, safe]


def replay(offers: DataFrame, size: int = 5, idle: int = 5) -> DataFrame:
    """What each conversation holds after its last turn (offers: conv_id, turn, pos, node_id, protected).

    The rows of a conversation are folded in order as they stream by; only what is
    held is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, turn, held, waiting = None, None, {}, []

        def close() -> list[tuple[Any, str, int, bool]]:
            if waiting:
                remember(held, turn, waiting, size, idle)
            return [(conv, k, last, safe) for k, (last, safe) in held.items()]

        columns = ["conv_id", "node_id", "last_turn", "protected"]
        for pdf in batches:
            out = []
            for c, t, node, safe in zip(pdf["conv_id"], pdf["turn"], pdf["node_id"], pdf["protected"], strict=True):
                if c != conv:
                    out += close()
                    conv, turn, held, waiting = c, t, {}, []
                elif t != turn:
                    remember(held, turn, waiting, size, idle)
                    turn, waiting = t, []
                waiting.append((node, bool(safe)))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(close(), columns=columns)

    ordered = offers.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "pos")
    return ordered.mapInPandas(run, "conv_id long, node_id string, last_turn long, protected boolean")


def stream(offers: DataFrame, size: int = 5, idle: int = 5) -> DataFrame:
    """The same on a stream: after each batch, what the conversations in it hold."""

    def run(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: [t, s] for k, t, s in state.get[0]} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["turn", "pos"])
        for turn, group in rows.groupby("turn", sort=True):
            remember(held, int(turn), list(zip(group["node_id"], group["protected"].astype(bool), strict=True)), size, idle)
        state.update(([(k, t, s) for k, (t, s) in held.items()],))
        yield pd.DataFrame([(key[0], k, t, s) for k, (t, s) in held.items()], columns=["conv_id", "node_id", "last_turn", "protected"])

    kept = "held array<struct<node_id:string,last_turn:long,protected:boolean>>"
    return offers.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, node_id string, last_turn long, protected boolean", kept, "update", GroupStateTimeout.NoTimeout)
