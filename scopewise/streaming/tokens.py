"""Generated tokens as a stream: a message's text is put together from tokens of many micro-batches.

State is kept for each message: what has been said so far, the marks it is in, and tokens that came before their turn. It
goes to Python and back with the rows, many messages at a time: a call to the state store for each token, or message, would
take far longer than the work.
A message is given out once, when its stop token's turn comes, or unended when no token of it came for a while; what
comes after that is left out until its state expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "text string, thinking string, in_thought boolean, in_header boolean, next long, given boolean, until long, early_seq array<long>, early_token array<string>"
GIVEN = "message string, text string, thinking string, ended boolean"


def said(state: dict, token: str | None, stop: str) -> bool:
    """Take one token in; true if it ends the message. The rules of ingest.spoken."""
    if token == stop:
        return True
    if token in ("<think>", "</think>"):
        state["in_thought"] = token == "<think>"
    elif token in ("<|start_header_id|>", "<|end_header_id|>"):
        state["in_header"] = token == "<|start_header_id|>"
    elif not state["in_header"] and token is not None:
        part = "thinking" if state["in_thought"] else "text"
        if state[part] or token not in ("\n", "\n\n"):
            state[part] += token
    return False


def taking(stop: str, wait_ms: int):
    """What takes rows (message, seq, token, ts) of one message in, and gives the message when it ends or its time is over."""
    names = ("text", "thinking", "in_thought", "in_header", "next", "given", "until", "early_seq", "early_token")
    shown = lambda key, state, ended: pd.DataFrame([(key[0], state["text"], state["thinking"], ended)], columns=["message", "text", "thinking", "ended"])

    def take(key, rows: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(names, group.get if group.exists else ("", "", False, False, 0, False, 0, [], []), strict=True))
        if group.hasTimedOut:
            group.remove()
            if not state["given"]:
                yield shown(key, state, False)
            return
        given, new = state["given"], dict(zip(state["early_seq"], state["early_token"], strict=True))
        for batch in rows:
            state["until"] = max(state["until"], int(batch.ts.max().timestamp() * 1000) + wait_ms)
            new.update(zip(batch.seq.tolist(), batch.token.tolist(), strict=True))
        while not state["given"] and state["next"] in new:
            token = new.pop(state["next"])
            state["next"] += 1
            state["given"] = said(state, token, stop)
        # only what came before its turn is kept
        early = [] if state["given"] else [x for x in new.items() if x[0] > state["next"]]
        state["early_seq"], state["early_token"] = [seq for seq, _ in early], [token for _, token in early]
        over = state["until"] <= group.getCurrentWatermarkMs()
        if state["given"] and not given:
            yield shown(key, state, True)
        elif over and not given:
            yield shown(key, state, False)
        if over:
            if group.exists:
                group.remove()
            return
        group.update(tuple(state.values()))
        group.setTimeoutTimestamp(state["until"] - 1)  # it is over once the stream's time has passed this

    return take


def messages(tokens: DataFrame, stop: str, late: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """(message, text, thinking, ended) from a stream (message, seq, token, ts): seq counts a message's tokens from 0.

    Tokens may come in any order and again; those over ``late`` behind the stream's time are dropped by the watermark.
    A message of which nothing came for wait_ms of the stream's time is given out as it is: an early token whose
    predecessors never came is not part of it.
    """
    tokens.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = tokens.select(F.col("message").cast("string").alias("message"), F.col("seq").cast("long").alias("seq"), "token", "ts").withWatermark("ts", late)
    return rows.groupBy("message").applyInPandasWithState(taking(stop, wait_ms), GIVEN, STATE, "append", GroupStateTimeout.EventTimeTimeout)
