"""Chat sessions: history in batch, and keyed state in a stream."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.operators.conversation import TOOL

OUTPUT = StructType([StructField("session_id", StringType()), StructField("seq", LongType()), StructField("role", StringType()), StructField("content", StringType())])


def history(df: DataFrame, session: str, order: list[str], message: str) -> DataFrame:
    """(session, n, messages): messages in order. A session is one row, so one session must fit in a task."""
    listed = F.array_sort(F.collect_list(F.struct(*order, message)))
    return df.groupBy(session).agg(F.count("*").alias("n"), F.transform(listed, lambda x: x[message]).alias("messages"))


def known(messages: DataFrame, sessions: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """(messages of known sessions, messages to be refused)."""
    ids = sessions.select(session).distinct()
    return messages.join(ids, session, "left_semi"), messages.join(ids, session, "left_anti")


def latency(df: DataFrame, session: str, value: str) -> DataFrame:
    return df.groupBy(session).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


#: The input that ends a session.
REMOVE = "\x04"
CALL = re.compile(r"\{.*\}", re.S)


def parameters_of(reply: str) -> dict | None:
    """The parameters of a tool call in a reply, None if there is none or it can't be read; never evaluated."""
    found = CALL.search(reply) if f'"name": "{TOOL}"' in reply else None
    try:
        return json.loads(found[0])["parameters"] if found else None
    except (ValueError, KeyError, TypeError):
        return None


class SessionProcessor(StatefulProcessor):
    """Keeps each session's messages and answers new ones by ``respond(history) -> reply``.

    A reply that calls the tool is kept, ``tool(**parameters)`` is run, and
    ``respond`` is asked again with its result. An input of :data:`REMOVE` ends
    the session; with ``ttl`` (milliseconds) so does silence.
    """

    def __init__(self, respond: Callable[[list[tuple[str, str]]], str], system: str = "", tool: Callable[..., str] | None = None, ttl: int | None = None):
        self.respond, self.system, self.tool, self.ttl = respond, system, tool, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("role", StringType()), StructField("content", StringType())])
        self.messages = handle.getListState("messages", kind, ttlDurationMs=self.ttl) if self.ttl else handle.getListState("messages", kind)

    def answer(self, held: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The messages that answer a history: a reply, or a call, its result and a reply."""
        reply = self.respond(held)
        call = parameters_of(reply) if self.tool else None
        if call is None:
            return [("assistant", reply)]
        try:
            result = self.tool(**call)
        except Exception as e:  # a call with wrong names or values is told to the model and does not end the stream
            result = f"error: {type(e).__name__}: {e}"
        made = [("assistant", reply), ("tool", result)]
        return [*made, ("assistant", self.respond([*held, *made]))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.messages.get()]
        out, gone, kept = [], False, len(held)
        for text in pd.concat(list(rows)).sort_values("seq", kind="stable")["user_input"]:
            if text == REMOVE:
                held, gone, kept = [], True, -1
                continue
            if not held and self.system:
                held.append(("system", self.system))
            gone, first = False, len(held)
            held.append(("user", text))
            held += self.answer(held)
            out += [(first + i, *m) for i, m in enumerate(held[first:])]
        if gone:
            self.messages.clear()
        elif self.ttl or kept < 0:  # silence is counted for the whole history
            self.messages.put(held)
        elif held[kept:]:
            self.messages.appendList(held[kept:])
        yield pd.DataFrame({"session_id": key[0], "seq": [s for s, _, _ in out], "role": [r for _, r, _ in out], "content": [c for _, _, c in out]}).astype({"seq": "int64"})

    def close(self) -> None:
        pass


def answered(stream: DataFrame, respond: Callable[[list[tuple[str, str]]], str], system: str = "", tool: Callable[..., str] | None = None, ttl: int | None = None) -> DataFrame:
    """A stream (session_id, seq, user_input) answered with state by session; needs the RocksDB state store.

    ``ttl`` needs a trigger by processing time: such a query does not end by itself when all is read.
    """
    return stream.groupBy("session_id").transformWithStateInPandas(statefulProcessor=SessionProcessor(respond, system, tool, ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl else "None")


class OrderedSessions(SessionProcessor):
    """Sessions in event time: messages are answered in the order of their numbers, and a silent session expires.

    A message whose predecessor is missing waits, for ``patience`` milliseconds
    of event time; then the gap is passed over. A session whose last message is
    ``ttl`` milliseconds old begins anew. Only new messages are added to the
    history. Numbers of what is said go on after removal and expiry, so that
    (session_id, seq) never repeats: a number is all that stays of a session.
    """

    def __init__(self, respond: Callable[[list[tuple[str, str]]], str], system: str, tool: Callable[..., str] | None, ttl: int, patience: int, first: int):
        super().__init__(respond, system, tool)
        self.expires_after, self.patience, self.first = ttl, patience, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        # the next number to answer, how many messages were said, when the session expires, when a gap is passed over (-1: none)
        self.progress = handle.getValueState("progress", StructType([StructField(n, LongType()) for n in ("next", "said", "expiry", "gap")]))
        self.waiting = handle.getMapState("waiting", StructType([StructField("seq", LongType())]), StructType([StructField("user_input", StringType()), StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, said, expiry, gap = self.progress.get() or (self.first, 0, -1, -1)
        latest, earliest = -1, None
        for part in rows:
            for seq, text, at in zip(part["seq"].tolist(), part["user_input"].tolist(), part["at"].astype("datetime64[ms]").astype("int64").tolist(), strict=True):
                latest = max(latest, at)
                if seq >= due:  # one that was answered or passed over comes too late
                    earliest = at if earliest is None else min(at, earliest)
                    self.waiting.updateValue((seq,), (text, at))
        if earliest is not None and 0 <= expiry <= earliest:  # the watermark has not told yet
            self.messages.clear()
        if latest >= 0:
            expiry = self._timer(expiry, max(expiry, latest + self.expires_after))
        due, said, out = self._answer(due, said)
        gap = self._timer(gap, self._gap())
        self.progress.update((due, said, expiry, gap))
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, said, expiry, gap = self.progress.get() or (self.first, 0, -1, -1)
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if gap >= 0 and now >= gap:
            due, said, out = self._answer(min(s for (s,) in self.waiting.keys()), said)
            gap = self._timer(-1, self._gap())
        if expiry >= 0 and now >= expiry:
            self.messages.clear()
            expiry = -1
        self.progress.update((due, said, expiry, gap))
        if out:
            yield self._frame(key, out)

    def _gap(self) -> int:
        """When the longest waiting message has waited enough; -1 if none waits."""
        return min((at for _, at in self.waiting.values()), default=-1 - self.patience) + self.patience

    def _timer(self, old: int, new: int) -> int:
        if old != new:
            if old >= 0:
                self.handle.deleteTimer(old)
            if new >= 0:
                self.handle.registerTimer(new)
        return new

    def _answer(self, due: int, said: int) -> tuple[int, int, list[tuple[int, str, str]]]:
        """Answer what waits, from number ``due`` on without a gap."""
        held, out, kept = None, [], 0
        while self.waiting.containsKey((due,)):
            text = self.waiting.getValue((due,))[0]
            self.waiting.removeKey((due,))
            due += 1
            if held is None:
                held = [(r[0], r[1]) for r in self.messages.get()]
                kept = len(held)
            if text == REMOVE:
                self.messages.clear()
                held, kept = [], 0
                continue
            if not held and self.system:
                held.append(("system", self.system))
            start = len(held)
            held.append(("user", text))
            held += self.answer(held)
            for role, content in held[start:]:
                out.append((said, role, content))
                said += 1
        if held is not None and held[kept:]:
            self.messages.appendList(held[kept:])
        return due, said, out

    def _frame(self, key, out: list[tuple[int, str, str]]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]] * len(out), "seq": [s for s, _, _ in out], "role": [r for _, r, _ in out], "content": [c for _, _, c in out]}).astype({"seq": "int64"})


def answered_in_order(stream: DataFrame, respond: Callable[[list[tuple[str, str]]], str], system: str = "", tool: Callable[..., str] | None = None, late: str = "1 minute", ttl: int = 3_600_000, patience: int = 60_000, first: int = 1) -> DataFrame:
    """A stream (session_id, seq, user_input, at) answered in the order of ``seq``, from ``first`` on; needs the RocksDB state store.

    ``late``: how far behind the latest message's time one may come; ``ttl`` and ``patience``: see :class:`OrderedSessions`.
    """
    processor = OrderedSessions(respond, system, tool, ttl, patience, first)
    return stream.withWatermark("at", late).groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
