"""Streamed responses: fragments of text, reasoning and calls are held as state until a response is whole.

A response's fragments are numbered from 0, the last one says that it is completed.  State holds what has come, by
number, so the order of micro-batches and repeated fragments do not matter; when all numbers are there, the response
is emitted and a mark is left.  One that gets nothing for ``gap`` of event time is emitted as abandoned.

A task's Python is entered for a bucket of responses, not for each: a call costs as much as some thousand fragments.
A bucket's state holds what is open or marked in it; more ``buckets`` make it smaller.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a fragment behind response_id, seq and ts; counts come with the completed one.
PARTS = ("kind", "id", "name", "text", "input_tokens", "output_tokens")
RESPONSE = "response_id string, status string, text string, reasoning string, calls array<struct<id:string,name:string,args:string>>, input_tokens long, output_tokens long"
#: Buckets that responses are dealt to by a hash.
BUCKETS = 4096
#: What is held of a response that was emitted, in place of its fragments.
DONE = {"done": True}
CALLS = "tool_call_start", "tool_call_delta"


def assembled(response: str, fragments: dict[int, list], status: str) -> dict:
    """The response of numbered fragments: calls in the order of their first fragment, arguments null if they are no JSON.

    A fragment of arguments without an id belongs to the call that began last, or to ``orphan``.
    """
    text, reasoning, calls, opened, counts = [], [], {}, None, (None, None)
    for _, (kind, id_, name, said, *tokens) in sorted(fragments.items()):
        if kind == "text_delta":
            text.append(said or "")
        elif kind == "reasoning_delta":
            reasoning.append(said or "")
        elif kind in CALLS:
            opened = (id_ or opened) if kind == CALLS[0] else opened
            call = calls.setdefault(id_ or opened or "orphan", ["", ""])
            call[0] = name or call[0]
            call[1] += (said or "") if kind == CALLS[1] else ""
        elif kind == "completed":
            counts = tokens
    return {
        "response_id": response, "status": status, "text": "".join(text), "reasoning": "".join(reasoning), "calls": [{"id": k, "name": n, "args": _arguments(a)} for k, (n, a) in calls.items()],
        "input_tokens": counts[0], "output_tokens": counts[1],
    }


def _arguments(raw: str) -> str | None:
    try:
        json.loads(raw or "{}")
    except ValueError:
        return None
    return raw or "{}"


def whole(fragments: dict) -> bool:
    """The completed fragment is there and all numbers before it; numbers may be texts, as in a state."""
    last = max((int(n) for n, x in fragments.items() if x[0] == "completed"), default=None)
    return last is not None and {int(n) for n in fragments}.issuperset(range(last + 1))


def _numbered(fragments: dict[str, list]) -> dict[int, list]:
    """Fragments of a state with their numbers and counts as such."""
    return {int(n): [*x[:4], *(None if c is None else int(c) for c in x[4:])] for n, x in fragments.items()}


def responses(stream: DataFrame, gap: str = "1 hour", late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """RESPONSE rows of a stream of fragments (response_id, seq, ts, PARTS); rows without response_id only move the time on."""
    import pandas as pd

    seconds = F.expr(f"CAST(INTERVAL {gap} AS INTERVAL SECOND)")
    millis = int(stream.sparkSession.range(1).select(F.extract(F.lit("SECOND"), seconds).cast("long")).first()[0]) * 1000

    def step(key, frames: Iterator, state) -> Iterator:
        # Of every open response: when it expires, and its fragments by number; of one that was emitted, DONE.
        held = json.loads(state.get[0]) if state.exists else {}
        now, latest, out = state.getCurrentWatermarkMs(), {}, []
        for frame in () if state.hasTimedOut else frames:
            for response, n, ms, *parts in zip(*(frame[c].tolist() for c in ("response_id", "seq", "_ms", *PARTS)), strict=True):
                if response is not None:
                    latest[response] = max(latest.get(response, 0), ms)
                    fragments = held.setdefault(response, [0, {}])[1]
                    if fragments != DONE:
                        fragments[str(n)] = parts
        for response, at in latest.items():
            fragments = held[response][1]
            if fragments != DONE and whole(fragments):
                out.append(assembled(response, _numbered(fragments), "completed"))
                fragments = DONE
            # A mark stays for as long, so that a fragment that comes again begins no new response.
            held[response] = [max(at, now) + millis, fragments]
        for response in [r for r, (expires, _) in held.items() if expires <= now]:
            fragments = held.pop(response)[1]
            if fragments != DONE:
                out.append(assembled(response, _numbered(fragments), "abandoned"))
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(min(expires for expires, _ in held.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out)

    # A filter would be pushed below the watermark, and the rows without response_id would not move it.
    watched = stream.withWatermark("ts", late)
    # Counts travel as text: with nulls among them pandas would make them doubles.
    sent = watched.select("response_id", "seq", "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("_ms"), *(F.col(c).cast("string").alias(c) for c in PARTS))
    bucketed = sent.withColumn("_bucket", F.pmod(F.xxhash64("response_id"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInPandasWithState(step, RESPONSE, "held string", "append", "EventTimeTimeout")


def at_once(fragments: DataFrame) -> DataFrame:
    """RESPONSE rows of a finished table of fragments: what the stream has to agree with."""
    import pandas as pd

    def of(key, frame):
        held = {int(n): [None if pd.isna(x) else int(x) if i > 3 else x for i, x in enumerate(parts)] for n, *parts in zip(frame["seq"], *(frame[c] for c in PARTS), strict=True)}
        return pd.DataFrame([assembled(key[0], held, "completed" if whole(held) else "abandoned")])

    return fragments.filter("response_id IS NOT NULL").groupBy("response_id").applyInPandas(of, RESPONSE)
