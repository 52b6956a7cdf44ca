"""Request limits per client: sliding windows by sorted times, restarting windows as carried state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import written

SECOND = 1_000_000
VERDICT = "limited boolean, reason string, retry_after int, minute_remaining int, hour_remaining int"


@dataclass(frozen=True)
class Limits:
    """(calls, seconds) for the burst, the short and the long window."""

    # Default limits.
    burst: tuple[int, int] = (10, 1)
    minute: tuple[int, int] = (60, 60)
    hour: tuple[int, int] = (1000, 3600)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rate_limit_sliding(
    calls: DataFrame, client: str, ts: str, key: str, limits: Limits = Limits(), slot_seconds: int | None = None
) -> DataFrame:
    """(client, key, limited, reason, retry_after, minute_remaining, hour_remaining) with sliding windows.

    Every call counts, refused or not; calls of one client at the same instant count once. A group is
    one client in one time slot, as long as the longest window by default, with the end of the slot before copied in,
    so a busy client is spread over as many tasks as it has slots. Inside a group the counts are positions in the sorted
    times: a range window in SQL would add up every frame again and take quadratic time.
    """
    reach = max(limits.burst[1], limits.minute[1], limits.hour[1]) * SECOND
    slot = slot_seconds * SECOND if slot_seconds else reach
    if reach > slot:
        raise ValueError("a slot must be as long as the longest window")
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    lines = calls.select(F.col(client).alias("client"), F.col(key).alias("key"), micros(F.col(ts)).alias("us"))
    own = F.floor(F.col("us") / slot)
    homes = F.when(F.col("us") % slot >= slot - reach, F.array(own, own + 1)).otherwise(F.array(own))
    placed = lines.withColumn("slot", F.explode(homes)).withColumn("copy", F.col("slot") > own)

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "key"])
        now = rows["us"].to_numpy()
        times = np.unique(now)
        place = np.searchsorted(times, now)
        again = np.concatenate(([False], now[1:] == now[:-1]))

        def opened(seconds: int) -> np.ndarray:
            return np.searchsorted(times, now - seconds * SECOND, side="right")

        def left(limit: tuple[int, int]) -> np.ndarray:
            used = place + 1 - np.searchsorted(times, now - limit[1] * SECOND, side="left")
            return np.maximum(0, limit[0] - used)

        def wait(limit: tuple[int, int]) -> np.ndarray:
            age = now - times[opened(limit[1])]
            return np.maximum(1, (limit[1] * SECOND - age) // SECOND)

        order = (("burst", limits.burst), ("minute", limits.minute), ("hour", limits.hour))
        over = [place - opened(limit[1]) + again >= limit[0] for _, limit in order]
        out = rows[["client", "key"]].copy()
        out["limited"] = over[0] | over[1] | over[2]
        out["reason"] = np.select(over, [name for name, _ in order], "")
        out["reason"] = out["reason"].where(out["limited"], None)
        out["retry_after"] = pd.array(np.select(over, [np.ones_like(now), wait(limits.minute), wait(limits.hour)], 0), dtype="Int32")
        out["retry_after"] = out["retry_after"].where(out["limited"], pd.NA)
        out["minute_remaining"], out["hour_remaining"] = left(limits.minute), left(limits.hour)
        return out[~rows["copy"].to_numpy()]

    return placed.groupBy("client", "slot").applyInPandas(judge, f"client {kinds[client]}, key {kinds[key]}, {VERDICT}")


# Restarting windows

# What a client carries from one part of its calls to the next: the open windows, how much of them is used, and the accepted
# calls that the burst window may still hold.
STATE = "minute_start bigint, hour_start bigint, minute_used int, hour_used int, burst array<bigint>"
FIELDS = [part.split()[0] for part in STATE.split(", ")]
NOTHING = (None, None, 0, 0, ())
WINDOWS = ("minute", "hour")


def following(times: np.ndarray, seconds: int) -> np.ndarray:
    """For a window that starts at each call: place of the call that starts the next one. Refused calls start windows too,
    so this depends on the times alone."""
    return np.searchsorted(times, times + seconds * SECOND, side="right")


def window_starts(times: np.ndarray, seconds: int, open_since: int | None) -> np.ndarray:
    """Places of the calls that start a window, given the start of the window that is open before the first call."""
    after = following(times, seconds)
    at = 0 if open_since is None else int(np.searchsorted(times, open_since + seconds * SECOND, side="right"))
    starts = []
    while at < len(times):
        starts.append(at)
        at = int(after[at])
    return np.array(starts, dtype=np.int64)


def last_starts(times: np.ndarray, seconds: int) -> tuple[list[int], list[int]]:
    """(ended, last): when the window before ran out at ``ended[i]`` or later, but before ``ended[i + 1]``, the last window of
    these calls starts at ``last[i]``. Only calls within one window of the first can be the first to start one."""
    n = len(times)
    jumps = [np.append(following(times, seconds), n)]
    while (jumps[-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    first = np.arange(min(n, int(np.searchsorted(times, times[0] + seconds * SECOND, side="right")) + 1))
    first = first[first < n]
    last = first.copy()
    for jump in reversed(jumps):
        last = np.where(jump[last] < n, jump[last], last)
    steps = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
    ended = np.where(steps > 0, times[np.maximum(steps - 1, 0)], np.iinfo(np.int64).min)
    return ended.tolist(), times[last[steps]].tolist()


def judged(times: np.ndarray, limits: Limits, entry: tuple = NOTHING) -> tuple[pd.DataFrame, tuple]:
    """Verdicts of sorted calls of one client, and what the client carries on.

    Windows come from the times. Between two window starts the limits only have so much room left, and calls are accepted until
    it is used up: the next accepted call is the first one after the last that the burst window admits, so the
    search jumps from one accepted call to the next and refused calls cost nothing.
    """
    minute_start, hour_start, minute_used, hour_used, burst = entry
    most, span = limits.burst[0], limits.burst[1] * SECOND
    n = len(times)
    caps = {"minute": limits.minute, "hour": limits.hour}
    open_since = {"minute": minute_start, "hour": hour_start}
    used = {"minute": minute_used, "hour": hour_used}
    starts = {w: window_starts(times, caps[w][1], open_since[w]) for w in WINDOWS}
    edges = np.unique(np.concatenate(([0, n], *starts.values()))).astype(np.int64)
    accepted = np.zeros(n, bool)
    recent = [int(t) for t in burst]
    for lo, hi in zip(edges, edges[1:]):
        for w in WINDOWS:
            if lo in starts[w]:
                used[w] = 0
        room, at = min(caps[w][0] - used[w] for w in WINDOWS), int(lo)
        taken = 0
        while taken < room:
            if len(recent) >= most:
                at = max(at, int(np.searchsorted(times, recent[-most] + span, side="left"))) if most else n
            if at >= hi:
                break
            accepted[at] = True
            recent.append(int(times[at]))
            at, taken = at + 1, taken + 1
        for w in WINDOWS:
            used[w] += taken
        recent = recent[-most:] if most else []

    total = np.concatenate(([0], np.cumsum(accepted)))
    own, carried = times[accepted], np.array(burst, dtype=np.int64)
    before = total[:-1] + len(carried)
    in_burst = before - np.searchsorted(np.concatenate((carried, own)), times - span, side="right")
    out, over = pd.DataFrame(index=range(n)), {"burst": np.minimum(in_burst, before) >= most}
    since, held = {}, {}
    for w, first_used in zip(WINDOWS, (minute_used, hour_used)):
        number = np.searchsorted(starts[w], np.arange(n), side="right")
        known = np.concatenate(([0], starts[w]))
        fresh = number > 0
        since[w] = np.where(fresh, times[known[number]] if n else 0, open_since[w] or 0)
        held[w] = total[:-1] - np.where(fresh, total[known[number]], 0) + np.where(fresh, 0, first_used)
        over[w] = held[w] >= caps[w][0]
    refused = [over["burst"], over["minute"], over["hour"]]
    wait = [np.maximum(1, (caps[w][1] * SECOND - (times - since[w])) // SECOND) for w in WINDOWS]
    out["limited"] = ~accepted
    out["reason"] = np.select(refused, ["burst", "minute", "hour"], "")
    out["reason"] = out["reason"].where(out["limited"], None)
    out["retry_after"] = pd.array(np.select(refused, [np.ones(n, np.int64), *wait], 0), dtype="Int32")
    out["retry_after"] = out["retry_after"].where(out["limited"], pd.NA)
    for w in WINDOWS:
        out[f"{w}_remaining"] = np.maximum(0, caps[w][0] - held[w] - accepted)
    opened = [int(times[starts[w][-1]]) if len(starts[w]) else open_since[w] for w in WINDOWS]
    return out, (*opened, used["minute"], used["hour"], tuple(recent))


def _carried(row) -> tuple:
    """State of a Spark struct (as mapping) or row."""
    if row is None:
        return NOTHING
    whole = [None if row[f] is None or pd.isna(row[f]) else int(row[f]) for f in FIELDS[:2]]
    return (*whole, int(row["minute_used"]), int(row["hour_used"]), tuple(int(t) for t in row["burst"]))


def _chained(maps: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """Starts of the windows that are open when each slice of one client begins, along the short tables of its slices."""
    maps = maps.sort_values("slice")
    out = {"client": maps["client"], "slice": maps["slice"]}
    for w, (_, seconds) in (("minute", limits.minute), ("hour", limits.hour)):
        entering, since = [], None
        for end, ended, last in zip(maps["end"], maps[f"{w}_ended"], maps[f"{w}_last"]):
            entering.append(since)
            over = np.iinfo(np.int64).min if since is None else since + seconds * SECOND
            if over < end:
                since = int(last[int(np.searchsorted(ended, over, side="right")) - 1])
        out[f"{w}_start"] = pd.array(entering, dtype="Int64")
    return pd.DataFrame(out)


def _still_open(state: Column, first: Column, limits: Limits) -> Column:
    """The part of a state that matters at a later first call; what ran out is the same as nothing."""
    minute = F.coalesce(first - state["minute_start"] <= limits.minute[1] * SECOND, F.lit(False))
    hour = F.coalesce(first - state["hour_start"] <= limits.hour[1] * SECOND, F.lit(False))
    burst = F.filter(state["burst"], lambda t: first - t < limits.burst[1] * SECOND)
    return F.struct(
        F.when(minute, state["minute_start"]).alias("minute_start"), F.when(hour, state["hour_start"]).alias("hour_start"),
        F.when(minute, state["minute_used"]).otherwise(0).alias("minute_used"),
        F.when(hour, state["hour_used"]).otherwise(0).alias("hour_used"), burst.alias("burst"),
    )


# Rounds in which all slices with a wrong entry are judged again; after that only those behind a settled slice, so that a long
# chain repeats each slice a bounded number of times.
EAGER_ROUNDS = 3


def rate_limit_fixed(
    calls: DataFrame, client: str, ts: str, key: str, limits: Limits = Limits(), slice_seconds: int | None = None
) -> DataFrame:
    """(client, key, limited, reason, retry_after, minute_remaining, hour_remaining) with restarting windows.

    The timeline is cut into slices that run in parallel. Where windows start depends on the call times alone: every
    slice gives a short table from "the window before ran out then" to "my last window starts then", and the tables of a client
    are chained. Slices are then judged with their windows known and nothing used, and again where the use carried in turns
    out to differ, until none does. As a slice spans many windows (24 of the longest by default), what it carries out
    rarely depends on what it carried in, and two rounds are the rule; only a client whose limits stay exhausted
    over whole slices makes more. A client with a third of all calls runs on as many tasks as it has slices.
    """
    slice_seconds = slice_seconds or 24 * max(limits.minute[1], limits.hour[1])
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    head = f"client {kinds[client]}, slice bigint"
    us = micros(F.col(ts))
    lines = written(calls.select(
        F.col(client).alias("client"), F.col(key).alias("key"), us.alias("us"), F.floor(us / (slice_seconds * SECOND)).alias("slice")
    ), "calls")

    def tabled(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["us"].to_numpy())
        minute, hour = last_starts(times, limits.minute[1]), last_starts(times, limits.hour[1])
        return pd.DataFrame([(rows["client"].iloc[0], rows["slice"].iloc[0], int(times[0]), int(times[-1]), *minute, *hour)],
                            columns=["client", "slice", "first", "end", "minute_ended", "minute_last", "hour_ended", "hour_last"])

    tables = written(lines.groupBy("client", "slice").applyInPandas(tabled, f"{head}, first bigint, end bigint, " + ", ".join(
        f"{w}_{c} array<bigint>" for w in WINDOWS for c in ("ended", "last"))), "windows")
    starts = tables.groupBy("client").applyInPandas(
        lambda maps: _chained(maps, limits), f"{head}, minute_start bigint, hour_start bigint")
    fresh = F.struct("minute_start", "hour_start", F.lit(0).alias("minute_used"), F.lit(0).alias("hour_used"),
                     F.array().cast("array<bigint>").alias("burst"))
    known = tables.select("client", "slice", "first").join(starts, [tables["client"].eqNullSafe(starts["client"]), tables["slice"] == starts["slice"]])
    entries = written(known.select(
        tables["client"], tables["slice"], "first", _still_open(fresh, F.col("first"), limits).alias("entry")), "entries")
    state_type = "struct<" + ", ".join(p.replace(" ", ":", 1) for p in STATE.split(", ")) + ">"

    def leave(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or entry.empty:
            return pd.DataFrame(columns=["client", "slice", "exit"])
        _, state = judged(np.sort(rows["us"].to_numpy()), limits, _carried(entry["entry"].iloc[0]))
        return pd.DataFrame({
            "client": [entry["client"].iloc[0]], "slice": [entry["slice"].iloc[0]], "exit": [dict(zip(FIELDS, (*state[:4], list(state[4]))))],
        })

    def verdicts(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "key"]).reset_index(drop=True)
        out, _ = judged(rows["us"].to_numpy(), limits, _carried(entry["entry"].iloc[0]))
        return pd.concat([rows[["client", "key"]], out], axis=1)

    def run(todo: DataFrame) -> DataFrame:
        rows = lines.join(todo.select(F.col("client").alias("_c"), F.col("slice").alias("_s")), F.expr("client <=> _c AND slice = _s"), "left_semi")
        return rows.groupBy("client", "slice").cogroup(todo.groupBy("client", "slice")).applyInPandas(leave, f"{head}, exit {state_type}")

    exits, turn = written(run(entries), "exits"), 0
    while True:
        turn += 1
        before = Window.partitionBy("client").orderBy("slice")
        left = exits.select(F.col("client").alias("_c"), F.col("slice").alias("_s"), "exit")
        joined = entries.join(left, F.expr("client <=> _c AND slice = _s")).withColumn("_prior", F.lag("exit").over(before))
        implied = F.when(F.col("_prior").isNull(), F.col("entry")).otherwise(_still_open(F.col("_prior"), F.col("first"), limits))
        checked = joined.withColumn("_entry", implied).withColumn("stale", ~F.col("_entry").eqNullSafe(F.col("entry")))
        if turn > EAGER_ROUNDS:
            settled = ~F.coalesce(F.lag("stale").over(before), F.lit(False))
            checked = checked.withColumn("again", F.col("stale") & settled)
        else:
            checked = checked.withColumn("again", F.col("stale"))
        checked = written(checked.select(
            "client", "slice", "first", F.when(F.col("again"), F.col("_entry")).otherwise(F.col("entry")).alias("entry"), "exit", "again"), "entries")
        entries = checked.drop("exit", "again")
        again = checked.filter("again")
        if again.isEmpty():
            break
        redone = run(again.select("client", "slice", "first", "entry"))
        exits = written(checked.filter("NOT again").select("client", "slice", "exit").unionByName(redone), "exits")
    return lines.groupBy("client", "slice").cogroup(entries.groupBy("client", "slice")).applyInPandas(
        verdicts, f"client {kinds[client]}, key {kinds[key]}, {VERDICT}"
    )


def rate_limit_fixed_stream(
    calls: DataFrame, client: str, ts: str, key: str, limits: Limits = Limits(), late: str | None = None
) -> DataFrame:
    """The same verdicts on a stream, state kept per client between micro-batches.

    Calls are put in time order inside a micro-batch; the trigger's size bounds what one client brings. Calls
    later than ``late`` (twice the longest window by default) are left out, and the state of a client that has been silent for the
    longest window is forgotten once the watermark has passed it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    longest = max(limits.minute[1], limits.hour[1])

    def step(who, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "key"]).reset_index(drop=True)
        out, left = judged(rows["us"].to_numpy(), limits, _carried(dict(zip(FIELDS, state.get))) if state.exists else NOTHING)
        state.update((*left[:4], list(left[4])))
        state.setTimeoutTimestamp(max(int(rows["us"].iloc[-1]) // 1000 + longest * 1000, state.getCurrentWatermarkMs() + 1) + 1)
        out.insert(0, "key", rows["key"].to_numpy())
        out.insert(0, "client", who[0])
        yield out

    timed = calls.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late or f"{2 * longest} seconds")
    keyed = timed.select(F.col(client).alias("client"), F.col(key).alias("key"), micros(F.col(ts)).alias("us"), "_at")
    return keyed.groupBy("client").applyInPandasWithState(
        step, f"client {kinds[client]}, key {kinds[key]}, {VERDICT}", STATE, "append", "EventTimeTimeout"
    )
