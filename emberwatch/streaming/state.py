"""Keyed state for streams: sliding counts, running totals and intervals, anchored groups (ST-04 … ST-06).

Rows are held until the watermark has passed their time bucket and are then taken in time order, so the result
equals that of the batch job on the same rows, whatever the order of arrival. Held rows lie in a map with
small entries: each batch adds chunks under (bucket, number) and never writes an older one again; a timer
per bucket takes its chunks and removes them. What a window needs of the past is kept alike, and ends by timer.

The state store must be RocksDB (``session.SETTINGS`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.network import BEACON_EVENTS, BEACON_GAPS, BEACON_VARIATION, EXFIL_BYTES, PORT_SCAN_PORTS, sent_bytes

#: length of a time bucket, and rows in one entry of the state
BUCKET_US, CHUNK = 10_000_000, 1000


def _ends(bucket: int) -> int:
    return (bucket + 1) * BUCKET_US


class InOrder(StatefulProcessor):
    """Holds rows (us, event_id and ``extra`` columns) until their bucket is over; ``take`` then gets them sorted."""

    extra: dict[str, str] = {}

    def init(self, handle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{c} array<{t}>" for c, t in {"us": "bigint", "event_id": "string", **self.extra}.items())
        self.pending = handle.getMapState("pending", "bucket bigint, chunk bigint", arrays)
        self.count = handle.getValueState("chunks", "n bigint")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        names = ["us", "event_id", *self.extra]
        for pdf in rows:
            for bucket, part in pdf[names].groupby(pdf["us"] // BUCKET_US, sort=False):
                for lo in range(0, len(part), CHUNK):
                    piece = part.iloc[lo : lo + CHUNK]
                    self.pending.updateValue((int(bucket), n), tuple(piece[c].tolist() for c in names))
                    n += 1
                self.handle.registerTimer(_ends(int(bucket)) // 1000)
        self.count.update((n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[int, list[int]] = {}
        for bucket, chunk in self.pending.keys():
            if _ends(bucket) <= now:
                due.setdefault(bucket, []).append(chunk)
        for bucket in sorted(due):
            parts = [self.pending.getValue((bucket, c)) for c in due[bucket]]
            us, ids, *more = (np.concatenate([np.asarray(p[i], dtype=object if i == 1 else np.int64) for p in parts]) for i in range(2 + len(self.extra)))
            order = np.lexsort((ids.astype(str), us))
            yield from self.take(key[0], us[order], ids[order], *[m[order] for m in more])
            for c in due[bucket]:
                self.pending.removeKey((bucket, c))
        yield from self.rest(key[0], now)

    def open(self, handle) -> None:
        """Further state."""

    def take(self, key, us, ids, *more) -> Iterator[pd.DataFrame]:
        """Rows of one bucket in order."""
        raise NotImplementedError

    def rest(self, key, now: int) -> Iterator[pd.DataFrame]:
        """What is over at this watermark."""
        return iter(())


class Sliding(InOrder):
    """Instants of the last window with their counts, a few hundred in an entry."""

    def __init__(self, threshold: int, width: int):
        self.threshold, self.width = threshold, width

    def open(self, handle) -> None:
        self.past = handle.getMapState("past", "bucket bigint, chunk bigint", "us array<bigint>, n array<bigint>")

    def take(self, key, us, ids):
        kept = sorted(tuple(k) for k in self.past.keys())
        seen = [self.past.getValue(k) for k in kept if _ends(k[0]) > us[0] - self.width]
        at, first_at, n = np.unique(us, return_index=True, return_counts=True)
        every = np.concatenate([*[np.asarray(s[0], np.int64) for s in seen], at])
        total = np.concatenate([[0], np.cumsum(np.concatenate([*[np.asarray(s[1], np.int64) for s in seen], n]))])
        first = np.searchsorted(every, at - self.width, side="left")
        hits = total[len(every) - len(at) + 1 :] - total[first]
        of_row = np.searchsorted(at, us)
        hit = hits[of_row] >= self.threshold
        if hit.any():
            yield pd.DataFrame({"key": key, "event_id": ids[hit], "us": us[hit], "first_us": every[first][of_row][hit], "hits": hits[of_row][hit]})
        for k in kept:
            if _ends(k[0]) <= us[-1] - self.width:
                self.past.removeKey(k)
        bucket = int(us[0] // BUCKET_US)
        for lo in range(0, len(at), CHUNK):
            self.past.updateValue((bucket, lo // CHUNK), (at[lo : lo + CHUNK].tolist(), n[lo : lo + CHUNK].tolist()))
        self.handle.registerTimer((_ends(bucket) + self.width) // 1000 + 1)

    def rest(self, key, now):
        for k in [tuple(k) for k in self.past.keys()]:
            if _ends(k[0]) + self.width < now:
                self.past.removeKey(k)
        return iter(())


class Pairs(InOrder):
    """Ports seen (an entry each), bytes sent, and count, sum and squares of the intervals of a pair."""

    extra = {"port": "bigint", "sent": "bigint", "talks": "bigint"}

    def __init__(self, ports: int, sent: int, ttl: int, tolerance: float, events: int, gaps: int):
        self.limits, self.ttl = (ports, sent, tolerance, events, gaps), ttl

    def open(self, handle) -> None:
        self.ports = handle.getMapState("ports", "port bigint", "seen boolean")
        self.totals = handle.getValueState("totals", "last bigint, sent bigint, talks bigint, talked bigint, gaps bigint, total double, squares double")

    def take(self, key, us, ids, port, sent, talks):
        last = self.totals.get()[0] if self.totals.exists() else None
        # a pair silent for longer than its state lives starts anew
        steps = np.diff(us, prepend=us[0] if last is None else last)
        cuts = np.r_[0, np.flatnonzero(steps > self.ttl), len(us)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                if steps[lo] > self.ttl:
                    self._forget()
                yield from self._run(key, us[lo:hi], ids[lo:hi], port[lo:hi], sent[lo:hi], talks[lo:hi] == 1)
        self.handle.registerTimer((int(us[-1]) + self.ttl) // 1000 + 1)

    def _run(self, key, us, ids, port, sent, talks):
        ports, sent_limit, tolerance, events, least_gaps = self.limits
        _, before, talked, talk_at, gap_n, gap_sum, gap_squares = self.totals.get() if self.totals.exists() else (0, 0, 0, None, 0, 0.0, 0.0)
        known = {k[0] for k in self.ports.keys()}
        new = np.zeros(len(us), np.int64)
        distinct, at = np.unique(port, return_index=True)
        for p, i in zip(distinct.tolist(), at):
            if p and p not in known:
                new[i] = 1
                self.ports.updateValue((p,), (True,))
        seen = len(known) + np.cumsum(new)
        total = before + np.cumsum(sent)
        # intervals between the rows that count as talk
        gaps = np.zeros(len(us))
        rows = np.flatnonzero(talks)
        if len(rows):
            gaps[rows] = np.diff(us[rows], prepend=us[rows[0]] if talk_at is None else talk_at) / 1e6
            talk_at = int(us[rows[-1]])
        some = talks & (gaps > 0)
        count, n = talked + np.cumsum(talks), gap_n + np.cumsum(some)
        sums, squares = gap_sum + np.cumsum(np.where(some, gaps, 0)), gap_squares + np.cumsum(np.where(some, gaps * gaps, 0))
        mean = sums / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0))
        beacon = talks & (count >= events) & (n >= least_gaps) & (spread < tolerance * mean)
        for kind, hit, value in (("port_scan", (port != 0) & (seen >= ports), seen), ("data_exfiltration", (sent != 0) & (total >= sent_limit), total), ("beaconing", beacon, count)):
            if hit.any():
                yield pd.DataFrame({"pair": key, "event_id": ids[hit], "threat_type": kind, "value": value[hit]})
        self.totals.update((int(us[-1]), int(total[-1]), int(count[-1]), talk_at, int(n[-1]), float(sums[-1]), float(squares[-1])))

    def _forget(self) -> None:
        self.ports.clear()
        self.totals.clear()

    def rest(self, key, now):
        if self.totals.exists() and self.totals.get()[0] + self.ttl < now and not any(True for _ in self.pending.keys()):
            self._forget()
        return iter(())


class Anchored(InOrder):
    """The open group: its first and last instant and its size."""

    def __init__(self, width: int):
        self.width = width

    def open(self, handle) -> None:
        self.group = handle.getValueState("group", "anchor bigint, last bigint, n bigint")

    def take(self, key, us, ids):
        anchor, last, n = self.group.get() if self.group.exists() else (None, None, 0)
        out, i = [], 0
        while i < len(us):
            if anchor is None:
                anchor = int(us[i])
            j = int(np.searchsorted(us, anchor + self.width, side="right"))
            if j > i:
                last, n, i = int(us[j - 1]), n + j - i, j
            if i < len(us):
                out.append((key, anchor, last, n))
                anchor, n = None, 0
        if out:
            yield pd.DataFrame(out, columns=["key", "start_us", "end_us", "findings"])
        self.group.update((anchor, last, n))
        self.handle.registerTimer(_ends((anchor + self.width) // BUCKET_US) // 1000)

    def rest(self, key, now):
        if self.group.exists():
            anchor, last, n = self.group.get()
            # no bucket can still bring a row of the group
            if _ends((anchor + self.width) // BUCKET_US) <= now:
                self.group.clear()
                yield pd.DataFrame([(key, anchor, last, n)], columns=["key", "start_us", "end_us", "findings"])


def _keyed(events: DataFrame, key: str, delay: str, processor: InOrder, schema: str) -> DataFrame:
    rows = events.withWatermark("timestamp", delay).filter(F.col("timestamp").isNotNull()).select(
        "timestamp", F.col(key).cast("string").alias("k"), F.col("event_id").cast("string").alias("event_id"), F.unix_micros("timestamp").alias("us"), *processor.extra)
    return rows.groupBy("k").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def sliding_alerts(events: DataFrame, key: str, threshold: int, window_sec: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Events at which their key has ``threshold`` or more rows in the window, as in the batch job."""
    return _keyed(events, key, delay, Sliding(threshold, window_sec * 1_000_000), "key string, event_id string, us bigint, first_us bigint, hits bigint")


def running_pairs(
    flows: DataFrame, port_threshold: int = PORT_SCAN_PORTS, byte_threshold: int = EXFIL_BYTES, ttl_sec: int = 86_400, delay: str = "10 minutes",
    tolerance: float = BEACON_VARIATION, min_events: int = BEACON_EVENTS,
) -> DataFrame:
    """Port scans, exfiltration and beacons per pair, with state that ends ``ttl_sec`` after the last event.

    ``flows`` carries event_id, timestamp, source_ip, destination_ip, destination_port, bytes_out. ``value`` is the
    number of ports, of bytes, or of connections so far.
    """
    from ..functions.network import is_external

    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    flows = flows.filter(some("source_ip")).withColumns({
        "pair": F.concat_ws(":", "source_ip", F.coalesce("destination_ip", F.lit(""))), "port": F.coalesce(F.col("destination_port").cast("bigint"), F.lit(0).cast("bigint")),
        "sent": F.when(is_external("destination_ip"), sent_bytes(flows)).otherwise(0).cast("bigint"), "talks": some("destination_ip").cast("bigint")})
    return _keyed(flows, "pair", delay, Pairs(port_threshold, byte_threshold, ttl_sec * 1_000_000, tolerance, min_events, BEACON_GAPS),
                  "pair string, event_id string, threat_type string, value bigint")


def anchored_groups(findings: DataFrame, key: str, window_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Groups that take everything within the window of their first finding; emitted when they can no longer grow."""
    return _keyed(findings, key, delay, Anchored(window_minutes * 60_000_000), "key string, start_us bigint, end_us bigint, findings bigint")
