"""Streaming detectors: one stateful processor driven by a detector policy.

Input is a packet stream (``schemas.PACKET``). State per key is a row of scalars, a map entry per port and address and a list
of times; event-time timers score keys that fall silent and delete profiles whose window is over. The same processor runs
over a bounded table with ``trigger(availableNow)``. Rows of a key in one micro-batch are merged in time order, so the source
must bound its batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch import config
from tidewatch.config import DetectorConfig
from tidewatch.functions.addresses import is_private_ip
from tidewatch.functions.packets import ACK, FIN, RST, SYN
from tidewatch.operators.windows import both_ends
from tidewatch.streaming.profiles import SCALARS, Profile, policy_for
from tidewatch.streaming.scoring import FLOW_SCALARS, FlowScorer
from tidewatch.streaming.state import Counts, ListStore, MapStore, in_order

RESULT = ("key string, engine string, win_start_us bigint, detected_at_us bigint, syn_count bigint, score double, "
          "alert boolean, suppress_reason string, reason string, features array<double>")
_COLS = [c.split()[0] for c in RESULT.split(", ")]
_TOTALS = ("distinct bigint", "total bigint", "nlogn double", "most bigint")
_COUNTED = {"ports": "value int", "ips": "value string", "sports": "value int"}


def row_schema(scalars: dict, counted=()) -> str:
    kinds = {bool: "boolean", float: "double", int: "bigint"}
    return ", ".join([*(f"{k} {kinds[type(v)]}" for k, v in scalars.items()), *(f"{c}_{t}" for c in counted for t in _TOTALS)])


def totals(counts: Counts) -> tuple:
    return counts.distinct, counts.total, counts.nlogn, counts.most


def restore(counts: Counts, values) -> None:
    counts.distinct, counts.total, counts.nlogn, counts.most = values


def _frame(key: str, engine: str, found: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"key": key, "engine": engine, **f} for f in found], columns=_COLS)


class ProfileProcessor(StatefulProcessor):
    """Folds the events of a key in time order."""

    def __init__(self, cfg: DetectorConfig, score):
        self.cfg, self.score = cfg, score

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("profile", row_schema(SCALARS, _COUNTED))
        self.maps = {name: handle.getMapState(name, kind, "n bigint") for name, kind in _COUNTED.items()}
        self.times = handle.getListState("times", "ts bigint")

    def _load(self, key: str) -> tuple[Profile | None, Profile]:
        """The profile of the key, or None, and the profile that new windows are opened in: both use the same stores.

        Every call of a state is a round trip, so what the row tells is not asked again: maps without a value and, where no SYN
        was met, the list of times are known to be empty."""
        row = self.state.get()
        known = dict(zip(SCALARS, row)) if row else {}
        stores = {name: MapStore(s, not (row and row[len(SCALARS) + i * len(_TOTALS)])) for i, (name, s) in enumerate(self.maps.items())}
        p = Profile(**stores, times=ListStore(self.times, not known.get("syn")))
        p["key"] = key
        self.policy = policy_for(self.cfg, self.score, lambda: p)
        if row is None:
            return None, p
        n = len(SCALARS)
        p.update(zip(SCALARS, row[:n]))
        for i, name in enumerate(_COUNTED):
            restore(getattr(p, name), row[n + 4 * i:n + 4 * i + 4])
        return p, p

    def _save(self, p: Profile | None, held: Profile) -> None:
        if p is None:
            for part in (held.ports, held.ips, held.sports, held.times):
                part.clear()
            self.state.clear()
            return
        for part in (p.ports.store, p.ips.store, p.sports.store, p.times):
            part.flush()
        self.state.update((*(p[k] for k in SCALARS), *(x for name in _COUNTED for x in totals(getattr(p, name)))))
        due = self.policy.due(p)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name = str(key[0])
        p, held = self._load(name)
        before, found = p is not None, []
        for e in in_order(rows):
            if self.cfg.key == "endpoint":
                held["port"] = int(e.dst_port)
            p, out = self.policy.step(p, e)
            found += out
        if p is not None or before:
            self._save(p, held)
        if found:
            yield _frame(name, self.cfg.engine, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name = str(key[0])
        p, held = self._load(name)
        if p is None:
            return
        if self.cfg.key == "endpoint":
            held["port"] = int(name.rsplit(":", 1)[1])
        p, found = self.policy.on_timer(p, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(p, held)
        if found:
            yield _frame(name, self.cfg.engine, found)

    def close(self) -> None:
        pass


def with_watermark(packets: DataFrame, cfg: DetectorConfig, lateness: str | None = None) -> DataFrame:
    """Watermark on ``ts``; the default lateness is the window length."""
    return packets.withWatermark("ts", lateness or f"{cfg.window_sec or 60} seconds")


def detect_stream(packets: DataFrame, cfg: DetectorConfig, score, lateness: str | None = None) -> DataFrame:
    """Scored windows of one detector as a stream. ``score`` maps a raw feature list to a probability."""
    rows = with_watermark(packets, cfg, lateness)
    columns = ["ts", "ts_us", "event_id", "src_port", "dst_port", "proto", "flags", "payload_len", "tcp_win"]
    syn = (F.col("proto") == 6) & (F.col("flags").bitwiseAND(SYN | ACK) == SYN)
    # Rows that cannot change a profile, and unused columns, are dropped before the shuffle. The tests mention the event
    # time, which keeps them above the watermark: every packet moves the clock, dropped or not.
    def only(test):
        return F.when(F.col("ts").isNotNull(), test)
    if cfg.engine in ("bruteforce", "bot"):
        rows = both_ends(rows.filter(only(F.col("proto") == 6))).withColumn("key", F.col("ip"))
        columns += ["role", "ip", "peer_ip"]
        if cfg.private_only:
            rows = rows.filter(only(is_private_ip("ip")))
    elif cfg.key == "endpoint":
        rows = rows.filter(only(syn | (F.col("proto") == 17)))
        rows = rows.withColumn("key", F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))
        columns += ["src_ip", "dst_ip"]
    else:
        rows = rows.filter(only(syn)) if cfg.engine == "dos_agg" else rows
        rows = rows.withColumn("key", F.col("src_ip"))
        columns += ["src_ip", "dst_ip"]
    return rows.select("key", *columns).groupBy("key").transformWithStateInPandas(
        ProfileProcessor(cfg, score), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def detect_scan_stream(packets: DataFrame, score, cfg: DetectorConfig = config.SCAN, **kw) -> DataFrame:
    return detect_stream(packets, cfg, score, **kw)


def detect_flood_stream(packets: DataFrame, score, cfg: DetectorConfig = config.FLOOD, **kw) -> DataFrame:
    return detect_stream(packets, cfg, score, **kw)


def detect_endpoint_stream(packets: DataFrame, score, cfg: DetectorConfig = config.ENDPOINT, **kw) -> DataFrame:
    return detect_stream(packets, cfg, score, **kw)


def detect_auth_stream(packets: DataFrame, score, cfg: DetectorConfig = config.AUTH, **kw) -> DataFrame:
    return detect_stream(packets, cfg, score, **kw)


def detect_client_stream(packets: DataFrame, score, cfg: DetectorConfig = config.CLIENT, **kw) -> DataFrame:
    return detect_stream(packets, cfg, score, **kw)


# ---------------------------------------------------------------- per-flow scoring

FLOW_RESULT = "key string, packets bigint, detected_at_us bigint, score double, alert boolean, features array<double>"


class FlowProcessor(StatefulProcessor):
    """Scores a flow once, at its N-th packet or when it closes; later packets are ignored.

    State is one row of scalars. It is removed ``forget_sec`` after the last packet.
    """

    def __init__(self, cfg: DetectorConfig, score, min_close: int = 1, forget_sec: int = 300):
        self.cfg, self.score, self.min_close, self.forget_sec = cfg, score, min_close, forget_sec

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", row_schema(FLOW_SCALARS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f = dict(zip(FLOW_SCALARS, self.state.get())) if self.state.exists() else FlowScorer.empty()
        found = []
        for e in in_order(rows):
            f["seen"] = max(f["seen"], int(e.ts_us))
            if f["done"]:
                continue
            FlowScorer.add(f, e)
            closing = e.proto == 6 and e.flags & (FIN | RST) and f["n"] >= self.min_close
            if f["n"] >= self.cfg.max_packets or closing:
                raw = FlowScorer.features(f)
                s = float(self.score(raw))
                alert = s > self.cfg.threshold and int(f["port"]) not in self.cfg.suppress_ports
                found.append((str(key[0]), f["n"], int(e.ts_us), s, bool(alert), raw))
                f["done"] = True
        self.state.update(tuple(f[k] for k in FLOW_SCALARS))
        self.handle.registerTimer((f["seen"] + self.forget_sec * 1_000_000) // 1000 + 1)
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FLOW_RESULT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            f = dict(zip(FLOW_SCALARS, self.state.get()))
            if expiredTimerInfo.getExpiryTimeInMs() * 1000 >= f["seen"] + self.forget_sec * 1_000_000:
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def score_flow_stream(packets: DataFrame, score, cfg: DetectorConfig = config.FLOW, min_close: int = 1, forget_sec: int = 300,
                      lateness: str = "60 seconds") -> DataFrame:
    return with_watermark(packets, cfg, lateness).withColumn("key", F.col("flow_key")).groupBy("key").transformWithStateInPandas(
        FlowProcessor(cfg, score, min_close, forget_sec), outputStructType=FLOW_RESULT, outputMode="Append", timeMode="EventTime")


# ---------------------------------------------------------------- SYN-rate gate

GATE_RESULT = "key string, ts_us bigint, syn_rate bigint, dst_ips bigint, dst_ports bigint, attack_pattern boolean"


_GATE = {"start": -1, "n": 0, "hit": False, "since": -1}


class SynRateProcessor(StatefulProcessor):
    """SYNs per anchored window of a source; its addresses and ports, one map entry each, live until the source goes stale."""

    columns = [c.split()[0] for c in GATE_RESULT.split(", ")]

    def __init__(self, window_sec: int = 60, min_rate: int = 30, max_ip_ratio: float = 0.5, max_port_ratio: float = 0.3):
        self.window_sec, self.min_rate, self.max_ip, self.max_port = window_sec, min_rate, max_ip_ratio, max_port_ratio

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", row_schema(_GATE, ("ips", "ports")))
        self.maps = {"ips": handle.getMapState("gate_ips", "value string", "n bigint"), "ports": handle.getMapState("gate_ports", "value int", "n bigint")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row, found = self.state.get() if self.state.exists() else None, []
        g = dict(_GATE) if row is None else dict(zip(_GATE, row))
        ips, ports = (Counts(MapStore(self.maps[m], row is None)) for m in ("ips", "ports"))
        if row is not None:
            restore(ips, row[4:8]), restore(ports, row[8:12])
        for e in in_order(rows):
            ips.add(e.dst_ip), ports.add(int(e.dst_port))
            if g["start"] < 0 or e.ts_us - g["start"] >= self.window_sec * 1_000_000:
                g["start"], g["n"] = int(e.ts_us), 1
            else:
                g["n"] += 1
            n = g["n"]
            hit = n >= self.min_rate and ips.distinct / n < self.max_ip and ports.distinct / n < self.max_port
            found += self.told(str(key[0]), g, int(e.ts_us), hit, (n, ips.distinct, ports.distinct))
        ips.store.flush(), ports.store.flush()
        self.state.update((*(g[k] for k in _GATE), *totals(ips), *totals(ports)))
        self.handle.registerTimer((g["start"] + 2 * self.window_sec * 1_000_000) // 1000 + 1)
        if found:
            yield pd.DataFrame(found, columns=self.columns)

    def told(self, key: str, g: dict, now_us: int, hit: bool, counts: tuple[int, int, int]) -> list[tuple]:
        """Rows to put out when the gate is ``hit`` at a time; here one for each change."""
        if hit == g["hit"]:
            return []
        g["hit"] = hit
        return [(key, now_us, *counts, hit)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            g, now = dict(zip(_GATE, self.state.get())), expiredTimerInfo.getExpiryTimeInMs() * 1000
            if now > g["start"] + 2 * self.window_sec * 1_000_000:
                self.state.clear()
                for m in self.maps.values():
                    m.clear()
                found = self.told(str(key[0]), g, now, False, (0, 0, 0))
                if found:
                    yield pd.DataFrame(found, columns=self.columns)

    def close(self) -> None:
        pass


def syn_rate_gate_stream(packets: DataFrame, window_sec: int = 60, lateness: str | None = None, **limits) -> DataFrame:
    """Changes of the gate per source (opened / closed)."""
    syn = F.when(F.col("ts").isNotNull(), (F.col("proto") == 6) & (F.col("flags").bitwiseAND(SYN | ACK) == SYN))
    return packets.withWatermark("ts", lateness or f"{window_sec} seconds").filter(syn).withColumn("key", F.col("src_ip")).groupBy("key").transformWithStateInPandas(
        SynRateProcessor(window_sec, **limits), outputStructType=GATE_RESULT, outputMode="Append", timeMode="EventTime")


PIECES = "key string, from_us bigint, until_us bigint"


class OpenPieces(SynRateProcessor):
    """Stretches of time in which the gate is open, from the SYN that finds it open to a later SYN or the end of the source's
    state. A stretch is put out when the gate closes, or at the first SYN that comes ``window_sec`` or more after its start."""

    columns = [c.split()[0] for c in PIECES.split(", ")]

    def told(self, key: str, g: dict, now_us: int, hit: bool, counts: tuple[int, int, int]) -> list[tuple]:
        out = []
        if g["hit"] and (not hit or now_us - g["since"] >= self.window_sec * 1_000_000):
            out, g["since"] = [(key, g["since"], now_us)], now_us
        if hit and not g["hit"]:
            g["since"] = now_us
        g["hit"] = hit
        return out


def open_gate_stream(packets: DataFrame, window_sec: int = 60, lateness: str | None = None, **limits) -> DataFrame:
    """Stretches per source in which the gate is open, none longer than three windows."""
    syn = F.when(F.col("ts").isNotNull(), (F.col("proto") == 6) & (F.col("flags").bitwiseAND(SYN | ACK) == SYN))
    return packets.withWatermark("ts", lateness or f"{window_sec} seconds").filter(syn).withColumn("key", F.col("src_ip")).groupBy("key").transformWithStateInPandas(
        OpenPieces(window_sec, **limits), outputStructType=PIECES, outputMode="Append", timeMode="EventTime")


def gated_flows_stream(scores: DataFrame, pieces: DataFrame, threshold: float, window_sec: int = 60, lateness: str = "60 seconds") -> DataFrame:
    """Class of each scored flow at its scoring time: ``attack`` if its score is above the threshold and its client's gate was
    open, ``held`` if the gate was closed, else ``benign``.

    A stream of scores and a stream of open stretches meet in a left outer join under their own watermarks; the time range of
    the join lets either side's state go."""
    s = scores.withColumn("at", F.timestamp_micros("detected_at_us")).withWatermark("at", lateness).select(
        "key", F.substring_index("key", "-", 1).alias("client"), "at", "score")
    g = pieces.withColumn("until", F.timestamp_micros("until_us")).withWatermark("until", lateness).select(
        F.col("key").alias("source"), F.timestamp_micros("from_us").alias("since"), "until")
    reach = F.expr(f"INTERVAL {3 * window_sec} SECONDS")
    both = s.join(g, (F.col("client") == F.col("source")) & (F.col("at") >= F.col("since")) & (F.col("at") < F.col("until"))
                  & (F.col("at") >= F.col("until") - reach), "left")
    hot = F.col("score") > threshold
    return both.select("key", F.unix_micros("at").alias("detected_at_us"), "score",
                       F.when(hot & F.col("source").isNotNull(), "attack").when(hot, "held").otherwise("benign").alias("class"))
