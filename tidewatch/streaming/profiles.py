"""Behaviour profiles of one key, folded event by event.

Scalars of a profile are entries of a dict; its counts per port and address and the times before the first scoring lie in
stores (plain ones here, state of the stream in the processors).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
import math

import numpy as np

from tidewatch.config import DetectorConfig
from tidewatch.functions.packets import ACK, FIN, PSH, RST, SYN, URG
from tidewatch.streaming.state import Counts

US = 1_000_000
#: Scalars of a profile and what they start with; -1 stands for "none yet".
SCALARS = {"start": 0, "syn": 0, "total": 0, "lo": -1, "hi": -1, "fnx": 0, "seen": 0, "rst": 0, "hs": 0, "inp": 0, "inb": 0, "fin": 0, "psh": 0,
           "win": 0, "internal": 0, "done": False, "last_alert": 0}


class Profile(dict):
    def __init__(self, ports=None, ips=None, sports=None, times=None) -> None:
        super().__init__(SCALARS)
        self.ports, self.ips, self.sports = Counts(ports), Counts(ips), Counts(sports)
        self.times = [] if times is None else times

    def restart(self, start_us: int, last_alert_us: int = 0) -> "Profile":
        self.update(SCALARS)
        self["start"], self["last_alert"] = start_us, last_alert_us
        for part in (self.ports, self.ips, self.sports, self.times):
            part.clear()
        return self


def fresh(start_us: int, last_alert_us: int = 0) -> Profile:
    return Profile().restart(start_us, last_alert_us)


def expired(p: Profile, now_us: int, window_sec: float) -> bool:
    return (p["syn"] + p["total"]) > 0 and now_us - p["start"] >= window_sec * US


def add_syn(p: Profile, ip: str, port: int, sport: int, ts_us: int, keep_times: bool) -> None:
    p["syn"] += 1
    p.ports.add(port)
    p.ips.add(ip)
    p["lo"] = sport if p["lo"] < 0 else min(p["lo"], sport)
    p["hi"] = max(p["hi"], sport)
    if keep_times and not p["done"]:
        p.times.append(ts_us)


def _gaps(times: Iterable[int], least: int) -> list[float]:
    t = sorted(times)
    return [b - a for a, b in zip(t, t[1:]) if b - a >= least]


def iat_cv(times: Iterable[int]) -> float:
    g = _gaps(times, 1)
    return float(np.std(g) / np.mean(g)) if len(g) >= 2 else 0.0


def iat_q90_q10(times: Iterable[int]) -> float:
    g = sorted(_gaps(times, 2))
    return g[9 * len(g) // 10] / g[len(g) // 10] if len(g) >= 4 else 0.0


def _div(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(p: Profile, kind: str, window_sec: float) -> list[float]:
    """Feature vector in the order named in the configuration module."""
    n, ports, ips = p["syn"], p.ports.distinct, p.ips.distinct
    rate = n / window_sec
    if kind == "syn":
        spread = float(p["hi"] - p["lo"]) if n else 0.0
        return [float(n), float(ports), float(ips), p.ports.entropy(), spread, _div(ports, n), rate]
    if kind == "endpoint":
        total, srcs, sports = p["syn"] + p["total"], p.ips.distinct, p.sports.distinct
        return [float(total), float(srcs), float(sports), _div(sports, srcs), 0.0, _div(srcs, total), total / window_sec]
    times = sorted(p.times)
    if kind == "auth":
        return [float(n), float(ips), float(ports), _div(ports, n), _div(p.ports.most, n), rate,
                iat_cv(times), _div(p["hs"], n), _div(p["rst"], p["hs"]), _div(p["inb"], n)]
    seconds = len({t // US for t in times})
    density = _div(seconds, len(times)) if len(times) >= 2 else 0.0
    return [float(n), float(ips), float(ports), iat_cv(times), p.ports.entropy(), _div(ports, n), rate,
            _div(p.ips.most, n), _div(ips, n), p.ips.entropy(), iat_q90_q10(times), density,
            _div(ports, ips), _div(p["hs"], n), _div(p["inp"], n + p["inp"]), _div(p["inp"], n), _div(p["rst"], n),
            _div(p["internal"], n), _div(p["inb"], n), _div(p["fin"], n), _div(p["psh"], n), _div(p["win"], p["hs"])]


def is_private(ip: str) -> bool:
    a, b = (int(x) for x in ip.split(".")[:2])
    return a == 10 or (a == 172 and 16 <= b <= 31) or (a == 192 and b == 168)


class Policy:
    """How one detector folds an event and when it scores. ``score`` maps a raw feature list to a probability."""

    kind = "syn"

    def __init__(self, cfg: DetectorConfig, score, make: Callable[[], Profile] = Profile):
        self.cfg, self.score, self.make = cfg, score, make

    def open(self, p: Profile | None, now_us: int) -> Profile:
        """A new window; only the time of the last alert is carried over."""
        return self.make().restart(now_us) if p is None else p.restart(now_us, p["last_alert"])

    def verdict(self, p: dict, now_us: int, reason: str | None = None) -> dict | None:
        """Score a profile once; None when the gate stops it before scoring."""
        p["done"] = True
        cfg = self.cfg
        raw = features(p, self.kind, cfg.window_sec)
        sweep = cfg.key == "src" and self.kind == "syn" and cfg.min_dst_ports > 0 and p.ips.distinct >= 100 and p["syn"] >= 500
        if cfg.min_dst_ports and p.ports.distinct < cfg.min_dst_ports and not (sweep and not cfg.strict_gate):
            return None
        s = float(np.float32(self.score(raw)))
        alert = s > np.float32(cfg.threshold)
        why = self.suppressed(p, s) if alert else None
        if alert and why is None and cfg.cooldown_sec and p["last_alert"] > 0 and \
                now_us - p["last_alert"] < cfg.cooldown_sec * US:
            why = "dedup"
        if alert and why is None:
            p["last_alert"] = now_us
        if sweep:
            alert, s = True, 0.99
        return {"win_start_us": p["start"], "detected_at_us": now_us, "syn_count": p["syn"], "score": s,
                "alert": bool(alert and why is None), "suppress_reason": why, "reason": reason or ("ip-sweep" if sweep else None),
                "features": raw}

    def suppressed(self, p: dict, score: float) -> str | None:
        return None

    def step(self, p: dict | None, e) -> tuple[dict | None, list[dict]]:
        raise NotImplementedError

    def due(self, p: dict) -> int | None:
        """Time at which a silent profile must be looked at."""
        if p is None:
            return None
        if not p["syn"] + p["total"]:                      # kept for its cooldown, or for probes that came without a SYN
            kept = p["last_alert"] + int(self.cfg.cooldown_sec * US) if p["last_alert"] else 0
            return max(kept, p["seen"] + int(self.cfg.window_sec * US) if p["fnx"] else 0) or None
        wait = self.cfg.idle_seconds if self.cfg.idle_seconds and not p["done"] else self.cfg.window_sec
        return p["start"] + int(wait * US)

    def ready(self, p: dict) -> bool:
        return not p["done"] and p["syn"] + p["total"] >= self.cfg.min_events

    def on_timer(self, p: dict, now_us: int) -> tuple[dict | None, list[dict]]:
        """A key stayed silent: score it, and drop the profile once its window is over."""
        out = []
        due = self.due(p)
        if due is not None and now_us >= due and not p["syn"] + p["total"]:
            return None, out
        if due is not None and now_us >= due and self.ready(p):
            out.append(self.verdict(p, due))
        if expired(p, now_us, self.cfg.window_sec):
            keep = self.cfg.cooldown_sec and p["last_alert"] and now_us - p["last_alert"] < self.cfg.cooldown_sec * US
            p = self.open(p, now_us) if keep else None
        return p, [o for o in out if o]

    def roll(self, p: dict, now_us: int, out: list) -> dict:
        """Score before add: an expired window is scored, then a new one opens at the event."""
        if expired(p, now_us, self.cfg.window_sec):
            if self.ready(p):
                out.append(self.verdict(p, now_us))
            p = self.open(p, now_us)
        return p


class ScanPolicy(Policy):
    def step(self, p, e):
        out = []
        if p is not None:
            p = self.roll(p, e.ts_us, out)
        f = e.flags
        if e.proto != 6:
            kind = None
        elif f & (SYN | RST | ACK) == SYN:
            kind = "S"
        else:
            kind = "F" if f == 0 or (not f & (SYN | RST | ACK) and f & (FIN | PSH | URG)) else None
        if kind is None:
            return p, [o for o in out if o]
        if p is None:
            p = self.open(None, e.ts_us)
            first = True
        else:
            first = False
        if kind == "S":
            add_syn(p, e.dst_ip, e.dst_port, e.src_port, e.ts_us, False)
            if not first and self.ready(p) and (expired(p, e.ts_us, self.cfg.window_sec) or (
                    p["syn"] >= self.cfg.early_events and p.ports.distinct >= self.cfg.min_dst_ports)):
                out.append(self.verdict(p, e.ts_us))
        else:
            p["fnx"] += 1
            p["seen"] = e.ts_us
            if not first and not p["done"] and p["syn"] == 0:
                p["done"] = True
                out.append({"win_start_us": p["start"], "detected_at_us": e.ts_us, "syn_count": 0, "score": 0.999, "alert": True,
                            "suppress_reason": None, "reason": "null/xmas", "features": features(p, "syn", self.cfg.window_sec)})
        return p, [o for o in out if o]


class FloodPolicy(Policy):
    def step(self, p, e):
        if e.proto != 6 or e.flags & (SYN | ACK) != SYN:
            return p, []
        out = []
        first = p is None
        p = self.open(None, e.ts_us) if first else self.roll(p, e.ts_us, out)
        add_syn(p, e.dst_ip, e.dst_port, e.src_port, e.ts_us, False)
        if not first and self.ready(p) and p["syn"] >= self.cfg.early_events:
            out.append(self.verdict(p, e.ts_us))
        return p, [o for o in out if o]


class EndpointPolicy(Policy):
    kind = "endpoint"

    def step(self, p, e):
        syn = e.proto == 6 and e.flags & (SYN | ACK) == SYN
        if not syn and e.proto != 17:
            return p, []
        out = []
        p = self.open(None, e.ts_us) if p is None else self.roll(p, e.ts_us, out)
        p["total"] += 1
        if syn:
            add_syn(p, e.src_ip, e.dst_port, e.src_port, e.ts_us, False)
            p.sports.add(e.src_port)
        return p, [o for o in out if o]

    def suppressed(self, p, score):
        port = p.get("port")
        if port in self.cfg.suppress_ports:
            return "port"
        return "single_client" if p.ips.distinct == 1 and p.sports.distinct < 10 else None


class RolePolicy(Policy):
    """Shared by the authentication and client detectors; events carry the role of the key."""

    def step(self, p, e):
        out = []
        f, cfg = e.flags, self.cfg
        if e.role == "src" and f & (SYN | ACK) == SYN and (not cfg.private_only or is_private(e.ip)):
            first = p is None
            p = self.open(None, e.ts_us) if first else self.roll(p, e.ts_us, out)
            add_syn(p, e.peer_ip, e.dst_port, e.src_port, e.ts_us, True)
            p["internal"] += is_private(e.peer_ip)
            if not first and self.ready(p) and (e.ts_us - p["start"] >= cfg.early_seconds * US or p["syn"] >= cfg.early_events):
                out.append(self.verdict(p, e.ts_us))
        if p is not None and not p["done"]:
            if e.role == "dst":
                if f & (SYN | ACK) == (SYN | ACK):
                    p["hs"] += 1
                    p["win"] += e.tcp_win
                p["inp"] += 1
                p["inb"] += max(e.payload_len, 0)
            else:
                p["rst"] += bool(f & RST)
                p["fin"] += bool(f & FIN)
                p["psh"] += bool(f & PSH)
        return p, [o for o in out if o]


class AuthPolicy(RolePolicy):
    kind = "auth"

    def suppressed(self, p, score):
        if p.get("key") in self.cfg.allow_list:
            return "whitelist"
        n = p["syn"]
        clean = _div(p["hs"], n) > 0.8 and _div(p["rst"], p["hs"]) < 0.3 and _div(p["inb"], n) > 1000
        return "clean_conn" if clean else None


class ClientPolicy(RolePolicy):
    kind = "client"

    def suppressed(self, p, score):
        n = p["syn"]
        if _div(p["rst"], n) > 5.0 and n >= 3:
            return "high_rst"
        if p["inp"] == 0 and n >= 3 and score < 0.3:
            return "no_incoming"
        if _div(p["internal"], n) > 0.6 and score < 0.3 and n >= 3:
            return "high_int_ratio"
        if _div(p["hs"], n) < 0.1 and score < 0.2 and n >= 3:
            return "no_handshake"
        if p["hs"] == 0 and p["inb"] < 10:
            return "no_data"
        return "whitelist" if p.get("key") in self.cfg.allow_list else None


POLICIES = {"portscan": ScanPolicy, "dos_agg": FloodPolicy, "ddos": EndpointPolicy, "bruteforce": AuthPolicy, "bot": ClientPolicy}


def policy_for(cfg: DetectorConfig, score, make: Callable[[], Profile] = Profile) -> Policy:
    return POLICIES[cfg.engine](cfg, score, make)
