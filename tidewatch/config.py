"""Detector settings: one frozen record per detector, passed to the functions that need it."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DetectorConfig:
    engine: str
    gid: int
    key: str                      # 'flow', 'src' or 'endpoint'
    threshold: float
    window_sec: int = 0
    min_events: int = 1
    min_dst_ports: int = 0
    max_packets: int = 0
    early_events: int = 0         # score before the window closes at this many events
    early_seconds: float = 0.0    # ... or once this many seconds have passed
    idle_seconds: float = 0.0     # a silent key is scored after this long
    cooldown_sec: int = 0
    private_only: bool = False
    suppress_ports: tuple[int, ...] = ()
    allow_list: tuple[str, ...] = ()
    strict_gate: bool = True      # the port gate is tested before the sweep heuristic
    log1p_features: tuple[str, ...] = ()

    def with_(self, **changes) -> "DetectorConfig":
        return replace(self, **changes)


SYN_FEATURES = ("syn_count", "dst_ports", "dst_ips", "port_entropy", "src_port_range", "port_ratio", "rate")
ENDPOINT_FEATURES = ("total", "src_ips", "src_ports", "ports_per_src", "reserved", "src_ratio", "rate")
AUTH_FEATURES = ("syn_count", "dst_ips", "dst_ports", "port_ratio", "top_port_share", "rate", "iat_cv",
                 "handshake_ratio", "rst_per_handshake", "bytes_per_syn")
CLIENT_FEATURES = ("syn_count", "dst_ips", "dst_ports", "iat_cv", "port_entropy", "port_ratio", "rate",
                   "ip_conc", "ip_ratio", "ip_entropy", "iat_q90_q10", "time_density", "port_ip_ratio",
                   "handshake_ratio", "inc_ratio", "data_density", "rst_rate", "internal_ratio",
                   "bytes_per_syn", "fin_ratio", "push_ratio", "mean_window")
# Fixed column names that models and logs are made with; the wide forms follow from the narrow one.
FLOW_FEATURES_11 = ("dur", "spkts", "dpkts", "sbytes", "dbytes", "smeansz", "dmeansz", "swin", "dwin",
                    "sintpkt", "dintpkt")
_WIDE = ("fwd_pkt_mean", "bwd_pkt_mean", "fin_cnt", "ack_cnt", "syn_cnt", "bwd_iat")
FLOW_FEATURES_17 = FLOW_FEATURES_11 + _WIDE
FLOW_FEATURES_15 = tuple(n for n in FLOW_FEATURES_17 if n not in ("swin", "dwin"))

# Fixed serving values: thresholds, windows, minimum events and port lists per detector.
FLOW = DetectorConfig("xgboost", 301, "flow", 0.90, max_packets=8, suppress_ports=(53, 137, 389))
SCAN = DetectorConfig("portscan", 302, "src", 0.90, 60, 5, min_dst_ports=30, early_events=500,
                      log1p_features=SYN_FEATURES)
FLOOD = DetectorConfig("dos_agg", 303, "src", 0.30, 60, 3, early_events=1000,
                       log1p_features=("syn_count", "dst_ports", "dst_ips", "rate"))
ENDPOINT = DetectorConfig("ddos", 304, "endpoint", 0.50, 60, 3,
                          suppress_ports=(21, 22, 25, 53, 88, 123, 137, 138, 389, 443, 445),
                          log1p_features=ENDPOINT_FEATURES)
CLIENT = DetectorConfig("bot", 306, "src", 0.85, 300, 3, early_events=30, early_seconds=30.0,
                        idle_seconds=60.0, cooldown_sec=1800, private_only=True)
AUTH = DetectorConfig("bruteforce", 307, "src", 0.95, 120, 3, early_events=30, early_seconds=30.0,
                      idle_seconds=60.0, cooldown_sec=1800, log1p_features=AUTH_FEATURES)

DETECTORS = {c.engine: c for c in (FLOW, SCAN, FLOOD, ENDPOINT, CLIENT, AUTH)}
