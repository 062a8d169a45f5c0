"""Detector rules on short hand-made packet lists; no Spark needed."""

from collections import namedtuple

import pytest

from tidewatch import config
from tidewatch.streaming.profiles import features, fresh, policy_for

Packet = namedtuple("Packet", "ts_us event_id src_ip dst_ip src_port dst_port proto flags payload_len tcp_win role ip peer_ip")
S = 1_000_000


def pkt(sec, dst="10.0.0.1", port=80, sport=40000, flags=2, proto=6, src="192.168.10.5", role="src", length=0, win=1024, n=0):
    ip, peer = (src, dst) if role == "src" else (dst, src)
    return Packet(int(sec * S), n, src, dst, sport, port, proto, flags, length, win, role, ip, peer)


def run(policy, events):
    p, out = None, []
    for e in events:
        p, found = policy.step(p, e)
        out += found
    return p, out


def always(x):
    return lambda raw: x


def test_anchored_window_scores_before_add():
    """The third packet is 60 s after the first: the old window is scored without it and a new one opens at it."""
    pol = policy_for(config.FLOOD.with_(min_events=2), always(0.9))
    p, out = run(pol, [pkt(1000), pkt(1030, port=81), pkt(1060, port=82)])
    assert [o["syn_count"] for o in out] == [2]
    assert out[0]["win_start_us"] == 1000 * S and out[0]["detected_at_us"] == 1060 * S
    assert p["start"] == 1060 * S and p["syn"] == 1


def test_window_is_not_epoch_aligned():
    pol = policy_for(config.FLOOD.with_(min_events=1), always(0.9))
    p, out = run(pol, [pkt(59), pkt(61), pkt(118.9)])
    assert out == [] and p["syn"] == 3


def test_flood_fires_early_once_and_prefix_is_scored():
    pol = policy_for(config.FLOOD.with_(early_events=3, min_events=2), always(0.9))
    _, out = run(pol, [pkt(10 + i / 10, port=i) for i in range(6)])
    assert len(out) == 1 and out[0]["syn_count"] == 3


def test_counters_stop_after_scoring_but_syns_go_on():
    cfg = config.AUTH.with_(early_events=3, min_events=2)
    pol = policy_for(cfg, always(0.1))
    p, out = run(pol, [pkt(1), pkt(2, role="dst", flags=18, src="10.0.0.1", dst="192.168.10.5"), pkt(3), pkt(4),
                       pkt(5, role="dst", flags=18, src="10.0.0.1", dst="192.168.10.5"), pkt(6)])
    assert len(out) == 1 and p["hs"] == 1 and p["syn"] == 4


def test_endpoint_counts_a_syn_twice_and_udp_once():
    pol = policy_for(config.ENDPOINT, always(0.0))
    p, _ = run(pol, [pkt(1), pkt(2, sport=40001), pkt(3, proto=17, flags=0)])
    f = features(p, "endpoint", 60)
    assert f[0] == 5 and f[1] == 1 and f[2] == 2 and f[4] == 0.0


@pytest.mark.parametrize("port,reason", [(443, "port"), (8080, "single_client")])
def test_endpoint_suppression(port, reason):
    pol = policy_for(config.ENDPOINT.with_(min_events=1), always(0.99))
    p = None
    for e in (pkt(1, port=port), pkt(2, port=port)):
        p, _ = pol.step(p, e)
        p["port"] = port
    _, out = pol.step(p, pkt(70, port=port))
    assert out[0]["suppress_reason"] == reason and not out[0]["alert"]


def test_port_gate_comes_before_the_sweep_rule():
    sweep = [pkt(1 + i / 100, dst=f"10.0.{i // 250}.{i % 250}", port=80) for i in range(600)] + [pkt(100)]
    strict = policy_for(config.SCAN, always(0.0))
    assert run(strict, sweep)[1] == []
    loose = policy_for(config.SCAN.with_(strict_gate=False), always(0.0))
    out = run(loose, sweep)[1]
    assert out[0]["score"] == 0.99 and out[0]["alert"] and out[0]["reason"] == "ip-sweep"


def test_probes_without_syn_alert_at_once():
    pol = policy_for(config.SCAN, always(0.0))
    _, out = run(pol, [pkt(1, flags=0), pkt(2, flags=41), pkt(3, flags=41)])
    assert [o["score"] for o in out] == [0.999] and out[0]["detected_at_us"] == 2 * S


def test_rst_and_ack_packets_do_not_count_for_the_scan_detector():
    p, _ = run(policy_for(config.SCAN, always(0.0)), [pkt(1), pkt(2, flags=18), pkt(3, flags=4), pkt(4, flags=6)])
    assert p["syn"] == 1 and p["fnx"] == 0


def test_strict_threshold_in_single_precision():
    pol = policy_for(config.FLOOD.with_(threshold=0.5, min_events=1), always(0.5))
    _, out = run(pol, [pkt(1), pkt(100)])
    assert not out[0]["alert"]


def test_cooldown_compares_with_the_last_kept_alert():
    cfg = config.AUTH.with_(early_events=2, min_events=2, window_sec=10, cooldown_sec=1800)
    pol = policy_for(cfg, always(0.99))
    events = [pkt(t + d) for t in (1000, 2000, 2790, 2802) for d in (0, 1)]
    _, out = run(pol, events)
    kept = [o for o in out if o["alert"]]
    assert [o["detected_at_us"] // S for o in kept] == [1001, 2803]
    assert [o["suppress_reason"] for o in out] == [None, "dedup", "dedup", None]


def test_clean_connections_are_suppressed():
    cfg = config.AUTH.with_(early_events=2, min_events=2, cooldown_sec=0)
    answers = [pkt(1.1 + i / 10, role="dst", flags=18, src="10.0.0.1", dst="192.168.10.5", length=2000) for i in range(3)]
    _, out = run(policy_for(cfg, always(0.99)), [pkt(1), *answers, pkt(2)])
    assert out[0]["suppress_reason"] == "clean_conn"


def test_client_ignores_public_sources_and_checks_data():
    pol = policy_for(config.CLIENT.with_(early_events=2, min_events=2), always(0.99))
    assert run(pol, [pkt(1, src="8.8.8.8"), pkt(2, src="8.8.8.8")])[0] is None
    _, out = run(pol, [pkt(1), pkt(2)])
    assert out[0]["suppress_reason"] == "no_data"


def test_client_reset_rule_replaces_the_allow_list_reason():
    cfg = config.CLIENT.with_(early_events=3, min_events=3, allow_list=("192.168.10.5",))
    pol = policy_for(cfg, always(0.99))
    p = None
    out = []
    for e in [pkt(1), *[pkt(1.1 + i / 100, flags=4) for i in range(20)], pkt(2), pkt(3)]:
        p, found = pol.step(p, e)
        p["key"] = "192.168.10.5"
        out += found
    assert out[0]["suppress_reason"] == "high_rst"


def test_silent_key_is_scored_by_timer_and_its_window_dropped():
    cfg = config.AUTH.with_(min_events=2, early_events=99, early_seconds=500)
    pol = policy_for(cfg, always(0.99))
    p, out = run(pol, [pkt(100), pkt(101)])
    assert out == []
    p, out = pol.on_timer(p, 160 * S)
    assert out[0]["detected_at_us"] == 160 * S and p["done"]
    p, _ = pol.on_timer(p, 220 * S)
    assert p["syn"] == 0 and p["last_alert"] == 160 * S
    assert pol.on_timer(fresh(0), 10 * S)[1] == []


def test_client_features_by_hand():
    p = fresh(0)
    pol = policy_for(config.CLIENT.with_(early_events=99, early_seconds=999), always(0.0))
    p, _ = run(pol, [pkt(1, dst="10.0.0.1", port=80), pkt(2, dst="10.0.0.1", port=443), pkt(4, dst="23.0.0.1", port=80),
                     pkt(4.5, role="dst", flags=18, src="10.0.0.1", dst="192.168.10.5", length=90, win=500), pkt(5, flags=17)])
    f = dict(zip(config.CLIENT_FEATURES, features(p, "client", 300)))
    assert f["syn_count"] == 3 and f["dst_ips"] == 2 and f["dst_ports"] == 2
    assert f["iat_cv"] == pytest.approx(1 / 3) and f["ip_conc"] == pytest.approx(2 / 3)
    assert f["port_entropy"] == pytest.approx(0.9182958) and f["internal_ratio"] == pytest.approx(2 / 3)
    assert f["handshake_ratio"] == pytest.approx(1 / 3) and f["inc_ratio"] == 0.25 and f["bytes_per_syn"] == 30
    assert f["fin_ratio"] == pytest.approx(1 / 3) and f["mean_window"] == 500 and f["time_density"] == 1.0


def test_profile_kept_for_its_cooldown_is_dropped_when_that_ends():
    pol = policy_for(config.FLOOD.with_(min_events=2, cooldown_sec=300.0), always(0.99))
    p, _ = run(pol, [pkt(1000), pkt(1001, port=81)])
    p["last_alert"] = 1060 * S
    p, _ = pol.on_timer(p, 1100 * S)
    assert p is not None and p["syn"] == 0 and pol.due(p) == p["last_alert"] + 300 * S
    assert pol.on_timer(p, pol.due(p)) == (None, [])
