"""Packet-level predicates on the TCP flag byte."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def has(flags, bits: int) -> Column:
    """All of ``bits`` are set."""
    return _c(flags).bitwiseAND(bits) == bits


def classify_packet(flags, proto="proto") -> Column:
    """'S' for a bare SYN, 'F' for FIN / NULL / XMAS probes, null for anything else or non-TCP."""
    f = _c(flags)
    handshake = f.bitwiseAND(SYN | RST | ACK)
    probe = (f == 0) | ((handshake == 0) & (f.bitwiseAND(FIN | PSH | URG) != 0))
    return F.when(_c(proto) == 6, F.when(handshake == SYN, "S").when(probe, "F"))


def is_syn(flags) -> Column:
    """SYN set and ACK clear; RST is not looked at."""
    return _c(flags).bitwiseAND(SYN | ACK) == SYN


def is_syn_ack(flags) -> Column:
    return has(flags, SYN | ACK)


def packet_role(flags) -> Column:
    """The roles the window detectors count, as one struct of flags."""
    return F.struct(
        is_syn(flags).alias("syn"),
        is_syn_ack(flags).alias("syn_ack"),
        has(flags, RST).alias("rst"),
        has(flags, FIN).alias("fin"),
        has(flags, PSH).alias("psh"),
    )
