"""Picklable score functions for the stateful processors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tidewatch.functions.packets import ACK, FIN, SYN
from tidewatch.models.trees import Ensemble, margins, pack


class EnsembleScore:
    """log1p on the named columns, robust scaling (zero range gives 0), single precision, tree ensemble."""

    def __init__(self, ens: Ensemble, params: dict[str, tuple[float, float]] | None = None, log1p: Sequence[str] = ()):
        self.ens, self.params, self.log1p = ens, params, set(log1p)
        self.trees = pack(ens)

    def __call__(self, raw: list[float]) -> float:
        x = np.array(raw, dtype=np.float64)
        for i, name in enumerate(self.ens.features):
            if name in self.log1p:
                x[i] = np.log1p(x[i])
            if self.params:
                median, iqr = self.params[name]
                x[i] = (x[i] - median) / iqr if iqr else 0.0
        m = margins(self.trees, self.ens.base, x.astype(np.float32)[None, :], self.ens.strict)[0]
        return float(1.0 / (1.0 + np.exp(-self.ens.scale * m)))


class LinearScore:
    """Logistic score of a weighted sum, for rules and tests."""

    def __init__(self, weights: dict[int, float], bias: float = 0.0):
        self.weights, self.bias = weights, bias

    def __call__(self, raw: list[float]) -> float:
        return float(1.0 / (1.0 + np.exp(-(self.bias + sum(w * raw[i] for i, w in self.weights.items())))))


#: Scalars of a flow and what they start with; -1 stands for "none yet".
FLOW_SCALARS = {"done": False, "n": 0, "first": -1, "last": -1, "seen": 0, "port": 0, "sp": 0, "dp": 0, "sb": 0, "db": 0,
                "sf": -1, "sl": -1, "df": -1, "dl": -1, "fin": 0, "ack": 0, "syn": 0}


class FlowScorer:
    """Running record of one flow and its 15 features."""

    @staticmethod
    def empty() -> dict:
        return dict(FLOW_SCALARS)

    @staticmethod
    def add(f: dict, e) -> None:
        t = int(e.ts_us)
        f["n"] += 1
        f["first"] = t if f["first"] < 0 else f["first"]
        f["last"] = t
        f["port"] = int(e.dst_port if e.from_client else e.src_port)
        side = "s" if e.from_client else "d"
        f[side + "p"] += 1
        f[side + "b"] += int(e.payload_len)
        f[side + "f"] = t if f[side + "f"] < 0 else f[side + "f"]
        f[side + "l"] = t
        if e.proto == 6:
            f["fin"] += bool(e.flags & FIN)
            f["ack"] += bool(e.flags & ACK)
            f["syn"] += bool(e.flags & SYN)

    @staticmethod
    def features(f: dict) -> list[float]:
        def gap(first, last, n):
            return (last - first) / (n - 1) / 1000.0 if n > 1 else 0.0
        sm = f["sb"] / f["sp"] if f["sp"] else 0.0
        dm = f["db"] / f["dp"] if f["dp"] else 0.0
        dg = gap(f["df"], f["dl"], f["dp"])
        return [(f["last"] - f["first"]) / 1e6, float(f["sp"]), float(f["dp"]), float(f["sb"]), float(f["db"]), sm, dm,
                gap(f["sf"], f["sl"], f["sp"]), dg, sm, dm, float(f["fin"]), float(f["ack"]), float(f["syn"]), dg]
