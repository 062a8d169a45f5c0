"""Query registry: each query states its output columns once, for Spark and for its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.fixtures import sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spec(cols: str) -> list[tuple[str, str]]:
    out = []
    for item in cols.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "s"))
    return out


def project(df: DataFrame, cols: str) -> DataFrame:
    """``name`` text as is, ``name:i`` bigint, ``name:d`` / ``name:d3`` double rounded to 6 / 3 places."""
    picked = []
    for name, kind in _spec(cols):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind.startswith("d"):
            # the same arithmetic in both engines, so ties cannot round apart
            scale = float(10 ** int(kind[1:] or 6))
            c = F.floor(c.cast("double") * scale + 0.5) / F.lit(scale)
        picked.append(c.alias(name))
    return df.select(*picked)


def _sql_project(body: str, cols: str) -> str:
    picked = []
    for name, kind in _spec(cols):
        if kind == "i":
            picked.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind.startswith("d"):
            scale = f"CAST({10 ** int(kind[1:] or 6)} AS DOUBLE)"
            picked.append(f"floor(CAST({name} AS DOUBLE) * {scale} + CAST(0.5 AS DOUBLE)) / {scale} AS {name}")
        else:
            picked.append(name)
    return f"SELECT {', '.join(picked)} FROM ({body}) AS result"


def query(name: str, cols: str, sql: str | None = None, uses: str = "",
          recursive: bool = False):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``uses`` names the fixture tables of the SQL text.

    The SQL text may open with its own common tables: everything before the last ``SELECT`` that starts a line with
    ``--result`` above it belongs to them.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return project(fn(spark, sf_dir), cols)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            head, mark, tail = sql.partition("--result")
            body = tail if mark else sql
            text = _sql_project(body.strip(), cols)
            head = head.strip().lstrip(",").strip()
            if mark:
                text = f"WITH {head}\n{text}"
            text = sql_with(uses, text)
            ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn
    return deco
