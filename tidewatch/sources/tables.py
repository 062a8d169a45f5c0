"""Readers for label tables, netflow logs, packet exports, dumps, score streams and the scenario registry."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch import schemas
from tidewatch.functions.addresses import is_valid_ip
from tidewatch.functions.features import clean_numeric


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


# windows-1252 differs from ISO-8859-1 in the bytes 0x80-0x9f only; the pairs come from Python's own codec.
_C1 = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_C1 = [(a, b) for a, b in _C1 if b]


def _charset(encoding: str) -> tuple[str, bool]:
    """Charset for the reader, and whether the windows-only characters must be put right after it."""
    if encoding.lower() in ("cp1252", "windows-1252"):
        return "ISO-8859-1", True
    return encoding, False


def _by_header(spark: SparkSession, path: str) -> list[str | list[str]]:
    """The files of ``path`` in groups of equal header line; the path itself if all have the same."""
    files = [unquote(f) for f in spark.read.text(path).inputFiles()]
    if len(files) < 2:
        return [path]
    def header(file: str) -> str:
        first = spark.read.text(file).filter("trim(value) <> ''").head(1)      # one task that stops at its first row
        return first[0]["value"] if first else ""

    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(inheritable_thread_target(spark)(header), files))
    groups: dict[str, list[str]] = {}
    for file, line in sorted(zip(files, headers)):
        if line:
            groups.setdefault(line, []).append(file)
    return [path] if len(groups) < 2 else list(groups.values())


def read_flow_table(spark: SparkSession, paths, columns: Sequence[str] | None = None, encoding: str = "UTF-8",
                    id_column: str | None = "Flow ID", label_column: str = "Label") -> DataFrame:
    """Union of label CSV files: header blanks trimmed, labels trimmed, lines with extra fields skipped.

    The files of a folder may differ in their columns and column order: each is read by its own header.

    Short lines are kept with nulls. Undecodable bytes become replacement characters. Rows without a flow id are
    dropped. ``columns`` prunes the read; ``encoding`` is for single-byte files (e.g. ``windows-1252``).
    ``csv_source`` holds the file name.
    """
    encoding, windows = _charset(encoding)
    out = None
    for path in [group for p in _paths(paths) for group in _by_header(spark, p)]:
        header = spark.read.option("header", True).option("encoding", encoding).csv(path if isinstance(path, str) else path[0]).columns
        # one column more than the header: it is filled exactly when a line has too many fields
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))]
                              + [T.StructField("_extra", T.StringType())])
        raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nullValue", "\u0001")
               .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
               .withColumn("csv_source", F.col("_metadata.file_name")).filter(F.col("_extra").isNull()))
        names, seen = [], set()
        for h in header:
            name = h.strip()
            names.append(name if name not in seen else f"{name}.{len(seen)}")
            seen.add(name)
        wanted = [c for c in names if columns is None or c in columns]
        def text(i: int):
            c = F.col(f"c{i}")
            return F.translate(c, "".join(a for a, _ in _C1), "".join(b for _, b in _C1)) if windows else c
        part = raw.select(*[text(names.index(c)).alias(c) for c in wanted], "csv_source")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if label_column in out.columns:
        out = out.withColumn(label_column, F.trim(F.col(f"`{label_column}`")))
    if id_column and id_column in out.columns:
        out = out.withColumn(id_column, F.trim(F.col(f"`{id_column}`"))).filter(F.col(f"`{id_column}`") != "")
    return out


def read_headerless_flows(spark: SparkSession, paths, numeric: Sequence[str] = schemas.HEADERLESS_BASE) -> DataFrame:
    """49-column table without header: an embedded header row is dropped, numbers coerced, incomplete rows dropped."""
    raw = spark.read.schema(schemas.HEADERLESS).csv(_paths(paths))
    raw = raw.filter(F.lower(F.trim(F.coalesce("srcip", F.lit("")))) != "srcip")
    raw = raw.withColumns({"label": F.coalesce(F.col("label").try_cast("double"), F.lit(0.0)).cast("int"),
                           "attack_cat": F.trim("attack_cat")})
    return clean_numeric(raw, numeric)


def read_netflow_csv(spark: SparkSession, path, marker: str = "From-Botnet") -> DataFrame:
    """7-column flow log → all flows of the sources that have a flow labelled with ``marker``."""
    raw = spark.read.option("header", True).csv(path)
    columns = [f.name for f in T.StructType.fromDDL(schemas.NETFLOW)]
    raw = raw.select(*[F.col(c).cast("string") for c in columns])
    bots = raw.filter(F.col("Label").contains(marker)).select("SrcAddr").distinct()
    ts = F.coalesce(F.unix_micros(F.col("StartTime").try_cast("timestamp")), F.lit(0))
    return raw.join(bots, "SrcAddr", "left_semi").select(
        F.col("SrcAddr").alias("src_ip"), F.col("DstAddr").alias("dst_ip"), safe_port("Dport").alias("dst_port"),
        ts.alias("ts_us"), F.col("Label").alias("label"))


def safe_port(column: str) -> F.Column:
    """Port text → integer, hexadecimal allowed; 0 when unreadable."""
    t = F.trim(F.col(column))
    hexa = F.conv(F.substring(t, 3, 16), 16, 10).try_cast("int")
    return F.coalesce(F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexa).otherwise(t.try_cast("double").try_cast("int")),
                      F.lit(0))


def read_packet_export(spark: SparkSession, path) -> DataFrame:
    """Tab-separated packet export → src, dst, ports and protocol; ports chosen by protocol, bad rows dropped."""
    raw = spark.read.schema(schemas.PACKET_EXPORT).option("sep", "\t").csv(path)
    p = F.col("proto").try_cast("int")
    sport = F.when(p == 6, F.col("tcp_src")).when(p == 17, F.col("udp_src")).try_cast("int")
    dport = F.when(p == 6, F.col("tcp_dst")).when(p == 17, F.col("udp_dst")).try_cast("int")
    out = raw.select("src_ip", "dst_ip", sport.alias("src_port"), dport.alias("dst_port"), p.alias("proto"))
    return out.filter((F.col("src_port") != 0) & (F.col("dst_port") != 0) & is_valid_ip("src_ip") & is_valid_ip("dst_ip"))


def read_score_stream(spark: SparkSession, path, ordered_by: str | None = None, latest: bool = False) -> DataFrame:
    """Score JSON lines. With ``latest``, only the last entry per source: by ``ordered_by``, an explicit sequence column of the
    lines, or without one by the order of the lines in the file, and files in the order of their names.

    A line's place is the start of the file block that it was read from and its number among the rows of that task, which
    reads a block from front to back; a file may be split over any number of tasks."""
    schema = schemas.SCORE_STREAM + (f", {ordered_by} bigint" if ordered_by else "")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_row"))
    raw = lines.select(F.from_json("value", schema).alias("_s"), "_file", "_block", "_row").select("_s.*", "_file", "_block", "_row").filter(
        "src_ip is not null and score is not null")
    rest = [c for c in raw.columns if c not in ("src_ip", "_file", "_block", "_row")]
    if not (latest or ordered_by):
        return raw.select("engine", "src_ip", *[c for c in rest if c != "engine"])
    place = F.col(ordered_by) if ordered_by else F.struct("_file", "_block", "_row")
    return raw.groupBy("src_ip").agg(F.max_by(F.struct(*rest), place).alias("_s")).select("src_ip", "_s.*")


def read_feature_dump(spark: SparkSession, path, columns: Sequence[str], min_width: int | None = None) -> DataFrame:
    """Blank-separated numeric dump; ``#`` lines and rows narrower than ``min_width`` are skipped.

    Columns a narrower file version lacks are null.
    """
    return parse_feature_dump(spark.read.text(_paths(path)), columns, min_width)


def parse_feature_dump(lines: DataFrame, columns: Sequence[str], min_width: int | None = None) -> DataFrame:
    text = F.trim("value")
    parts = lines.filter(~F.startswith(text, F.lit("#")) & (text != "")).select(F.split(text, r"\s+").alias("p"))
    parts = parts.filter(F.size("p") >= (min_width or len(columns)))
    return parts.select(*[F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)])


def load_registry(spark: SparkSession, path) -> DataFrame:
    """Scenario registry JSON (one object keyed by scenario) → one row per scenario; keys starting with _ skipped."""
    text = spark.read.text(path, wholetext=True)
    blobs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("scenario", "blob"))
    parsed = blobs.filter(~F.startswith("scenario", F.lit("_"))).select(
        "scenario", F.from_json("blob", schemas.REGISTRY).alias("r"))
    u = "r.slice_universe"
    return parsed.select(
        "scenario", "r.pcap_name", "r.active_engine", "r.metric_level", "r.gt_loader_day",
        F.col("r.ml.alerts").alias("ml_alerts"),
        *[F.try_element_at("r.ml.confusion", F.lit(k.upper())).alias(k) for k in ("tp", "fp", "tn", "fn")],
        *[F.col(f"r.ml.{m}").alias(m) for m in ("accuracy", "precision", "recall", "f1", "fpr", "avg_score",
                                                "window_recall", "syn_coverage")],
        F.col("r.community.alerts_total_day").alias("community_alerts"),
        F.col("r.community.alerts_on_attackers").alias("community_on_attackers"),
        F.col("r.community.fpr").alias("community_fpr"),
        *[F.try_element_at(F.try_element_at(u, F.lit(level)), F.lit(k)).alias(k) for level, k in (
            ("flow_level", "attack_rows"), ("flow_level", "benign_rows"),
            ("ip_level", "attack_ips"), ("ip_level", "benign_ips"))])
