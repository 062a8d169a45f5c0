"""IPv4 text and flow identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed: alias between capture and label addresses, and protocol numbers.
IP_ALIASES = {"192.168.10.51": "172.16.0.1"}
PROTO_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ip_to_long(ip) -> Column:
    """Dotted IPv4 → integer; null when the text is not four octets."""
    ip = _c(ip)
    parts = F.split(ip, r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def long_to_ip(value) -> Column:
    v = _c(value).cast("bigint")
    return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def is_private_ip(ip, loopback: bool = False) -> Column:
    """RFC 1918 ranges; ``loopback`` also counts 127/8."""
    ranges = r"10|192\.168|172\.(1[6-9]|2[0-9]|3[01])" + ("|127" if loopback else "")
    return F.coalesce(_c(ip).rlike(rf"^({ranges})\.[0-9.]+$"), F.lit(False))


def is_valid_ip(ip) -> Column:
    """Not empty, not multicast 224./239., not broadcast, not IPv6."""
    ip = _c(ip)
    bad = (ip == "") | ip.startswith("224.") | ip.startswith("239.") | (ip == "255.255.255.255") | ip.contains(":")
    return F.coalesce(~bad, F.lit(False))


def map_ip(ip, aliases: dict[str, str] | None = None) -> Column:
    """Rewrite aliased addresses from a short fixed list."""
    ip = _c(ip)
    pairs = [F.lit(x) for kv in (IP_ALIASES if aliases is None else aliases).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ip), ip) if pairs else ip


def map_ip_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Same with an alias table ``(alias, address)`` of any size."""
    a = aliases.select(F.col("alias").alias(column), F.col("address").alias("_address"))
    return (df.join(a, column, "left")
            .withColumn(column, F.coalesce("_address", column)).drop("_address"))


def proto_num(name) -> Column:
    """Protocol name → number, 0 when unknown."""
    up = F.upper(F.trim(_c(name)))
    out = F.when(up == "TCP", 6).when(up == "UDP", 17).when(up == "ICMP", 1)
    return out.otherwise(0)


def split_addr(text) -> Column:
    """``ip:port`` split at the last colon → struct(ip, port); null for IPv6, empty host or bad port."""
    t = F.trim(_c(text))
    port_text = F.substring_index(t, ":", -1)
    host = F.regexp_replace(t, r":[^:]*$", "")
    ok = t.contains(":") & (host != "") & ~host.contains(":") & port_text.rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(ok, F.struct(host.alias("ip"), F.trim(port_text).try_cast("int").alias("port")))


def flow_id(src, dst, sport, dport, proto) -> Column:
    return F.concat_ws("-", _c(src), _c(dst), _c(sport).cast("string"), _c(dport).cast("string"),
                       _c(proto).cast("string"))


def flow_id_candidates(src, dst, sport, dport, proto, aliases: dict[str, str] | None = None) -> Column:
    """Ids an alert may carry in the label table, in lookup order: reversed, forward, then both with aliases."""
    ms, md = map_ip(src, aliases), map_ip(dst, aliases)
    return F.array_distinct(F.array(
        flow_id(dst, src, dport, sport, proto), flow_id(src, dst, sport, dport, proto),
        flow_id(md, ms, dport, sport, proto), flow_id(ms, md, sport, dport, proto)))


def reverse_flow_id(fid) -> Column:
    """Swap both ends of a five-part id; other ids stay as they are."""
    p = F.split(_c(fid), "-")
    swapped = F.concat_ws("-", *[F.get(p, F.lit(i)) for i in (1, 0, 3, 2, 4)])
    return F.when(F.size(p) == 5, swapped).otherwise(_c(fid))
