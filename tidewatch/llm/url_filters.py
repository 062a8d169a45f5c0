"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host rule (``example.org/es/``: host, its subdomains, and every path that starts so) or a pattern. In a
pattern ``||`` stands for the start of a host label, ``*`` for anything, ``^`` for a byte other than a letter or digit (or
the end). Every match must contain the rule's literal tokens whole, so a rule is filed under the one that is rarest among
the URLs. The tokens of a URL fetch candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import spare_name, stage
from tidewatch.session import literal_table


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: bool = False


#: The host rules of the contract.
HOST_RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"),
              Rule("com/de/", "block"))
#: The method's own rules: betting and link-farm hosts, advertising paths.
PATTERN_RULES = (Rule("||free-bets.", "block", True), Rule("||spam-farm.", "block", True), Rule("||casino.", "block", True),
                 Rule("^doubleclick^", "block", True), Rule("^adserver^", "block", True), Rule("^popunder^", "block", True))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; ASCII letters lowered; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text) if t]


def whole_tokens(rule: Rule) -> list[str]:
    """Literal tokens that stand between separators in whatever the rule matches; ``""`` if there are none."""
    if rule.pattern:
        found = []
        for m in re.finditer(r"[a-z0-9]+", rule.text):
            before, after = rule.text[:m.start()], rule.text[m.end():]
            if before and not before.endswith("*") and after and not after.startswith("*"):
                found.append(m[0])
    else:
        host, slash, path = rule.text.partition("/")
        found = tokens(host.lower()) + tokens(re.sub(r"[A-Za-z0-9]+$", "", path).lower())
    return found or [""]


def regex(rule: Rule) -> str:
    """Java regular expression over ``host + path`` (host rules) or the lower-cased URL (patterns)."""
    if not rule.pattern:
        host, _, path = rule.text.partition("/")
        return r"^(?:[^/]*\.)?" + re.escape(host) + "/" + re.escape(path)
    out = ""
    for piece in re.findall(r"\|\||\*|\^|[^|*^]+|\|", rule.text):
        out += {"||": r"://(?:[^/?#]*\.)?", "*": ".*", "^": r"(?:[^a-z0-9]|$)"}.get(piece, re.escape(piece))
    return out


def rule_index(urls: DataFrame, rules: tuple[Rule, ...], url: str) -> DataFrame:
    """``token``, ``rule``, ``verdict``, ``pattern``, ``regex``, ``rank``: each rule under its token that fewest URLs have."""
    spark = urls.sparkSession
    index = literal_table(spark, [(r.text, r.verdict, r.pattern, regex(r), len(r.text), t) for r in rules for t in sorted(set(whole_tokens(r)))],
                          "rule string, verdict string, pattern boolean, regex string, rank int, token string")
    seen = (urls.select(F.explode(url_tokens(F.col(url))).alias("token")).groupBy("token").agg(F.count("*").alias("n_urls")))
    least = F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n"), "token"))
    return stage(index.join(seen, "token", "left").groupBy("rule", "verdict", "pattern", "regex", "rank").agg(least.alias("least"))
                 .select(F.col("least.token").alias("token"), "rule", "verdict", "pattern", "regex", "rank"), "rule-index")


def url_tokens(url: Column) -> Column:
    """Distinct lower-case tokens of a URL, and the empty token, under which rules without a literal are filed."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(url), "[^a-z0-9]+")))


def judge(df: DataFrame, rules: tuple[Rule, ...], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the longest host rule that fits, else null) and ``verdict``.

    Without a host rule the verdict is ``block`` if any pattern that blocks fits, else that of a pattern that allows, else
    ``default``. A URL that is null or has no ``://`` has empty host and path and gets ``default``. Each different URL is judged once; columns
    of ``df`` with the added names are replaced, others pass through. Equally long host rules: the smaller text wins.
    """
    key = spare_name(df, "_url")
    urls = df.select(F.col(url).alias(key)).filter(F.col(url).isNotNull()).distinct()
    urls = stage(urls, "urls")
    index = rule_index(urls, rules, key)
    place = F.concat(host_of(F.col(key)), path_of(F.col(key)))
    fits = F.when(F.col("pattern"), F.regexp_like(F.lower(F.col(key)), F.col("regex"))).otherwise(F.regexp_like(place, F.col("regex")))
    candidates = urls.select(key, F.explode(url_tokens(F.col(key))).alias("token")).join(index, "token").filter(fits)
    host_rule = F.min(F.when(~F.col("pattern"), F.struct((-F.col("rank")).alias("rank"), "rule", "verdict")))
    pattern = F.max(F.when(F.col("pattern"), F.col("verdict")))                            # "block" > "allow"
    best = candidates.groupBy(key).agg(host_rule.alias("_host_rule"), pattern.alias("_pattern"))
    out = df.drop("host", "path", "rule", "verdict").join(best, F.col(url) == F.col(key), "left")
    u = F.coalesce(F.col(url), F.lit(""))
    return out.select(*[c for c in df.columns if c not in ("host", "path", "rule", "verdict")], host_of(u).alias("host"),
                      path_of(u).alias("path"), F.col("_host_rule.rule").alias("rule"),
                      F.coalesce("_host_rule.verdict", "_pattern", F.lit(default)).alias("verdict"))
