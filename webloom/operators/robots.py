"""robots.txt: rules of the most specific agent group, longest match wins, allow on ties."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.url import origin, path
from webloom.sources.shared import saved

#: Bytes of a robots file that are read.
MOST_BYTES = 256 * 1024


def _read(text: str) -> str:
    """The first MOST_BYTES bytes of a file."""
    return text if len(text) * 4 <= MOST_BYTES else text.encode("utf-8", "surrogatepass")[:MOST_BYTES].decode("utf-8", "ignore")


def groups(text: str) -> dict[str, list[tuple[bool, str]]]:
    """Agent (lower case) -> rules (allow, path)."""
    out: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    in_rules = False
    for line in _read(text).lstrip("\ufeff").splitlines():
        name, sep, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep:
            continue
        if name in ("user-agent", "useragent"):
            if in_rules:
                agents, in_rules = [], False
            agents.append(value.lower())
            out.setdefault(value.lower(), [])
        elif name in ("allow", "disallow") and agents:
            in_rules = True
            if value:
                for a in agents:
                    out[a].append((name == "allow", value))
        elif name == "crawl-delay":
            in_rules = bool(agents)
    return out


def sitemaps(text: str) -> list[str]:
    found = (line.split("#", 1)[0].partition(":") for line in _read(text).splitlines())
    return [value.strip() for name, sep, value in found if sep and name.strip().lower() == "sitemap" and value.strip()]


def rule_regex(rule: str) -> str:
    """A rule path as an anchored regular expression: ``*`` for anything, a final ``$`` for the end."""
    end = rule.endswith("$")
    body = ".*".join(re.escape(p) for p in (rule[:-1] if end else rule).split("*"))
    return f"(?s)^{body}{'$' if end else ''}"


def rules_for(text: str, agent: str) -> list[tuple[bool, str]]:
    """Rules of the group whose name is the longest that the agent starts with or holds; else of ``*``; else none."""
    g = groups(text)
    agent = (agent or "*").lower()
    named = [a for a in g if a != "*" and a and a in agent]
    return g[max(named, key=len)] if named else g.get("*", [])


def allowed(text: str | None, target: str, agent: str = "*") -> bool:
    """Whether a path (or URL) may be fetched; everything may without data."""
    if not text:
        return True
    if "://" in target:
        parts = urlsplit(target)
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    best = (-1, True)
    for allow, rule in rules_for(text, agent):
        if re.match(rule_regex(rule), target):
            best = max(best, (len(rule), allow))
    return best[1]


def gate(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls (url, ...) with ``robots_allowed``: joined with robots (origin, text) on the origin; no file allows all.

    Rules without a wildcard are prefixes: a path meets them by equal prefixes, of the lengths that its origin's rules have, so ten thousand rules of an
    origin cost a URL a few look-ups. Only rules with ``*`` or ``$`` meet it as regular expressions. Each distinct path is judged once.
    """
    rules = saved(rule_table(robots, agent), "robots-rules")
    target = F.concat(F.when(path("url") == "", "/").otherwise(path("url")), F.regexp_extract("url", r"(\?[^#]*)", 1))
    d = urls.withColumn("_o", origin("url")).withColumn("_p", target)
    paths = d.select("_o", "_p").filter("_o IS NOT NULL AND _p IS NOT NULL").distinct()
    literal = rules.filter("literal IS NOT NULL").select(F.col("origin").alias("_o"), F.col("literal").alias("_prefix"), "size", "allow")
    lengths = literal.groupBy("_o").agg(F.collect_set("size").alias("_sizes"))  # at most as many as the longest rule is long
    prefixes = paths.join(lengths, "_o").select("_o", "_p", F.explode(F.filter("_sizes", lambda n: n <= F.char_length("_p"))).alias("_n"))
    by_prefix = prefixes.withColumn("_prefix", F.expr("substring(_p, 1, _n)")).join(literal, ["_o", "_prefix"]).select("_o", "_p", "size", "allow")
    wild = rules.filter("literal IS NULL").select(F.col("origin").alias("_o"), "pattern", "size", "allow")
    by_pattern = paths.join(wild, "_o").filter(F.expr("_p RLIKE pattern")).select("_o", "_p", "size", "allow")
    best = by_prefix.unionByName(by_pattern).groupBy("_o", "_p").agg(F.max(F.struct("size", "allow"))["allow"].alias("_a"))
    return d.join(best, ["_o", "_p"], "left").select(*(F.col(f"`{c}`") for c in urls.columns), F.coalesce("_a", F.lit(True)).alias("robots_allowed"))


def rule_table(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, allow, pattern, size, literal): the rules that hold for an agent, a row each; ``literal`` is the prefix a rule without wildcards is."""
    names = ["origin", "allow", "pattern", "size", "literal"]
    kinds = [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [
                (o, a, rule_regex(r), len(r), None if "*" in r or r.endswith("$") else r)
                for o, t in zip(batch.column("origin").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for a, r in rules_for(t or "", agent)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return robots.select("origin", "text").mapInArrow(run, "origin string, allow boolean, pattern string, size int, literal string")


def sitemap_table(robots: DataFrame) -> DataFrame:
    """robots (origin, text) -> (origin, sitemap): the sitemaps that robots files name, a row each."""

    def run(batches):
        for batch in batches:
            rows = [(o, u) for o, t in zip(batch.column("origin").to_pylist(), batch.column("text").to_pylist(), strict=True) for u in sitemaps(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in rows], pa.string()), pa.array([u for _, u in rows], pa.string())], names=["origin", "sitemap"])

    return robots.select("origin", "text").mapInArrow(run, "origin string, sitemap string")
