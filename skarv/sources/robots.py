"""robots.txt files as rule tables, and which paths an agent may fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules(files: DataFrame) -> DataFrame:
    """host, group_no, agent, rule_no, kind (allow|disallow), pattern of robots.txt files (host, content).

    A comment counts only where a line starts with `#`. A user-agent line after rules starts a new group; agents in a row share
    one. Lines before any user-agent and rules without value are left out. Null content gives no rows.
    """
    line = files.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "raw")).select("host", "line_no", F.trim("raw").alias("raw")).filter((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    parts = line.select("host", "line_no", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("key"), F.trim(F.expr("substring(raw, instr(raw, ':') + 1)")).alias("value")).filter(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("line_no")  # a file's lines, bounded by the file
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    grouped = parts.withColumn("group_no", F.sum(F.when(starts, 1).otherwise(0)).over(order)).filter("group_no > 0")
    agents = grouped.filter(is_agent).select("host", "group_no", F.lower("value").alias("agent"))
    kept = grouped.filter(~is_agent & (F.col("value") != "")).select("host", "group_no", F.col("line_no").alias("rule_no"), F.col("key").alias("kind"), F.col("value").alias("pattern"))
    return agents.join(kept, ["host", "group_no"])


def sitemaps(files: DataFrame) -> DataFrame:
    """host, url of the sitemap lines."""
    line = files.select("host", F.explode(F.split("content", r"\r?\n")).alias("raw"))
    return line.filter(F.lower(F.trim("raw")).startswith("sitemap:")).select("host", F.trim(F.expr("substring(raw, instr(raw, ':') + 1)")).alias("url"))


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as a regular expression from the start: `*` is anything, a `$` at the end is the end."""
    quoted = F.regexp_replace(pattern, r"([\\.+?^{}()|\[\]])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(quoted, r"\$$", ""), r"\*", ".*")
    body = F.regexp_replace(body, r"\$", r"\\\$")
    return F.concat(F.lit("^"), body, F.when(pattern.endswith("$"), "$").otherwise(""))


def allowed(paths: DataFrame, rule_table: DataFrame, agent: str) -> DataFrame:
    """host, path, allowed: the longest matching pattern of the agent's groups decides, of equal ones the later; none allows.

    Groups of an agent are those whose name is part of it or has it as a part, else those named `*`. Rules are joined by host,
    so a path meets only the rules of its own host.
    """
    who = agent.lower()
    named = (F.col("agent") != "*") & (F.lit(who).contains(F.col("agent")) | F.col("agent").contains(who))
    marked = rule_table.withColumn("named", named).withColumn("any", F.max("named").over(Window.partitionBy("host")))
    own = marked.filter(F.when(F.col("any"), F.col("named")).otherwise(F.col("agent") == "*")).select("host", "rule_no", "kind", "pattern", pattern_regex(F.col("pattern")).alias("rx")).distinct()
    one = paths.select("host", "path").distinct()
    hit = one.join(own, "host", "left").withColumn("hit", F.coalesce(F.expr("path rlike rx"), F.lit(False)))
    best = F.max_by(F.when(F.col("hit"), F.col("kind")), F.when(F.col("hit"), F.struct(F.length("pattern"), "rule_no")))
    return hit.groupBy("host", "path").agg(F.coalesce(best != "disallow", F.lit(True)).alias("allowed"))


def provider_blocks(paths: DataFrame, rule_table: DataFrame, agents: dict[str, list[str]]) -> DataFrame:
    """host, path, general_allowed, blocked_providers: providers of which any agent is kept out, in the order given."""
    every = sorted({a for v in agents.values() for a in v} | {"*"})
    out = paths.select("host", "path").distinct()
    for i, a in enumerate(every):
        out = out.join(allowed(paths, rule_table, a).withColumnRenamed("allowed", f"a{i}"), ["host", "path"])
    kept_out = {p: [f"a{every.index(a)}" for a in v] for p, v in agents.items()}
    cond = lambda cs: ~F.expr(" AND ".join(cs))
    blocked = F.array_compact(F.array(*[F.when(cond(cs), F.lit(p)) for p, cs in kept_out.items()]))
    return out.select("host", "path", F.col(f"a{every.index('*')}").alias("general_allowed"), blocked.alias("blocked_providers"))


#: The agents of each provider.
PROVIDER_AGENTS = {"openai": ["OAI-SearchBot", "GPTBot"], "google": ["Googlebot", "GoogleOther"], "bing": ["bingbot"], "perplexity": ["PerplexityBot"], "citation": ["*"]}
