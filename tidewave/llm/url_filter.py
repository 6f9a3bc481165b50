"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is (host, path, verdict): it fits its host and all subdomains, if the
URL's path starts with the rule's. A URL expands into its host's suffixes by
label, each with its path's prefixes that end in '/', but no more labels or
slashes than any rule has, so the expansion is bounded by the rules. Rules and
expressions meet on four bytes of SHA-256; then the whole digests, and the part
of the rule's path after its last '/', are confirmed. The longest rule wins,
and of equally long ones block. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are sent to all executors (about 100 bytes each).
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first '://' up to '/', '?', '#' or the end, lower-cased; then up to '?', '#' or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(before, r"(?s)^([^/]*)", 1)
    return lower_ascii(host), F.substring(before, F.length(host) + 1, F.length(before))


def _rules(rules: DataFrame) -> DataFrame:
    r = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null")
    # the part up to the last '/' is what expressions can equal
    stem = F.regexp_extract("r_path", r"(?s)^(.*/)", 1)
    r = r.withColumn("digest", F.sha2(F.concat(F.col("r_host"), F.lit("\0"), stem), 256)).withColumn("labels", F.size(F.split("r_host", "\\."))).withColumn("slashes", F.size(F.split("r_path", "/")) - 1)
    return r.withColumn("short", F.substring("digest", 1, 8)).dropDuplicates(["r_host", "r_path", "r_verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict; a row for each input row.

    rule is host + path of the winning rule, or null; verdict its own, or
    `default`. A null URL, or one without '://', has empty host and path and
    meets no rule. Repeated rows stay, an empty table stays empty, and long URLs expand no
    further than the rules reach. rules: host, path, verdict ('block' or 'allow').
    """
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rules = _rules(rules)
    n, labels, slashes = rules.agg(F.count(F.lit(1)), F.coalesce(F.max("labels"), F.lit(1)), F.coalesce(F.max("slashes"), F.lit(0))).first()
    rules = F.broadcast(rules) if n <= BROADCAST_RULES else rules
    # equal (host, path) pairs are judged once
    keys = urls.select("host", "path").where("host <> ''").distinct()
    hosts = F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    stems = F.transform(F.sequence(F.lit(0), F.lit(slashes)), lambda k: F.when(k == 0, F.lit("")).when(F.size(F.split("path", "/")) > k, F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))))
    wide = keys.withColumn("suffix", F.explode(F.array_distinct(hosts))).withColumn("stem", F.explode(F.filter(F.array_distinct(stems), lambda s: s.isNotNull())))
    wide = wide.withColumn("full", F.sha2(F.concat(F.col("suffix"), F.lit("\0"), F.col("stem")), 256)).withColumn("short", F.substring("full", 1, 8))
    met = wide.join(rules, "short").where((F.col("full") == F.col("digest")) & F.col("path").startswith(F.col("r_path")))
    order = F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.when(F.col("r_verdict") == "block", 1).otherwise(0), F.col("r_host"), F.col("r_path"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
