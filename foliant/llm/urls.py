"""URL filters with redirect equivalence, in DataFrame operations only.

Rules judge a URL by host and path. Redirect and canonical-link edges between pages join URLs into components, and a
component hands its decision to those of its URLs that no rule fits: allow if a rule allows one of them, else block if
a rule blocks one, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: Rules given as a list become one expression; more than this many must come as a table.
MOST_INLINE = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of the edges that a page states itself: canonical links, and refreshes to another address.
LINK_TAG, REFRESH_TAG = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
REL_CANONICAL, HREF = r"(?i)\brel\s*=\s*[\"']?\s*canonical\b", r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
IS_REFRESH, REFRESH_URL = r"(?i)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls`` (with ``url``) with ``host``, ``path``, ``rule`` and ``said``, the verdict of the longest rule that fits or null.

    A list is evaluated in place. A table ``host, path, verdict`` of any size is joined on the suffixes of each distinct host."""
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if isinstance(rules, DataFrame):
        keys = parts.select("host", "path").distinct()
        labels = F.split("host", r"\.")
        suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
        given = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host is not null and rule_path is not null")
        met = keys.withColumn("rule_host", suffix).join(given, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
        name = F.concat("rule_host", "rule_path")
        best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("verdict").alias("said"))).alias("b")).select("host", "path", "b.rule", "b.said")
        return parts.join(best, ["host", "path"], "left")
    if len(rules) > MOST_INLINE:
        raise ValueError(f"more than {MOST_INLINE} rules must come as a table")
    return parts.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("fit.rule"), "said": F.col("fit.verdict")}).drop("fit")


def _absolute(base: Column, href: Column) -> Column:
    scheme, host = F.substring_index(base, "://", 1), host_of(base)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(F.instr(href, "://") > 0, href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), host, href))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` from each page's URL to the addresses of its canonical links and refreshes."""
    html = F.col("html")
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: t.rlike(REL_CANONICAL))
    metas = F.filter(F.regexp_extract_all(html, F.lit(REFRESH_TAG), F.lit(0)), lambda t: t.rlike(IS_REFRESH))
    to = F.concat(F.transform(links, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, REFRESH_URL, 1)))
    near = pages.where(F.col("url").contains("://") & (html.rlike(REL_CANONICAL) | html.rlike(IS_REFRESH)))
    out = near.select("url", F.explode(to).alias("href")).where("href <> ''")
    return out.select(F.col("url").alias("u"), _absolute(F.col("url"), F.col("href")).alias("v")).where("u <> v")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (with ``url`` and ``html``).

    ``redirects``: more edges, as columns ``u`` and ``v``. A null URL, or one without ``://``, has empty host and path, no
    rule and no alias, so it is allowed. Repeated rows stay; extra columns are ignored."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("u", "v"))
    roots = components(edges)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    said = with_rules(nodes.withColumnRenamed("node", "url"), rules)
    decided = said.groupBy("root").agg(F.bool_or(F.coalesce(F.col("said") == "allow", F.lit(False))).alias("allowed"), F.bool_or(F.coalesce(F.col("said") == "block", F.lit(False))).alias("blocked"))
    blocked = said.where("said is null").join(decided.where("blocked and not allowed"), "root").select("url", F.lit("block").alias("handed"))
    own = with_rules(pages.select(F.col(id_col).alias("page_id"), "url"), rules)
    return own.join(blocked, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "handed", F.lit("allow")).alias("verdict"))
