"""URL filter: rules, and trust and distrust spread over the links between hosts.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; its path goes on up to ``?``, ``#`` or the end.  A rule is a
host and a path, written together: it fits the host and all its subdomains where
the path starts with the rule's.  The longest rule wins, block before allow.

Where no rule fits, the host decides.  Pages under an allow rule are trusted
seeds of their host, those under a block rule blocked seeds.  Trust follows
links: a host passes ``DAMPING`` of what it receives in equal shares to the hosts it links
to.  Distrust runs against them: a host passes it to the hosts that link to it.
This is personalised PageRank as a sum over walks, with the mass of hosts without
links let go.  A host is blocked if distrust per page reaches
``BLOCK_PER_PAGE`` and exceeds trust.

Both run in one iteration: a join of the mass that arrived last with the links,
and a sum combined before its shuffle.  Iterations end when all mass that is still
to arrive, at all hosts together, is below ``REST_SHARE`` of what blocks the host
with the fewest pages; links of a host to itself pass nothing on.  Links come from the pages'
``href`` attributes; those without a host stay on their own host.

Nulls: a null url, or one without ``://``, has an empty host and path, and is no
seed; a null page has no links.  Repeated pages count as often as they come.  A page of
any length is gone through once.  An empty table gives no rows.  Other columns of the
pages, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

DAMPING = 0.85
#: Where ``spread`` is not given a rest, and in the SQL: walks end here, and at less mass.
MOST_STEPS = 24
LEAST_MASS = 1e-6
#: Of the distrust that blocks the smallest host, what may be left on the way.
REST_SHARE = 1e-6
#: Iterations whose mass is added up in one table.
FOLDED = 16
BLOCK_PER_PAGE = 0.5
MOST_RULES = 1_000

# A tag ends at the next "<" as well, so that no text is gone through twice.
_HREF = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str], column: str) -> Column:
    """The longest fitting rule (``column`` "rule") or what it says ("verdict")."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; join a table of rules instead")
    found = F.lit(None).cast("string")
    # the last test stands outermost and wins
    for rule, verdict in sorted(rules.items(), key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith("." + name)
        fits = on_host & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule if column == "rule" else verdict)).otherwise(found)
    return found


def host_links(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Distinct links between different hosts, ``src`` and ``dst``, of pages with a ``host``."""
    links = pages.where("host != ''").select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.col(payload), F.lit(_HREF), F.lit(1))).alias("href"),
    )
    # "//host/path" has the scheme of its page
    whole = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    absolute = whole.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://")
    links = links.where(absolute).select("src", host_of(whole).alias("dst"))
    return links.where("dst != '' AND dst != src").distinct()


def spread(
    seeds: DataFrame,
    links: DataFrame,
    damping: float = DAMPING,
    least: float = LEAST_MASS,
    rest: float | None = None,
) -> DataFrame:
    """Mass per ``host`` and ``kind`` from ``seeds`` (host, kind, mass).

    Kind ``trust`` follows ``links``, kind ``distrust`` runs against them.  With a
    ``rest`` walks have any number of steps and no mass is let go: it ends when all
    that would still arrive is less than that.
    """
    forward = links.join(links.groupBy("src").agg(F.count("*").alias("n")), "src")
    backward = links.join(links.groupBy("dst").agg(F.count("*").alias("n")), "dst")
    part = (F.lit(damping) / F.col("n")).alias("part")
    steps = stored(
        forward.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), part)
        .union(backward.select(F.lit("distrust"), F.col("dst"), F.col("src"), part)),
        "steps",
    )
    total = stored(seeds.select("host", "kind", "mass"), "mass")
    arrived, last, step = [total], total, 0
    while rest is not None or step < MOST_STEPS:
        step += 1
        moved = last.join(steps, ["host", "kind"])
        moved = moved.groupBy(F.col("next").alias("host"), "kind").agg(
            F.sum(F.col("mass") * F.col("part")).alias("mass")
        )
        last = stored(moved.where(F.col("mass") >= least) if rest is None else moved, "mass")
        moving = last.agg(F.sum("mass")).first()[0]
        if moving is None:
            break
        arrived.append(last)
        # of what has just arrived, all later steps pass on the sum of a geometric series
        if rest is not None and moving * damping / (1 - damping) < rest:
            break
        if len(arrived) > FOLDED:
            arrived = [stored(_summed(arrived), "mass")]
    return _summed(arrived)


def _summed(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables).groupBy("host", "kind").agg(F.sum("mass").alias("mass"))


def judge(
    pages: DataFrame,
    rules: dict[str, str],
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    block_per_page: float = BLOCK_PER_PAGE,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page."""
    host, path = F.col("host"), F.col("path")
    read = pages.select(
        F.col(page).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.col(payload).alias("payload"),
    )
    ruled = read.select(
        "page_id",
        "host",
        "path",
        matching_rule(host, path, rules, "rule").alias("rule"),
        matching_rule(host, path, rules, "verdict").alias("ruled"),
    )
    counts = ruled.where("host != ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("trust"),
        F.count(F.when(F.col("ruled") == "block", 1)).cast("double").alias("distrust"),
    )
    counts = stored(counts, "hosts")
    seeds = counts.unpivot("host", ["trust", "distrust"], "kind", "mass").where("mass > 0")
    smallest = counts.agg(F.min("pages")).first()[0] or 1
    rest = REST_SHARE * block_per_page * smallest
    mass = spread(seeds, stored(host_links(read, "payload"), "links"), rest=rest)
    kinds = mass.groupBy("host").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    bad = F.col("distrust") >= F.col("pages") * block_per_page
    blocked = (
        counts.select("host", "pages")
        .join(kinds, "host")
        .where(bad & (F.col("distrust") > F.col("trust")))
        .select("host", F.lit("block").alias("by_host"))
    )
    verdict = F.coalesce("ruled", "by_host", F.lit("allow"))
    return ruled.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict")
    )
