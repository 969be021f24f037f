"""URL filters by a path-template tree, with DataFrame functions alone.

Rules come first: a rule fits its host and all subdomains where the path starts with the rule's, and the longest wins.
URLs that a rule judges are the labelled ones, and teach the tree.

Per host, a path's segments are generalised level by level; digit runs are '#' from the start.  Branches of a node that
have the same structure (the commonest skeleton of what stands from there on, with any letters as one sign and any digits
as another) are compared by their labels: a labelled branch whose share of blocked URLs differs from that of the alike
ones by more than chance keeps its own name; all the others are one variable segment, '*'.  Branches without labels have
nothing to differ by, so they join the labelled ones that are built like them, at any number of branches; branches that
are built otherwise don't count.  A node with one branch keeps it, and a node with one shape below takes the whole rest.

A template is rejected where its smoothed share of blocked URLs is over a half: labels count as they are, and a URL
without a label counts as half an allowed one, so few labels don't speak for many URLs.

Defined results: a null url, or one without '://', has empty host and path and is judged like any other; rows that
repeat a page_id are judged each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyline.llm.common import ascii_lower, durable

#: The rules of the contract as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The deviation that still counts as chance; blocked and allowed labels that every template has beforehand; allowed
#: labels that a URL without a label counts as.
CHANCE, PRIOR, SILENT = 1.96, (1.0, 2.0), 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, as a string like `net/`, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last to fit is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def skeleton(rest: Column) -> Column:
    """What structure the rest of a path has: letters as 'w', digits as '#', without a last slash or an extension."""
    plain = F.regexp_replace(rest, r"(\.[A-Za-z0-9]{1,5})?/*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\p{L}+", "w"), "[0-9#]+", "#")


def named_branches(rows: DataFrame) -> DataFrame:
    """Rows (host, template, segment, name) from rows (host, template, segment, rest, urls, labels, blocked)."""
    node = ["host", "template"]
    kind = skeleton(F.concat_ws("/", "segment", "rest"))
    kinds = rows.groupBy(*node, "segment", kind.alias("kind")).agg(
        *[F.sum(c).alias(c) for c in ("urls", "labels", "blocked")]
    )
    branches = kinds.groupBy(*node, "segment").agg(
        F.max_by("kind", F.struct("urls", "kind")).alias("kind"), *[F.sum(c).alias(c) for c in ("labels", "blocked")]
    )
    # a host's branches can be many, so groups of alike ones are summed and joined, not gathered in a window
    branches = durable(branches)
    alike = branches.groupBy(*node, "kind").agg(F.count("*").alias("n"), F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    share, among = F.try_divide("blocked", "labels"), F.try_divide("all_blocked", "all_labels")
    chance = CHANCE * F.sqrt(F.try_divide(among * (1 - among), F.col("labels")))
    differs = F.coalesce(F.abs(share - among) > chance, F.lit(False))
    alone = (F.col("n") == 1) | (F.col("segment") == "")
    name = F.when(alone | differs, F.concat(F.lit("/"), "segment")).otherwise(F.concat(F.lit("/*<"), "kind", F.lit(">")))
    return branches.join(alike, [*node, "kind"]).select(*node, "segment", name.alias("name"))


def templates(urls: DataFrame) -> DataFrame:
    """Rows (host, shape, urls, labels, blocked, template) from rows (host, shape, said), one for each host and shape."""
    counts = [F.count("*").alias("urls"), F.count("said").alias("labels"), F.count_if(F.col("said") == "block").alias("blocked")]
    tree = urls.groupBy("host", "shape").agg(*counts)
    rest = F.regexp_replace("shape", "^/", "")
    tree = durable(tree.select("*", rest.alias("rest"), F.lit("").alias("template"), (F.col("shape") == "").alias("ended")))
    while True:
        # nodes with one shape left take the whole rest, so what goes on is where paths part
        ends = tree.where("NOT ended").groupBy("host", "template").agg(F.min("rest").alias("a"), F.max("rest").alias("b"))
        parted = ends.where("a <> b").select("host", "template", F.lit(True).alias("parts"))
        tree = durable(tree.join(parted, ["host", "template"], "left").withColumn("parts", F.col("parts").isNotNull() & ~F.col("ended")))
        if not tree.where("parts").limit(1).count():
            break
        slash = F.instr("rest", "/")
        segment = F.when(slash > 0, F.substring("rest", F.lit(1), slash - 1)).otherwise(F.col("rest"))
        after = F.when(slash > 0, F.substring("rest", slash + 1, F.char_length("rest"))).otherwise("")
        open_ = tree.where("parts").withColumn("segment", segment).withColumn("ended", slash == 0).withColumn("rest", after)
        named = named_branches(open_)
        open_ = open_.join(named, ["host", "template", "segment"]).withColumn("template", F.concat("template", "name"))
        tree = durable(tree.where("NOT parts").drop("parts").unionByName(open_.drop("parts", "segment", "name")))
    whole = F.when(F.col("ended"), F.col("template")).otherwise(F.concat("template", F.lit("/"), "rest"))
    return tree.select("host", "shape", "urls", "labels", "blocked", whole.alias("template"))


def rejected_shapes(urls: DataFrame) -> DataFrame:
    """Rows (host, shape, template) of the templates to reject, from rows (host, shape, said)."""
    tree = durable(templates(urls))
    totals = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("urls", "labels", "blocked")])
    purity = (F.col("blocked") + PRIOR[0]) / (F.col("labels") + sum(PRIOR) + SILENT * (F.col("urls") - F.col("labels")))
    bad = totals.where(purity > 0.5).select("host", "template")
    return tree.join(bad, ["host", "template"]).select("host", "shape", "template")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template (of rejected ones, else null)."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = by_rule(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace("path", "[0-9]+", "#")
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), shape.alias("shape"))
    # written, so that both sides of the join are dealt afresh and a hot host can be split
    bad = durable(rejected_shapes(urls))
    verdict = F.coalesce("said", F.when(F.col("template").isNotNull(), "block").otherwise("allow"))
    return urls.join(bad, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template"
    )
