"""URL filter by rules and, where none fits, by a tree of path templates for each host."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import store
from gradewell.operators.skew import own_shuffle

#: A branch with more than so many different segments becomes a wildcard.
MOST_BRANCHES = 24
#: Depth of the tree in segments; deeper segments share a tail wildcard.
DEPTH = 6
#: A template is rejected if its smoothed share of blocked urls reaches PURITY. STRENGTH labelled
#: urls, half of them blocked, are added to each template's.
PURITY, STRENGTH = 0.7, 4.0
#: Branches merge where their shares of blocked urls differ by less than so many standard errors.
ERRORS = 1.64


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, the first of the list among equals; else null.
    For lists of up to some hundred rules, as one expression."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(segment: Column) -> Column:
    """Parts of a segment that vary by form: long hexadecimal runs, numbers, and long words."""
    out = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "{h}")
    out = F.regexp_replace(out, r"[0-9]+", "{n}")
    return F.when(F.length(out) > 40, F.lit("{w}")).otherwise(out)


def path_segments(path: Column) -> Column:
    """The path's segments by shape, at most DEPTH and a tail for what is deeper."""
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)


def path_templates(urls: DataFrame) -> DataFrame:
    """(host, segments, template, purity, labelled) for each different (host, segments) of ``urls``
    (host, segments, blocked, n): blocked is 1, 0, or null where nothing is known.

    The tree is grown a level at a time over the different shapes of each host, which are few
    however many urls it has: a node's segments become a wildcard when there are more than
    MOST_BRANCHES of them; the others merge with their neighbours in the order of their smoothed
    shares while these do not differ significantly. Siblings of a node that survive are at most
    MOST_BRANCHES, so a window over them is small.
    """
    shapes = urls.groupBy("host", "segments").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("blocked").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"),
        F.sum(F.coalesce("blocked", F.lit(0)) * F.col("n")).alias("blocked"),
    )
    shapes = store(shapes.withColumn("template", F.lit("")), "shapes")
    known = shapes.agg(F.max(F.size("segments")).alias("depth")).first()

    def smoothed(blocked: str, labelled: str) -> Column:
        return (F.col(blocked) + STRENGTH / 2) / (F.col(labelled) + STRENGTH)

    for level in range(known["depth"] or 0):
        here = shapes.withColumn("segment", F.get("segments", F.lit(level)))
        branches = here.filter("segment is not null").groupBy("host", "template", "segment")
        branches = branches.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        width = branches.groupBy("host", "template").agg(F.count("*").alias("width"))
        branches = branches.join(own_shuffle(width, "host"), ["host", "template"])
        narrow = branches.filter(F.col("width") <= MOST_BRANCHES).withColumn("share", smoothed("b", "l"))
        order = Window.partitionBy("host", "template").orderBy("share", "segment")
        error = F.sqrt(F.greatest(F.col("share") * (1 - F.col("share")), F.lit(0.01)) / (F.col("l") + STRENGTH))
        narrow = narrow.withColumn("error", error)
        gap = F.col("share") - F.lag("share").over(order)
        apart = gap > ERRORS * F.sqrt(F.col("error") ** 2 + F.lag("error").over(order) ** 2)
        both = (F.col("l") > 0) & (F.lag("l").over(order) > 0)
        starts = F.coalesce(F.when(both, apart).otherwise(F.lit(True)), F.lit(True))
        narrow = narrow.withColumn("starts", starts.cast("int"))
        narrow = narrow.withColumn("run", F.sum("starts").over(order))
        run = Window.partitionBy("host", "template", "run")
        merged = narrow.withColumn("name", F.array_join(F.array_sort(F.collect_list("segment").over(run)), "|"))
        wide = branches.filter(F.col("width") > MOST_BRANCHES).withColumn("name", F.lit("*"))
        names = merged.select("host", "template", "segment", "name").union(wide.select("host", "template", "segment", "name"))
        grown = here.join(own_shuffle(names, "host"), ["host", "template", "segment"], "left")
        template = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        shapes = store(grown.select("host", "segments", "n", "labelled", "blocked", template.alias("template")), "shapes")
    leaves = shapes.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    leaves = leaves.select("host", "template", smoothed("b", "l").alias("purity"), F.col("l").alias("labelled"))
    return shapes.select("host", "segments", "template").join(leaves, ["host", "template"])


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, template, purity.

    The longest fitting rule decides. Where none fits, the url's template does: it is blocked if
    the smoothed share of blocked urls among the labelled ones of the template reaches PURITY,
    else allowed. A url's label is that of ``labels`` (id_col, blocked 0/1) where given, else its
    rule's verdict; a template without labelled urls is allowed.

    A null url, or one without ://, has an empty host and path and is judged like the other such
    urls. Rows that repeat are judged each; a page with several labels counts as blocked if one of
    them says so. An empty table gives an empty table.
    """
    seen = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    seen = seen.withColumns({"fit": fitting_rule(F.col("host"), F.col("path"), rules), "segments": path_segments(F.col("path"))})
    by_rule = F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int"))
    if labels is None:
        urls = seen.select("host", "segments", by_rule.alias("blocked"))
    else:
        said = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("blocked").cast("int").alias("said"))
        urls = seen.join(said, "_id", "left").select("host", "segments", F.coalesce("said", by_rule).alias("blocked"))
    urls = urls.groupBy("host", "segments", "blocked").agg(F.count("*").alias("n"))
    templates = own_shuffle(path_templates(urls), "host")
    judged = seen.join(templates, ["host", "segments"], "left")
    own = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return judged.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own).alias("verdict"),
        "template",
        F.round("purity", 6).alias("purity"),
    )
