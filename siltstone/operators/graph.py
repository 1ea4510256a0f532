"""Site graph: link edges, reachability, redirect chains and audits of page sets."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import anchors, links, resolve_link, url_host
from ..storage import append_bucketed, cut, fresh


def edges(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> (src, raw, dst, frag, kind): kind ignored (mail, script, data, loopback), same-page, internal or external."""
    e = pages.select(F.col("url").alias("src"), F.explode(F.array_distinct(links("html"))).alias("raw"))
    full = resolve_link("src", "raw")
    e = e.withColumn("full", full).withColumns({"dst": F.regexp_replace("full", "#.*$", ""), "frag": F.regexp_extract("full", "#(.*)$", 1)})
    host, own = url_host("dst"), url_host("src")
    kind = (
        F.when(F.col("raw").rlike("(?i)^(?:mailto|tel|javascript|data):"), "ignored")
        .when(F.col("raw").startswith("#"), "same-page")
        .when(host.rlike(r"^(?:localhost|127\.0\.0\.1|\[::1\])$"), "ignored")
        .when(host == own, "internal")
        .otherwise("external")
    )
    return e.select("src", "raw", "dst", "frag", kind.alias("kind"))


def anchor_table(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.explode(anchors("html")).alias("id")).distinct()


#: Links of one page that stay together; those of a page with more are dealt to several buckets.
HEAVY = 100_000
#: Levels that may stand beside the compacted visited set.
FRESH_LEVELS = 16


def reachable(edge: DataFrame, seeds: DataFrame, stop=None, max_depth: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(node, depth): pages reached from seeds (node) over edge (src, dst), breadth first. Pages for which stop holds are reached but not followed.
    A null is no page. A crawl that would go past max_depth, where it is given, raises an error.

    Links are written once in buckets by source, with those of a heavy page in several. The visited set is in buckets, too, and grows by one
    appended level at a time, so a level shuffles its own pages and links only, and a lost executor repeats one level at most. From FRESH_LEVELS
    levels on they are compacted as soon as they hold as many pages as what was compacted before: at most three rows are written a page.
    """
    spark = edge.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path, name = fresh(spark, "crawl"), f"silt_{uuid.uuid4().hex}"
    links = edge.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    parts = cut(links.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("src", F.ceil(F.col("n") / heavy).cast("int").alias("parts")), "crawl-heavy")
    salt = F.coalesce(F.pmod(F.hash("dst"), F.col("parts")), F.lit(0)).alias("salt")
    links = append_bucketed(links.join(parts, "src", "left").select("src", salt, "dst"), f"{name}_links", f"{path}/links", buckets, "src", "salt")

    old, n_old = None, 0
    level = seeds.where("node IS NOT NULL").select("node").distinct()
    first, generation, n_new = 0, 0, 0
    for depth in itertools.count():
        seen = append_bucketed(level.withColumn("depth", F.lit(depth)), f"{name}_seen_{generation}", f"{path}/seen-{generation}", buckets, "node", partition="depth")
        front = seen.where(F.col("depth") == depth).select("node")
        n = front.count()
        if n == 0:
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"pages lie deeper than max_depth = {max_depth}")
        n_new += n
        if depth - first >= FRESH_LEVELS and n_new >= n_old:
            merged = seen if old is None else seen.unionByName(old)
            old = append_bucketed(merged.select("node", "depth"), f"{name}_old_{generation}", f"{path}/old-{generation}", buckets, "node")
            first, generation, n_old, n_new = depth + 1, generation + 1, n_old + n_new, 0
            seen = None
        go = front if stop is None else front.where(~stop)
        go = go.join(parts, go["node"] == parts["src"], "left").select("node", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("at"))
        level = links.join(go.hint("merge"), (F.col("src") == F.col("node")) & (F.col("salt") == F.col("at"))).select(F.col("dst").alias("node")).distinct()
        for known in (seen, old):
            if known is not None:
                level = level.join(known.select("node").hint("merge"), "node", "left_anti")
    seen = seen.select("node", "depth")
    return seen if old is None else seen.unionByName(old)


def follow(urls: DataFrame, hops: DataFrame, limit: int = 6) -> DataFrame:
    """urls (url) -> (url, final, n_hops, problem) over hops (source, target): at most limit joins; what still moves has too many redirects."""
    x = urls.select("url", F.col("url").alias("final"), F.lit(0).alias("n_hops"))
    h = hops.select("source", "target")
    for _ in range(limit):
        x = x.join(h, F.col("final") == F.col("source"), "left").select("url", F.coalesce("target", "final").alias("final"), (F.col("n_hops") + F.col("target").isNotNull().cast("int")).alias("n_hops"))
    x = x.join(h, F.col("final") == F.col("source"), "left")
    return x.select("url", "final", "n_hops", F.when(F.col("target").isNotNull(), "too many redirects").alias("problem"))


def link_status(edge: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    """edge (src, dst, frag) with reason: status 404 for a page that is not there, missing anchor for a fragment its page lacks, else null."""
    p = pages.select(F.col("url").alias("dst"), F.lit(True).alias("_page")).distinct()
    i = ids.select(F.col("url").alias("dst"), F.col("id").alias("frag"), F.lit(True).alias("_id")).distinct()
    j = edge.hint("merge").join(p, "dst", "left").hint("merge").join(i, ["dst", "frag"], "left")
    reason = F.when(F.col("_page").isNull(), "status 404").when((F.col("frag") != "") & F.col("_id").isNull(), "missing anchor")
    return j.withColumn("reason", reason).drop("_page", "_id")


def broken(edge: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, reason): the distinct broken links."""
    return link_status(edge, pages, ids).where("reason IS NOT NULL").select("src", "dst", "reason").distinct()


def external_inventory(edge: DataFrame, allowed_hosts: DataFrame, allowed_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(dst, host, n_links, allowed) of external links. A host is allowed with all below it: hosts are exploded into their suffixes for an equi-join."""
    e = edge.where("kind = 'external'").withColumn("host", F.coalesce(url_host("dst"), F.lit("")))
    hosts = e.select("host").distinct()
    parts = F.split("host", r"\.")
    suffix = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("entry"))
    ok = suffix.hint("merge").join(allowed_hosts.select(F.col("host").alias("entry")), "entry").select("host", F.lit(True).alias("_ok")).distinct()
    by_prefix = F.lit(False)
    for p in allowed_prefixes:
        by_prefix = by_prefix | F.col("dst").startswith(p)
    j = e.hint("merge").join(ok, "host", "left").withColumn("allowed", F.coalesce("_ok", F.lit(False)) | by_prefix)
    return j.groupBy("dst", "host", "allowed").agg(F.count("*").alias("n_links"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row claims."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): missing from right, or extra in right; null-safe and distinct."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def sitemap_audit(sitemap: DataFrame, pages: DataFrame, origin: str) -> DataFrame:
    """(loc, problem): foreign origin, duplicate, shape (no slash at the end), missing page, noindex page; and pages (url, noindex) that are unlisted."""
    n = sitemap.groupBy("loc").agg(F.count("*").alias("n"))
    j = n.join(pages.select(F.col("url").alias("loc"), "noindex"), "loc", "left")
    checks = F.array_compact(F.array(
        F.when(~F.col("loc").startswith(origin + "/"), "foreign origin"), F.when(F.col("n") > 1, "duplicate"), F.when(~F.col("loc").endswith("/"), "shape"),
        F.when(F.col("loc").startswith(origin + "/") & F.col("noindex").isNull(), "missing"), F.when(F.col("noindex"), "noindex"),
    ))
    listed = j.select("loc", F.explode(checks).alias("problem"))
    unlisted = pages.where("NOT noindex").select(F.col("url").alias("loc")).join(sitemap.select("loc").distinct(), "loc", "left_anti").withColumn("problem", F.lit("unlisted"))
    return listed.unionByName(unlisted)


def index_audit(records: DataFrame, sections: DataFrame, pages: DataFrame, ids: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(url, problem) over an index: stale records, dangling anchors, malformed records, pages without a record; ranges out of order, and with lines (url, no, line)
    of the pages' mirrors, ranges that do not begin on a heading of level 2 or 3, cut a code fence in two, or whose page has no mirror.

    Fences are counted once along each page; a range holds the difference of the counts at its two ends.
    """
    stale = records.join(pages.select("url").distinct().hint("merge"), F.split(records["url"], "#")[0] == pages["url"], "left_anti").select("url", F.lit("stale").alias("problem"))
    deep = sections.where("anchor <> ''").select("url", F.col("anchor").alias("id"))
    dangling = deep.join(ids.select("url", "id").distinct().hint("merge"), ["url", "id"], "left_anti").select("url", F.lit("dangling anchor").alias("problem"))
    malformed = records.where("title IS NULL OR title = '' OR url IS NULL OR NOT url LIKE '/%'").select("url", F.lit("malformed").alias("problem"))
    ranges = sections.where("start < 0 OR end < start").select("url", F.lit("range").alias("problem"))
    covered = records.select(F.split("url", "#")[0].alias("url")).distinct()
    uncovered = pages.select("url").join(covered.hint("merge"), "url", "left_anti").select("url", F.lit("not covered").alias("problem"))
    out = stale.unionByName(dangling).unionByName(malformed).unionByName(ranges).unionByName(uncovered)
    if lines is not None:
        along = W.partitionBy("url").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
        fence = F.col("line").rlike(r"^\s{0,3}(?:```+|~~~+)").cast("int")
        at = lines.select("url", "no", F.col("line").rlike(r"^#{2,3}\s+").alias("head"), F.coalesce(F.sum(fence).over(along), F.lit(0)).alias("before"), (F.coalesce(F.sum(fence).over(along), F.lit(0)) + fence).alias("upto"))
        own = sections.where("anchor <> '' AND end > start").select("url", "start", "end").distinct()
        one = own.hint("merge").join(at.select("url", F.col("no").alias("start"), "head", "before"), ["url", "start"], "left")
        both = one.hint("merge").join(at.select("url", (F.col("no") + 1).alias("end"), "upto"), ["url", "end"], "left")
        mirrored = both.hint("merge").join(lines.select("url", F.lit(True).alias("mirror")).distinct(), "url", "left")
        problem = F.when(F.col("mirror").isNull(), "no mirror").when(~F.coalesce("head", F.lit(False)), "no heading").when((F.col("upto") - F.col("before")) % 2 != 0, "unbalanced fence")
        out = out.unionByName(mirrored.select("url", problem.alias("problem")).where("problem IS NOT NULL"))
    return out.distinct()


def twin_differences(files: DataFrame, left: str, right: str) -> DataFrame:
    """files (path, content) under two roots: keys whose contents differ or that one root lacks."""
    f = files.select(F.when(F.col("path").startswith(left), "l").when(F.col("path").startswith(right), "r").alias("side"), F.regexp_replace("path", f"^(?:{left}|{right})", "").alias("key"), F.sha2("content", 256).alias("digest")).where("side IS NOT NULL")
    g = f.groupBy("key").agg(F.max(F.when(F.col("side") == "l", F.col("digest"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("digest"))).alias("r"))
    return g.where(~F.col("l").eqNullSafe(F.col("r")))


def json_nodes(blocks: DataFrame) -> DataFrame:
    """blocks (url, block) -> (url, id, type, ref_only, canonical, parsed): one row for each node of a structured-data block or its @graph.

    A block that is no JSON gives one row with parsed false. Node values stay JSON text.
    """
    v = blocks.withColumn("v", F.try_parse_json("block"))
    bad = v.where("v IS NULL").select("url", *[F.lit(None).cast("string").alias(n) for n in ("id", "type")], F.lit(False).alias("ref_only"), F.lit(None).cast("string").alias("canonical"), F.lit(False).alias("parsed"))
    graph = F.coalesce(F.try_variant_get("v", "$.@graph", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    n = v.where("v IS NOT NULL").select("url", F.explode(graph).alias("node"))
    get = lambda key: F.try_variant_get("node", f"$.{key}", "string")
    keys = F.json_object_keys(F.to_json("node"))
    good = n.select("url", get("@id").alias("id"), get("@type").alias("type"), (F.size(keys) == 1).alias("ref_only"), F.to_json("node").alias("canonical"), get("about.@id").alias("about"), F.lit(True).alias("parsed"))
    return good.unionByName(bad, allowMissingColumns=True)


def json_audit(nodes: DataFrame, forbidden: tuple[str, ...] = (), pages: DataFrame | None = None, subject: tuple[str, str, str] | None = None) -> DataFrame:
    """(url, id, problem): unparseable blocks, references inside a page without a definition there, ids with contradicting facts, persons without a name, forbidden
    keys; with pages (url) those that have no block at all; with subject (type, pattern of the url, id with $1 for its group) nodes of that type about anything else."""
    bad = nodes.where("NOT parsed").select("url", "id", F.lit("unparseable").alias("problem"))
    defined = nodes.where("parsed AND NOT ref_only AND id IS NOT NULL")
    refs = nodes.where("parsed").select("url", F.explode(F.regexp_extract_all("canonical", F.lit(r'\{"@id":"([^"]+)"\}'), F.lit(1))).alias("id")).distinct()
    dangling = refs.hint("merge").join(defined.select("url", "id").distinct(), ["url", "id"], "left_anti").select("url", "id", F.lit("dangling").alias("problem"))
    many = defined.groupBy("id").agg(F.countDistinct("canonical").alias("n"), F.min("url").alias("url")).where("n > 1").select("url", "id", F.lit("contradicting").alias("problem"))
    anonymous = defined.where("type = 'Person' AND NOT canonical LIKE '%\"name\":%'").select("url", "id", F.lit("anonymous person").alias("problem"))
    out = bad.unionByName(dangling).unionByName(many).unionByName(anonymous)
    for k in forbidden:
        out = out.unionByName(nodes.where(F.col("canonical").contains(f'"{k}":')).select("url", "id", F.lit(f"forbidden {k}").alias("problem")))
    if pages is not None:
        none = pages.select("url").join(nodes.select("url").distinct().hint("merge"), "url", "left_anti")
        out = out.unionByName(none.select("url", F.lit(None).cast("string").alias("id"), F.lit("missing").alias("problem")))
    if subject is not None:
        kind, pattern, of = subject
        own = nodes.where((F.col("type") == kind) & F.col("url").rlike(pattern))
        wanted = F.regexp_replace(F.regexp_extract("url", f"({pattern})", 1), pattern, of)
        out = out.unionByName(own.where(~F.col("about").eqNullSafe(wanted)).select("url", "id", F.lit("wrong about").alias("problem")))
    return out.distinct()


def node_types(nodes: DataFrame) -> DataFrame:
    """(type, n) of the nodes that have one."""
    return nodes.where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("n"))


def answers_in_page(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """answers (url, answer) with found: whether the page's text (pages: url, text) holds the answer, white space and case aside."""
    from ..functions.text import squash

    return answers.hint("merge").join(pages.select("url", squash("text").alias("_t")), "url", "left").withColumn("found", F.coalesce(F.col("_t").contains(squash("answer")), F.lit(False))).drop("_t")
