"""URL redirects at table scale: versioned paths, renames, legacy layouts and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_semver, major


def versioned(urls: DataFrame, plan: DataFrame, renamed: DataFrame) -> DataFrame:
    """urls (path) with target: where a versioned path points now, null if it stays.

    plan (package, latest, archives) has one row a package, renamed (old, package) one a retired name; both are configuration and join by equality.
    A retired name goes to the same page under the new one. A package's root goes to its latest version; a version of the latest
    major too; one of an archived major to that archive; any other to the latest root.
    """
    u = urls.withColumns({"_pkg": F.regexp_extract("path", "^/api/([^/]+)", 1), "_seg": F.regexp_extract("path", "^/api/[^/]+/([^/]+)", 1), "_rest": F.regexp_extract("path", "^/api/[^/]+/[^/]+(/.*)$", 1)})
    p = plan.select(F.col("package").alias("_pkg"), "latest", "archives")
    r = renamed.join(plan.select("package"), "package").select(F.col("old").alias("_pkg"), F.col("package").alias("_new"))
    u = u.join(p, "_pkg", "left").join(r, "_pkg", "left")
    last = F.element_at(F.filter(F.split("_rest", "/"), lambda s: s != ""), -1)
    page = F.when(F.size(F.filter(F.split("_rest", "/"), lambda s: s != "")) > 0, last).otherwise("")
    moved = F.when((page == "") | (page == F.col("_pkg")), F.concat(F.lit("/api/"), "_new", F.lit("/latest/"))).otherwise(
        F.concat(F.lit("/api/"), "_new", F.lit("/latest/"), F.when(F.expr("startswith(_page, concat(_pkg, '.'))"), F.expr("concat(_new, substring(_page, length(_pkg) + 1))")).otherwise(F.col("_page")), F.lit("/"))
    )
    u = u.withColumn("_page", page)
    dupe = (F.col("_rest") == F.concat(F.lit("/"), "_pkg", F.lit("/"))) | (F.col("_rest") == F.concat(F.lit("/"), "_pkg"))
    tail = F.when(dupe | (F.col("_rest") == ""), "/").otherwise(F.col("_rest"))
    root = lambda seg: F.concat(F.lit("/api/"), "_pkg", F.lit("/"), seg)
    kept = (F.col("_seg") == "latest") | F.array_contains(F.coalesce("archives", F.array().cast("array<string>")), F.col("_seg"))
    archive = F.get(F.filter("archives", lambda a: major(a) == major("_seg")), F.lit(0))
    target = (
        F.when(F.col("_new").isNotNull(), moved)
        .when(F.col("latest").isNull(), None)
        .when(F.col("_seg") == "", root(F.lit("latest/")))
        .when(kept & dupe, F.concat(root(F.col("_seg")), F.lit("/")))
        .when(kept | ~is_semver("_seg"), None)
        .when(major("_seg") == major("latest"), F.concat(root(F.lit("latest")), tail))
        .when(archive.isNotNull(), F.concat(root(archive), tail))
        .otherwise(root(F.lit("latest/")))
    )
    return u.select(*urls.columns, target.alias("target"))


def salvaged(urls: DataFrame, reexports: DataFrame, moved_pages: DataFrame, archived: DataFrame) -> DataFrame:
    """urls (path) that were not found, with salvage: a symbol that moved (reexports: from_package, to_package, symbol), a renamed page (moved_pages: old, new), or
    the page of a legacy layout (archived: page) if it existed, else its index."""
    u = urls.withColumns(
        {
            "_p": F.regexp_extract("path", r"^/api/([^/]+)/latest/", 1),
            "_sym": F.lower(F.regexp_extract("path", r"^/api/[^/]+/latest/[^/.]+\.([A-Za-z0-9._-]+?)/?$", 1)),
            "_key": F.lower(F.regexp_extract("path", "^/api/(.+?)/?$", 1)),
            "_leg": F.regexp_extract("path", r"^/api/([^/]+/[^/]+)/(?:classes|interfaces|enums)/[^/]+\.html$", 1),
            "_nav": F.regexp_extract("path", r"^/api/([^/]+/[^/]+)/(?:(?:globals|modules)\.html|modules/[^/]+\.html)$", 1),
            "_cls": F.lower(F.regexp_extract("path", r"^/api/[^/]+/[^/]+/(?:classes|interfaces|enums)/([^/]+)\.html$", 1)),
        }
    )
    u = u.withColumn("_old", F.concat("_leg", F.lit("/"), F.split("_leg", "/")[0], F.lit("."), "_cls"))
    x = reexports.select(F.col("from_package").alias("_p"), F.lower("symbol").alias("_sym"), F.col("to_package").alias("_to"))
    m = moved_pages.select(F.lower("old").alias("_key"), F.col("new").alias("_new"))
    a = archived.select(F.col("page").alias("_old"), F.lit(True).alias("_had")).distinct()
    u = u.join(x, ["_p", "_sym"], "left").join(m, "_key", "left").join(a, "_old", "left")
    out = F.coalesce(
        F.when(F.col("_to").isNotNull(), F.concat(F.lit("/api/"), "_to", F.lit("/latest/"), "_to", F.lit("."), "_sym", F.lit("/"))),
        F.when(F.col("_new").isNotNull(), F.concat(F.lit("/api/"), "_new", F.lit("/"))),
        F.when(F.col("_nav") != "", F.concat(F.lit("/api/"), "_nav", F.lit("/"))),
        F.when((F.col("_leg") != "") & F.coalesce("_had", F.lit(False)), F.concat(F.lit("/api/"), "_old", F.lit("/"))),
        F.when(F.col("_leg") != "", F.concat(F.lit("/api/"), "_leg", F.lit("/"))),
    )
    return u.select(*urls.columns, out.alias("salvage"))


def resolve(urls: DataFrame, plan, renamed, reexports, moved_pages, archived) -> DataFrame:
    """urls (path, status) with location: versions and renames first, salvage only for what was not found."""
    u = salvaged(versioned(urls, plan, renamed), reexports, moved_pages, archived)
    return u.select(*urls.columns, F.coalesce("target", F.when(F.col("status") == 404, F.col("salvage"))).alias("location"))


def audit(urls: DataFrame, pages: DataFrame, plan: DataFrame, renamed: DataFrame) -> DataFrame:
    """(path, target, problem): targets that redirect again, name themselves, or are no page (pages: path)."""
    one = versioned(urls, plan, renamed).where("target IS NOT NULL")
    two = versioned(one.select(F.col("path").alias("_from"), F.col("target").alias("path")), plan, renamed).select(F.col("_from").alias("path"), F.col("target").alias("again")).distinct()
    j = one.join(two, "path").join(pages.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left")
    problem = F.when(F.col("path") == F.col("target"), "self").when(F.col("again").isNotNull(), "chain").when(F.col("there").isNull(), "missing")
    return j.select("path", "target", problem.alias("problem")).where("problem IS NOT NULL")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (path) with location and status of the first rule in order that matches; rules (rule_idx, source, target, status).

    A source that ends in /* matches every path below it. Paths are exploded into their own prefixes, so that both kinds are an equi-join however many rules there are.
    """
    u = urls.select("path").distinct()
    n = F.size(F.split("path", "/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i), "/"), F.lit("/")))
    keys = F.concat(F.transform(prefixes, lambda p: F.struct(p.alias("key"), F.lit(True).alias("splat"))), F.array(F.struct(F.col("path").alias("key"), F.lit(False).alias("splat"))))
    k = u.select("path", F.explode(keys).alias("x")).select("path", "x.key", "x.splat").distinct()
    r = rules.select("rule_idx", "target", "status", F.col("source").endswith("/*").alias("splat"), F.when(F.col("source").endswith("/*"), F.expr("left(source, length(source) - 1)")).otherwise(F.col("source")).alias("key"))
    hit = k.hint("merge").join(r, ["key", "splat"])
    to = F.when(F.col("splat"), F.expr("replace(target, ':splat', substring(path, length(key) + 1))")).otherwise(F.col("target"))
    first = hit.groupBy("path").agg(F.min_by(F.struct(to.alias("location"), "status"), "rule_idx").alias("f"))
    return urls.join(first.select("path", "f.location", "f.status").hint("merge"), "path", "left")
