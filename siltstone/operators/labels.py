"""Judged labels and generated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, clean_query, content_words, telling, typo, words

#: What each verdict of a judge stands for.
VERDICTS = (("good", "label"), ("ok", "label"), ("missing", "content gap"), ("wrong", "negative"), ("noise", "negative"))


def assemble(judged: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """judged (query, target, also, topic, src, verdict) -> (rows with their class, rows of an unknown verdict, which is an error)."""
    known = judged.join(F.broadcast(verdicts), "verdict")  # a fixed list
    return known, judged.join(verdicts, "verdict", "left_anti")


def held_out(labels: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    return labels.withColumn("held_out", F.col("topic").isin(*topics))


def not_decided_once(*parts: DataFrame) -> DataFrame:
    """(query, n): queries that the parts (query) hold more than once in all."""
    every = parts[0].select("query")
    for p in parts[1:]:
        every = every.unionByName(p.select("query"))
    return every.groupBy("query").agg(F.count("*").alias("n")).where("n <> 1")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("query").intersect(b.select("query"))


def harvested(raw: DataFrame, column: str) -> DataFrame:
    """(query): lower case, single spaces, over two letters, distinct, in order."""
    q = F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))
    return raw.select(q.alias("query")).where(F.length("query") > 2).distinct().orderBy("query")


def _subset(terms, size: int, seed: int):
    """size terms in the order of a keyed hash of each: the same whatever the partitioning."""
    hashes = F.transform(terms, lambda t: F.xxhash64(t, F.lit(seed)))
    # Only terms up to the last hash that counts are sorted; a list of one holds that hash, which is found once.
    last = F.array(F.try_element_at(F.slice(F.sort_array(hashes), 1, size), F.lit(-1)))
    few = F.transform(last, lambda m: F.filter(F.transform(terms, lambda t: F.struct(F.xxhash64(t, F.lit(seed)).alias("h"), t.alias("t"))), lambda x: x["h"] <= m))[0]
    return F.array_join(F.transform(F.slice(F.array_sort(few), 1, size), lambda x: x["t"]), " ")


TEMPLATES = ("how to %s", "what is %s", "%s example", "%s tutorial", "how do i %s", "%s not working", "best way to %s", "%s vs")


def too_common(df: DataFrame, sections: DataFrame, share: float = 0.05) -> DataFrame:
    """df (term, df): terms of so many sections that they say nothing as a query of their own."""
    n = F.broadcast(sections.agg(F.count("*").alias("_n")))  # one row
    return df.crossJoin(n).where(F.col("df") > F.greatest(F.lit(8), F.floor(F.col("_n") * share + 0.5))).drop("_n")


def worded(sections: DataFrame) -> DataFrame:
    """(url, heading, heading_words, body_words): sections with their words, for storage, so that texts are cut into words once."""
    listed = lambda c: F.coalesce(words(c), F.array().cast("array<string>")).alias(f"{c}_words")
    return sections.select("url", "heading", listed("heading"), listed("body"))


def _listed(sections: DataFrame, field: str):
    """The words of a field: those that worded() put beside it, else cut here."""
    return F.col(f"{field}_words") if f"{field}_words" in sections.columns else words(field)


def _each(rows: DataFrame, by: str, items, name: str) -> DataFrame:
    """(by, name): a row for each item. Outer, as Spark tells rows without items from the others by making the list twice."""
    return rows.select(by, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def salient(sections: DataFrame, df: DataFrame, low: int = 2, high: int = 12) -> DataFrame:
    """(url, terms): words over three letters that low to high sections have, rarest first."""
    own = F.array_distinct(F.filter(_listed(sections, "body"), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 3)))
    t = _each(sections, "url", own, "term")
    t = t.join(df.where(F.col("df").between(low, high)).hint("shuffle_hash"), "term")
    return t.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("terms"))


def section_df(sections: DataFrame) -> DataFrame:
    """(term, df) over heading and body."""
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(*[F.coalesce(_listed(sections, f), none) for f in ("body", "heading")]))
    return _each(sections.withColumn("_by", F.lit(0)), "_by", every, "term").groupBy("term").agg(F.count("*").alias("df"))


def generate(pages: DataFrame, sections: DataFrame, answers: DataFrame, symbols: DataFrame, df: DataFrame, seed: int = 1) -> DataFrame:
    """(query, url, bucket) before merging, without queries of a single common term.

    pages (url, title, summary, keywords), sections (url, heading, body), answers (url, title), symbols (url, title, keywords). Each table is read
    once: its queries are an array that is exploded.
    """
    # Words are listed once a row, in a projection of their own, and all subsets draw on the list.
    title, head, blurb = F.col("title_words"), F.col("heading_content"), F.col("blurb")
    pages = pages.withColumn("title_words", content_words("title")).withColumn("blurb", F.filter(content_words("summary"), lambda t: F.length(t) > 4))
    answers = answers.withColumn("title_words", content_words("title"))
    headed = sections.where("heading <> ''")
    headed = headed.withColumn("heading_content", F.filter(_listed(headed, "heading"), telling))
    one = lambda bucket, q, on=None: F.struct(F.lit(bucket).alias("bucket"), (q if on is None else F.when(on, q)).alias("query"))
    phrases = F.transform(F.split("keywords", ","), lambda k: F.struct(F.lit("keywords").alias("bucket"), k.alias("query")))

    def said(rows: DataFrame, *single, more=None, made=()):
        """(url, bucket, query, _one) of queries as they come and those made from two content words or more, which are clean. A query is cleaned in the list,
        once; outside of it Spark would clean it for each condition. _one is the content word of a query that has no other."""
        none = F.array().cast("array<struct<bucket:string,query:string>>")
        raw = F.concat(F.array(*single) if single else none, none if more is None else F.coalesce(more, none))
        clean = F.filter(F.transform(raw, lambda x: F.struct(x["bucket"].alias("bucket"), clean_query(x["query"]).alias("query"))), lambda x: F.length(x["query"]) > 2)
        told = F.transform(clean, lambda x: F.struct(x["bucket"].alias("bucket"), x["query"].alias("query"), F.slice(F.filter(F.split(x["query"], " "), telling), 1, 2).alias("own")))
        every = F.filter(told, lambda x: F.size(x["own"]) > 0)
        if made:
            no_own = F.array().cast("array<string>")
            every = F.concat(every, F.transform(F.filter(F.array(*made), lambda x: x["query"].isNotNull()), lambda x: F.struct(x["bucket"].alias("bucket"), x["query"].alias("query"), no_own.alias("own"))))
        return _each(rows, "url", every, "x").select("url", "x.bucket", "x.query", F.when(F.size("x.own") == 1, F.col("x.own")[0]).alias("_one"))

    subsets = lambda bucket, terms, at, size, n: [one(bucket, _subset(terms, size(i), seed + at + i), F.size(terms) > 2) for i in range(n)]
    filled = []
    for i, t in enumerate(TEMPLATES):
        before, _, after = t.partition("%s")
        filled.append(one("template", F.concat(F.lit(before), _subset(title, 2 + i % 2, seed + 40 + i), F.lit(after)), F.size(title) >= 2))
    last = F.element_at(F.split(F.regexp_replace("url", "/$", ""), "/"), -1)
    rare = salient(sections, df)
    out = said(pages, one("title", F.col("title")), more=phrases, made=[*subsets("title-subset", title, 0, lambda i: 2 + i % 3, 8), *subsets("summary", blurb, 20, lambda i: 2 + i % 2, 4), *filled])
    for part in (
        said(headed, one("heading", F.col("heading")), made=subsets("heading-subset", head, 30, lambda i: 2 + i % 2, 3)),
        said(answers, one("question", F.col("title")), made=[one("question-keywords", F.array_join(F.slice(title, 1, 4), " "), F.size(title) > 2)]),
        said(symbols, one("symbol", F.col("title")), one("member", F.element_at(F.split(last, r"\."), -1), last.contains(".")), one("path", F.regexp_replace(last, r"\.", " "), last.contains(".")), more=phrases),
        said(rare, made=[one("body-salient", F.array_join(F.slice("terms", start + 1, size), " "), F.size("terms") >= start + size) for start, size in ((0, 2), (0, 3), (1, 2), (2, 2), (0, 4), (1, 3))]),
    ):
        out = out.unionByName(part)
    return without_common(out, too_common(df, sections))


def without_common(queries: DataFrame, common: DataFrame) -> DataFrame:
    """Queries (query, _one) but those whose only content word _one is among the common ones. These are broadcast: each is in a twentieth of the sections,
    so there are at most twenty times as many as a section has words on average."""
    return queries.join(F.broadcast(common.select(F.col("term").alias("_one"))), "_one", "left_anti").drop("_one")


def merge(queries: DataFrame, max_claims: int = 4) -> DataFrame:
    """(query, urls, bucket): one row a query with all urls; queries that more than max_claims pages claim are left out."""
    # Grouped by the hash first, which tells keys apart when they are sorted: queries begin alike.
    g = queries.groupBy(F.xxhash64("query").alias("h"), "query").agg(F.array_sort(F.collect_set("url")).alias("urls"), F.array_join(F.array_sort(F.collect_set("bucket")), "+").alias("bucket")).drop("h")
    return g.where((F.size("urls") <= max_claims) | (F.size(F.array_distinct(F.transform("urls", lambda u: F.split(u, "#")[0]))) <= max_claims))


def round_robin(queries: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """n queries, one of each bucket in turn, in the order of a keyed hash. No bucket gives more than n, so a task hands on its first n of each."""
    w = W.partitionBy("bucket").orderBy(F.xxhash64("query", F.lit(seed)), "query")
    return queries.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", "bucket", "query").limit(n)


def typos(queries: DataFrame, share: float = 0.05, seed: int = 5) -> DataFrame:
    """Misspelt variants of a share of the queries, chosen by a keyed hash."""
    pick = F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return queries.where(pick).withColumn("typo", typo("query", seed)).where("typo IS NOT NULL")
