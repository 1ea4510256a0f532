"""Corpus build: markdown pages to sections, answers, terms and searchable records, by windows over lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import anchor_slug, emphasis, group_label, heading_text, plain_text, summary

# Header lines that are not text.
META_LINE = r"^(?:Source|Published|Updated|Author|Package|Canonical|Topics|Version|Generated|Note):\s"


def lines_of(pages: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., no, line): one row for each line, numbered from 0."""
    return pages.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))


def parse_headers(pages: DataFrame) -> DataFrame:
    """pages (path, value) -> (path, title, url, body, body_line). Pages without an H1 title or a Source line are left out.

    Windows by page find the title, the end of the header (the first line after the title that is neither blank, meta, nor the first
    Source) and so the body.
    """
    x = lines_of(pages, "value", "path")
    w = W.partitionBy("path")
    h1 = F.col("line").rlike(r"^#\s+\S")
    x = x.withColumn("title_no", F.min(F.when(h1, F.col("no"))).over(w)).where("no >= title_no")
    after = F.col("no") > F.col("title_no")
    source = after & F.col("line").rlike(r"^Source:\s+https?://[^/]+/\S*\s*$")
    head = after & ((F.trim("line") == "") | F.col("line").rlike(META_LINE))
    x = x.withColumn("body_no", F.min(F.when(after & ~head, F.col("no"))).over(w))
    in_head = after & (F.col("body_no").isNull() | (F.col("no") < F.col("body_no")))
    g = x.groupBy("path").agg(
        F.max(F.when(F.col("no") == F.col("title_no"), F.regexp_extract("line", r"^#\s+(.+?)\s*$", 1))).alias("title"),
        F.min_by(F.when(source & in_head, F.regexp_extract("line", r"^Source:\s+https?://[^/]+(/\S*)\s*$", 1)), F.when(source & in_head, F.col("no"))).alias("url"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("no") >= F.col("body_no"), F.struct("no", "line")))), lambda s: s["line"]), "\n").alias("body"),
        F.coalesce(F.max("body_no"), F.lit(0)).alias("body_line"),
    )
    return g.where("title IS NOT NULL AND url IS NOT NULL").withColumn("body", F.regexp_replace("body", r"^\s+", ""))


def split_sections(pages: DataFrame, *keys: str) -> DataFrame:
    """pages (keys..., body) -> (keys..., section, heading, level, anchor, start, end, raw, text, emphasis).

    A section begins at ## or ### outside code fences, or after a thematic break that follows a blank line. Slugs that repeat on a page get -1, -2...
    Fences: a line of ``` or ~~~ opens one, the next line of the same kind closes it; which lines lie inside is a fold over the fence lines of a page.
    """
    x = lines_of(pages, "body", *keys)
    w = W.partitionBy(*keys).orderBy("no")
    mark = F.nullif(F.substring(F.regexp_extract("line", r"^\s{0,3}(```+|~~~+)", 1), 1, 1), F.lit(""))
    x = x.withColumn("mark", mark)
    # The open fence before each line: a running fold over the marks so far, which are few on a page.
    marks = F.array_compact(F.collect_list("mark").over(w.rowsBetween(W.unboundedPreceding, -1)))
    state = F.aggregate(marks, F.lit(""), lambda s, m: F.when(s == "", m).when(s == m, "").otherwise(s))
    x = x.withColumn("open", F.coalesce(state, F.lit("")) != "")
    plain = ~F.col("open") & F.col("mark").isNull()
    is_head = plain & F.col("line").rlike(r"^#{2,3}\s+\S")
    # Blank for the break rule: the line before is blank, a break, or there is none.
    rule = F.col("line").rlike(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")
    before = F.lag("line").over(w)
    blank = before.isNull() | (F.trim(before) == "") | before.rlike(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")
    x = x.withColumns({"is_head": is_head, "is_break": plain & rule & blank})
    x = x.withColumn("section", F.coalesce(F.sum((F.col("is_head") | F.col("is_break")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    own = F.col("is_head") | F.col("is_break")
    g = x.groupBy(*keys, "section").agg(
        F.max(F.when(F.col("is_head"), F.col("line"))).alias("head"), F.min("no").alias("first"), F.max("no").alias("last"), F.max(F.col("is_break").cast("int")).alias("broken"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~own, F.struct("no", "line")))), lambda s: s["line"]), "\n").alias("raw"),
    )
    heading = F.coalesce(heading_text(F.regexp_extract("head", r"^#{2,3}\s+(.+?)\s*$", 1)), F.lit(""))
    g = g.withColumn("heading", F.when(F.col("head").isNull(), "").otherwise(heading)).withColumn("base", F.when(F.col("head").isNotNull(), anchor_slug("heading")))
    nth = F.row_number().over(W.partitionBy(*keys, "base").orderBy("section")) - 1
    start = F.when(F.col("broken") == 1, F.col("first") + 1).otherwise(F.col("first"))
    end = F.coalesce(F.lead("first").over(W.partitionBy(*keys).orderBy("section")), F.col("last") + 1)
    g = g.withColumns({"nth": nth, "start": start, "end": end})
    return g.select(
        *keys, "section", "heading", F.when(F.col("head").isNull(), 0).otherwise(F.length(F.regexp_extract("head", "^(#+)", 1))).alias("level"),
        F.when(F.col("base").isNull(), "").when(F.col("nth") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), "nth")).alias("anchor"),
        "start", "end", "raw", plain_text("raw").alias("text"), emphasis("raw").alias("emphasis"),
    )


def verified_anchors(sections: DataFrame, ids: DataFrame) -> DataFrame:
    """sections (url, anchor...) with anchors that the page (ids: url, id) does not have blanked, and unanchored telling so."""
    known = ids.select(F.col("url").alias("_u"), F.col("id").alias("_i")).distinct()
    j = sections.join(known.hint("merge"), (F.col("url") == F.col("_u")) & (F.col("anchor") == F.col("_i")), "left")
    lost = (F.col("anchor") != "") & F.col("_i").isNull()
    return j.withColumn("unanchored", lost).withColumn("anchor", F.when(lost, "").otherwise(F.col("anchor"))).drop("_u", "_i")


def answers(sections: DataFrame) -> DataFrame:
    """(title, url, summary, kind): sections of level 2 or 3 whose heading is a question and that have text."""
    s = sections.where((F.col("level").between(2, 3)) & F.col("heading").endswith("?") & (F.col("text") != ""))
    return s.select(F.col("heading").alias("title"), F.when(F.col("anchor") != "", F.concat("url", F.lit("#"), "anchor")).otherwise(F.col("url")).alias("url"), summary("text").alias("summary"), F.col("title").alias("kind"))


def faq_pairs(pages: DataFrame, key: str, body: str, whole: bool = False) -> DataFrame:
    """(key, question, answer): ### questions inside a FAQ section (or anywhere), with their first paragraph."""
    x = lines_of(pages, body, key)
    w = W.partitionBy(key).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    h2 = F.col("line").rlike(r"^##\s")
    faq = F.when(h2, F.col("line").rlike(r"(?i)^##\s+(?:FAQ|Frequently asked)") | F.lit(whole))
    x = x.withColumn("in_faq", F.coalesce(F.last(faq, ignorenulls=True).over(w), F.lit(whole))).withColumn("is_q", F.col("line").rlike(r"^###\s+\S"))
    x = x.withColumn("block", F.sum((h2 | F.col("is_q")).cast("int")).over(w)).where(F.col("in_faq") & ~h2)
    inner = W.partitionBy(key, "block").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    text = ~F.col("is_q") & (F.trim("line") != "")
    # Paragraphs are counted by blank lines after text has begun.
    x = x.withColumn("begun", F.max(text.cast("int")).over(inner))
    x = x.withColumn("closed", F.max(((F.col("begun") == 1) & (F.trim("line") == "")).cast("int")).over(inner))
    g = x.groupBy(key, "block").agg(
        F.max(F.when(F.col("is_q"), F.regexp_extract("line", r"^###\s+(.+?)\s*$", 1))).alias("q"),
        F.array_sort(F.collect_list(F.when(text & (F.col("closed") == 0), F.struct("no", F.trim("line").alias("line"))))).alias("a"),
    )
    g = g.where(F.col("q").isNotNull() & (F.size("a") > 0))
    out = g.select(key, heading_text("q").alias("question"), plain_text(F.array_join(F.transform("a", lambda s: s["line"]), " ")).alias("answer"))
    return out.where(F.col("question").endswith("?"))


def defined_terms(sections: DataFrame) -> DataFrame:
    """(url, section_title, term, definition): ### sections with text, under the ## heading before them."""
    w = W.partitionBy("url").orderBy("section").rowsBetween(W.unboundedPreceding, 0)
    s = sections.withColumn("under", F.last(F.when(F.col("level") == 2, F.col("heading")), ignorenulls=True).over(w))
    s = s.where((F.col("level") == 3) & (F.col("text") != ""))
    first = F.get(F.filter(F.transform(F.split("raw", r"\n\s*\n"), plain_text), lambda p: p != ""), F.lit(0))
    return s.select("url", F.coalesce("under", F.lit("")).alias("section_title"), F.col("heading").alias("term"), F.coalesce(first, F.lit("")).alias("definition"))


def eligible(pages: DataFrame) -> DataFrame:
    """pages (url, body...) with is_page and has_sections: authored pages have both, a package's index has sections only, other generated pages neither."""
    package = F.col("url").rlike(r"^/api/[^/]+/latest/$")
    generated = F.col("url").rlike(r"^/api/[^/]+/[^/]+/") & ~package
    return pages.where(~generated).withColumns({"is_page": ~package, "has_sections": F.lit(True)})


def records(pages: DataFrame, sections: DataFrame, curated: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The searchable records: pages (grp 0), symbols (1), answers (2) in one table.

    pages (url, title, body, is_page); curated (url, summary, description, keywords) gives better summaries where there is one.
    """
    c = curated.select("url", F.coalesce("summary", "description").alias("curated"), "keywords")
    p = pages.where("is_page").join(c.hint("merge"), "url", "left").select(
        F.lit(0).alias("grp"), "title", "url", F.coalesce("curated", summary("body")).alias("summary"), group_label("url").alias("kind"), "keywords"
    )
    a = answers(sections.hint("merge").join(pages.select("url", "title"), "url")).withColumn("grp", F.lit(2))
    out = p.unionByName(a, allowMissingColumns=True)
    return out if symbols is None else out.unionByName(symbols.withColumn("grp", F.lit(1)), allowMissingColumns=True)


def vocabulary(sections: DataFrame, *columns: str) -> DataFrame:
    """(word, df): distinct tokens and the number of rows that have each."""
    from ..functions.text import tokens

    every = F.array_distinct(F.flatten(F.array(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])))
    return sections.select(F.explode(every).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


_ELEMENT = re.compile(r"(?is)<!--.*?-->|<(script|style|svg|figure|table)\b([^>]*)>")


def _inside(html: str, tag: str) -> list[str]:
    """The contents of each tag element, white space as single spaces."""
    return [" ".join(x.split()) for x in re.findall(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", html)]


def _nothing(html: str) -> str:
    return ""


def _drawing(html: str) -> str:
    said = " — ".join(x for tag in ("title", "desc") for x in _inside(html, tag)[:1])
    return f"\n*Diagram: {said}*\n" if said else ""


def _figure(html: str) -> str:
    said = " ".join(re.sub("<[^>]+>", "", "".join(_inside(html, "figcaption")[:1])).split())
    film = re.search(r'(?i)<video\b[^>]*\bsrc="([^"]+)"', html)
    if film:
        return f"\n*Video: {said or 'recording'}* — [watch]({film[1]})\n"
    return said and f"\n*{said}*\n"


def _table(html: str) -> str | None:
    """Rows as lines between bars; a table without heading cells stays as it is (None)."""
    line = lambda cells: "| " + " | ".join(re.sub(r"(?<!\\)\|", r"\\|", c) for c in cells) + " |"
    rows = _inside(html, "tr")
    head = [c for row in rows for c in _inside(row, "th")]
    body = [cells for row in rows if (cells := _inside(row, "td"))]
    return "\n" + "\n".join([line(head), line(["---"] * len(head)), *map(line, body)]) + "\n" if head else None


_HANDLERS = {"script": _nothing, "style": _nothing, "svg": _drawing, "figure": _figure, "table": _table}


def _elements(text: str):
    """The page from element to element: markdown in between as it is, comments left out, each element as its handler puts it."""
    at = 0
    while m := _ELEMENT.search(text, at):
        yield text[at : m.start()]
        at, name = m.end(), (m[1] or "").lower()
        # A table with attributes is layout and stays, and so does an element that is never closed.
        end = re.compile(rf"(?i)</{name}>").search(text, at) if name and not (name == "table" and m[2]) else None
        if end:
            put = _HANDLERS[name](text[at : end.start()])
            yield text[m.start() : end.end()] if put is None else put
            at = end.end()
        elif name:
            yield m[0]
    yield text[at:]


def _rendered(text: str, origin: str) -> str:
    """One page as markdown for agents: elements by their handlers, then lines without trailing anchors and without the first title, links with the site in front."""
    lines = [re.sub(r"[ \t]*\{#[\w-]+\}\s*$", "", x) for x in "".join(_elements(text)).strip().splitlines()]
    if lines and re.match(r"#[ \t]+\S", lines[0]):
        del lines[0]
    kept = [x for i, x in enumerate(lines) if x or i == 0 or lines[i - 1]]
    return "\n".join(kept).strip().replace("](/", f"]({origin}/")


def agent_markdown(pages: DataFrame, column: str, origin: str) -> DataFrame:
    """pages with agent_md, by an Arrow function over whole partitions; null text gives empty text."""
    @F.pandas_udf("string")
    def render(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: _rendered(t, origin))

    return pages.withColumn("agent_md", render(column))


def rewrite_links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """pages (name, body) with links to other pages by name turned into their urls (targets: name, url); fragments stay, unknown names too.

    Links are exploded and joined; the body is put together again from the pieces between them.
    """
    link = r"\]\(([A-Za-z0-9_./-]+?)(#[A-Za-z0-9_-]+)?\)"
    x = pages.select("name", "body", F.split("body", link, -1).alias("gaps"), F.regexp_extract_all("body", F.lit(link), F.lit(1)).alias("to"), F.regexp_extract_all("body", F.lit(link), F.lit(2)).alias("frag"))
    e = x.select("name", F.posexplode("to").alias("i", "target"))
    known = targets.select(F.col("name").alias("target"), "url")
    got = e.hint("merge").join(known, "target", "left").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("url", "target").alias("url")))), lambda s: s["url"]).alias("urls"))
    out = x.join(got.hint("merge"), "name", "left")
    piece = F.transform("gaps", lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit("]("), F.get("urls", i - 1), F.coalesce(F.get("frag", i - 1), F.lit("")), F.lit(")"), g)))
    return out.select("name", F.when(F.size("to") > 0, F.array_join(piece, "")).otherwise(F.col("body")).alias("body"))


def leak_scan(pages: DataFrame, column: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(all of pages, leak): rows of each rule (name, pattern) that is found; the rules are a fixed list, so they are columns, not a join."""
    found = F.array_compact(F.array(*[F.when(F.col(column).rlike(p), F.lit(n)) for n, p in rules]))
    return pages.withColumn("leak", F.explode(found))


