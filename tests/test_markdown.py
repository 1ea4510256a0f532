"""Corpus-build operators on small markdown pages."""

from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import markdown as md

PAGE = """junk before
# The Title
Source: https://docs.example.org/guide/start/
Published: 2024-01-01

Intro text with `code` and **bold words**.

## First part
Some text.

```
## not a heading
```

### Is it fast?
Yes, very. It is.

Second paragraph.
## First part
again

---
after the break
"""


def test_headers_and_sections(spark):
    pages = spark.createDataFrame([("a/index.md", PAGE), ("b/index.md", "# No source\ntext"), ("c/index.md", "no title")], "path string, value string")
    h = md.parse_headers(pages).collect()
    assert [(r["path"], r["title"], r["url"], r["body_line"]) for r in h] == [("a/index.md", "The Title", "/guide/start/", 5)]
    s = md.split_sections(md.parse_headers(pages), "url").orderBy("section").collect()
    assert [(r["heading"], r["level"], r["anchor"]) for r in s] == [("", 0, ""), ("First part", 2, "first-part"), ("Is it fast?", 3, "is-it-fast"), ("First part", 2, "first-part-1"), ("", 0, "")]
    assert s[0]["emphasis"] == "bold words" and s[0]["text"] == "Intro text with code and bold words ."
    assert "not a heading" in s[1]["text"] and s[4]["text"] == "after the break"
    lines = h[0]["body"].split("\n")
    assert lines[s[2]["start"]].startswith("### Is it fast?") and s[2]["end"] == s[3]["start"]


def test_answers_terms_and_records(spark):
    pages = md.parse_headers(spark.createDataFrame([("a/index.md", PAGE)], "path string, value string"))
    sections = md.split_sections(pages, "url")
    a = md.answers(sections.join(pages.select("url", "title"), "url")).collect()
    assert [(r["title"], r["url"], r["kind"]) for r in a] == [("Is it fast?", "/guide/start/#is-it-fast", "The Title")]
    t = md.defined_terms(sections).collect()
    assert [(r["section_title"], r["term"], r["definition"]) for r in t] == [("First part", "Is it fast?", "Yes, very. It is.")]
    curated = spark.createDataFrame([("/guide/start/", None, "better", "fast,start")], "url string, summary string, description string, keywords string")
    r = md.records(md.eligible(pages), sections, curated).orderBy("grp").collect()
    assert [(x["grp"], x["summary"], x["kind"]) for x in r] == [(0, "better", "Docs"), (2, "Yes, very. It is. Second paragraph.", "The Title")]


def test_faq_pairs(spark):
    body = "## Other\n### Not here?\nno\n## FAQ\n### What is it?\n\nA thing\nof two lines.\n\nmore\n### No question\ntext\n### Empty?\n## End\n### Late?\nx"
    d = spark.createDataFrame([(1, body)], "id int, body string")
    assert [(r["question"], r["answer"]) for r in md.faq_pairs(d, "id", "body").collect()] == [("What is it?", "A thing of two lines.")]
    assert {r["question"] for r in md.faq_pairs(d, "id", "body", whole=True).collect()} == {"Not here?", "What is it?", "Late?"}


def test_agent_markdown(spark):
    html = '# Title\n\nText {#id}\n<script>x</script><svg><title>A b</title><desc>c</desc></svg><figure><video src="v.mp4"></video><figcaption>Cap <b>x</b></figcaption></figure>\n<table><tr><th>h|1</th><th>h2</th></tr><tr><td>a</td><td>b</td></tr></table>\n[l](/x/) <!-- gone -->'
    d = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    got = {r["id"]: r["agent_md"] for r in md.agent_markdown(d, "html", "https://o.example").collect()}
    assert got[2] == ""
    assert "Text\n\n*Diagram: A b — c*" in got[1] and "*Video: Cap x* — [watch](v.mp4)" in got[1]
    assert "| h\\|1 | h2 |\n| --- | --- |\n| a | b |" in got[1] and got[1].endswith("[l](https://o.example/x/)")


def test_link_rewrite(spark):
    d = spark.createDataFrame([("a", "see [x](b#frag) and [y](zz) end"), ("b", "none")], "name string, body string")
    t = spark.createDataFrame([("b", "/b/")], "name string, url string")
    got = {r["name"]: r["body"] for r in md.rewrite_links(d, t).collect()}
    assert got == {"a": "see [x](/b/#frag) and [y](zz) end", "b": "none"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, tx.clamp_sentences(lit("One two. " + "Long word " * 30))) == "One two."
    assert one(spark, tx.clamp_sentences(lit("word " * 60))).endswith("…")
    assert one(spark, tx.clip_words(lit("a" * 300), 200)) == "a" * 199 + "…"
    assert one(spark, tx.prose_paragraph(lit("# H\n\n| t |\n\n<div>\n\nReal **prose** here.\n\nx"))) == "Real prose here."
    assert one(spark, tx.prose_paragraph(lit("---\ntitle: x\n---\n\n[Home](/) / [Docs](/d/)\n\n**Signature** `f(x)`\n\n- item\n\n```\ncode\n```\n\n[Link](/l/) with words"))) == "Link with words"
    assert one(spark, tx.emphasis(lit("a **b** _c_ and *d*\n> quoted\n* item **e** snake_case_name __f__ *open"))) == "b c d e f quoted"
    assert one(spark, tx.heading_text(lit("Use `f`s {#use .x} <br> **now** [there](/x/)"))) == "Use fs now there"
    assert one(spark, tx.url_host(lit("https://WWW.Example.org/x"))) == "example.org"
    assert one(spark, tx.resolve_link(lit("https://a.example/d/e?x#y"), lit("f/g"))) == "https://a.example/d/f/g"
    assert one(spark, tx.title_parts(lit("Cache.get() method"))[0]) == "Cache.get" and one(spark, tx.title_parts(lit("Cache.get() method"))[1]) == "method"
    assert one(spark, tx.version_key(lit("1.20.3"))) == [1, 20, 3]
    assert one(spark, tx.has_mirror(lit("/api/core/latest/x/"))) and not one(spark, tx.has_mirror(lit("/api/core/1.0.0/"))) and not one(spark, tx.has_mirror(lit("/blog/page/2/")))
    q = "stream the response"
    t = one(spark, tx.typo(lit(q)))
    assert sum(a != b for a, b in zip(q, t)) == 1 and len(q) == len(t)
    assert one(spark, tx.typo(lit("zzz"))) is None
    assert one(spark, tx.iso_utc(lit("2024-01-01T02:00:00+02:00"))) == "2024-01-01T00:00:00Z" and one(spark, tx.iso_utc(lit("nope"))) is None


def test_words_are_found_as_they_would_be_cut(spark):
    rows = ["It’s a ‘Test’ of -a.b@c/d+e  é İ\tz\n", "", "…", None, " x", "y ", "a\u00a0b", "Ωmega ﬁ K9", "''", "“q”“r”"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    cut = F.trim(tx.chain(F.lower("x"), (tx.QUOTES, ""), (tx.UNCLEAN, " ")))
    for r in df.select(tx.clean_query("x").alias("q"), cut.alias("cut"), tx.words("x").alias("w"), F.filter(F.split(cut, " "), lambda w: w != "").alias("cut_w")).collect():
        assert r["q"] == r["cut"] and r["w"] == r["cut_w"]
    lines = df.select(tx._one_line(F.col("x")).alias("a"), F.trim(tx.chain("x", (r"\s+", " "))).alias("b")).collect()
    assert [r["a"] for r in lines] == [r["b"] for r in lines]
    assert "\\s{2,}" in df.select(tx._one_line(F.col("x")))._jdf.queryExecution().analyzed().toString()


def test_typos_of_long_queries(spark):
    """One place of any query, found in time linear in its length: 180,000 letters ended the session when every version was made."""
    rows = [(q,) for q in ("stream the response", "aé", "éa", "s𝄞a𝄞e", "ba" * 90_000)]
    got = spark.createDataFrame(rows, "q string").select("q", tx.typo("q").alias("t")).collect()
    for r in got:
        if r["q"] == "aé":
            assert r["t"] is None
        else:
            assert sum(a != b for a, b in zip(r["q"], r["t"])) == 1 and len(r["q"]) == len(r["t"]) and r["q"][0] == r["t"][0]
