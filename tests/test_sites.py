"""Traffic, redirects, graph, catalogue and sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone import storage
from siltstone.operators import catalogue as c
from siltstone.operators import graph as g
from siltstone.operators import labels as lb
from siltstone.operators import redirects as rd
from siltstone.operators import traffic as t
from siltstone.plans import base
from siltstone.sources import readers as src
from siltstone.streaming import traffic as st

SF = "/root/testdata/sf0.001"


def test_batch_equals_stream(spark, tmp_path):
    """The request log is synthetic: fixed arithmetic on events."""
    logs = base.requests(spark, SF)
    logs.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = st.visit_stream(st.request_stream(spark, str(tmp_path / "log")), "salt")
    st.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = t.visits(logs, "salt")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(*got.columns).collect()))


def test_stream_windows_close(spark, tmp_path):
    logs = base.requests(spark, SF)
    logs.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = st.visit_stream(st.request_stream(spark, str(tmp_path / "log")), "salt")
    st.write(st.window_counts(stream, "kind"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["window_start"], r["kind"]): r["n_events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["kind"]): r["n_events"] for r in t.tumbling(t.visits(logs, "salt"), "kind").collect()}
    assert got and got.items() <= want.items() and len(want) - len(got) < 40


def test_no_salt_drops_browsers_and_nothing_leaks(spark):
    logs = base.requests(spark, SF)
    assert t.visits(logs, None).where("kind = 'user'").count() == 0
    events = t.visits(logs, "pepper-salt")
    assert events.where("kind = 'user'").count() > 0
    assert t.leaks(events, logs.where("user_agent <> ''"), "pepper-salt").count() == 0
    assert not {"ip", "user_agent"} & set(events.columns)


def test_agents(spark):
    rows = [
        ("Mozilla/5.0 (compatible; MSIE 9.0)", "/", "document", "browser", "user", "html"), ("GPTBot/1.0", "/x", "", "GPTBot", "ai.training", "html"), ("curl/8", "/llms.txt", "", "http-client", "assistant.other", "llms.txt"),
        ("curl/8", "/", "", "http-client", "unknown", "html"), ("Mozilla/5.0 Foo-bot/1", "/", "document", "unnamed-bot", "unknown", "html"), ("", "/a/index.md", "", "no-user-agent", "assistant.other", "markdown-mirror"), ("SomeTool", "/x.css", "style", None, None, None),
    ]
    d = spark.createDataFrame([(i, a, p, s, "") for i, (a, p, s, *_) in enumerate(rows)], "i int, user_agent string, path string, sec_fetch_dest string, accept string")
    got = {r["i"]: (r["crawler"], r["kind"], r["surface"]) for r in t.with_agent(d).collect()}
    assert got == {i: tuple(r[3:]) for i, r in enumerate(rows)}


def test_referrers(spark):
    cases = {"": ("none", "none"), "not a url": ("invalid", "other"), "https://chatgpt.com/": ("chatgpt.com", "chatgpt"), "https://evilchatgpt.com/": ("evilchatgpt.com", "other"), "https://www.docs.example.org/a": ("docs.example.org", "internal"), "https://m.perplexity.ai/x": ("m.perplexity.ai", "perplexity"), "https://mail.google.com/": ("mail.google.com", "other")}
    d = spark.createDataFrame([(r,) for r in cases], "referrer string")
    assert {r["referrer"]: (r["referrer_host"], r["ai_source"]) for r in t.with_referrer(d, ("example.org",)).collect()} == cases


@pytest.fixture
def plan(spark):
    return spark.createDataFrame([("core", "3.4.2", ["2.0.26", "1.15.0"]), ("cache", "5.0.0", [])], "package string, latest string, archives array<string>"), spark.createDataFrame([("old", "cache")], "old string, package string")


def test_versioned(spark, plan):
    cases = {
        "/api/core/": "/api/core/latest/", "/api/core/3.1.0/x/": "/api/core/latest/x/", "/api/core/1.3.0/x/": "/api/core/1.15.0/x/", "/api/core/0.1.0/x/": "/api/core/latest/", "/api/core/latest/x/": None, "/api/core/2.0.26/x/": None,
        "/api/core/2.0.26/core/": "/api/core/2.0.26/", "/api/nope/1.0.0/": None, "/api/": None, "/api/old/1.0.0/old.page/": "/api/cache/latest/cache.page/", "/api/old/": "/api/cache/latest/", "/api/core/symbol/": None, "/api/core/3.0.0": "/api/core/latest/",
    }
    d = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r["path"]: r["target"] for r in rd.versioned(d, *plan).collect()} == cases
    pages = spark.createDataFrame([(p,) for p in cases.values() if p], "path string")
    assert rd.audit(d, pages, *plan).count() == 0
    assert {r["problem"] for r in rd.audit(d, pages.limit(0), *plan).collect()} == {"missing"}


def test_rules_in_order(spark):
    lines = "# comment\n\n/a/*  /b/:splat  302\n/a/x /never\n/c /d\nbroken\n"
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(lines.split("\n"))], "rule_idx int, line string")
    rules = src.parse_rules(raw)
    d = spark.createDataFrame([("/a/x",), ("/a/",), ("/c",), ("/c/",), ("/ab",)], "path string")
    got = {r["path"]: (r["location"], r["status"]) for r in rd.apply_rules(d, rules).collect()}
    assert got == {"/a/x": ("/b/x", 302), "/a/": ("/b/", 302), "/c": ("/d", 301), "/c/": (None, None), "/ab": (None, None)}


def test_crawl_and_audits(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (9, 1)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in g.reachable(edges, spark.createDataFrame([(1,)], "node long"), stop=F.col("node") == 4).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 2}
    pages = spark.createDataFrame([("https://a.example/x/", '<a href="/y/#t">1</a><a href="mailto:a@b.c">2</a><img src="https://c.example/i.png"><p id="t"><a name="n">')], "url string, html string")
    e = {(r["raw"], r["kind"], r["frag"]) for r in g.edges(pages).collect()}
    assert e == {("/y/#t", "internal", "t"), ("mailto:a@b.c", "ignored", ""), ("https://c.example/i.png", "external", "")}
    assert {r["id"] for r in g.anchor_table(pages).collect()} == {"t", "n"}
    sm = spark.createDataFrame([("https://a.example/x/",), ("https://a.example/x/",), ("https://b.example/",), ("https://a.example/q",)], "loc string")
    pg = spark.createDataFrame([("https://a.example/x/", False), ("https://a.example/z/", False), ("https://a.example/h/", True)], "url string, noindex boolean")
    assert {(r["loc"][-10:], r["problem"]) for r in g.sitemap_audit(sm, pg, "https://a.example").collect()} == {("example/x/", "duplicate"), ("b.example/", "foreign origin"), (".example/q", "shape"), (".example/q", "missing"), ("example/z/", "unlisted")}


def test_structured_data(spark):
    good = json.dumps({"@graph": [{"@id": "#a", "@type": "Person", "name": "n"}, {"@id": "#b", "@type": "Article", "author": {"@id": "#a"}, "about": {"@id": "#zz"}}]})
    d = spark.createDataFrame([("/1/", good), ("/2/", "{bad"), ("/3/", json.dumps({"@id": "#a", "@type": "Person", "name": "other"})), ("/4/", json.dumps({"@id": "#p", "@type": "Person"}))], "url string, block string")
    got = {(r["url"], r["id"], r["problem"]) for r in g.json_audit(g.json_nodes(d)).collect()}
    assert got == {("/1/", "#zz", "dangling"), ("/2/", None, "unparseable"), ("/1/", "#a", "contradicting"), ("/4/", "#p", "anonymous person")}


def test_catalogue(spark):
    r = spark.createDataFrame([("p", v, f"2024-0{i + 1}-01") for i, v in enumerate(("1.2.0", "1.10.0", "2.0.0", "2.0.10", "2.0.9"))], "package string, version string, published string")
    x = c.release_facts(r).first()
    assert (x["latest"], x["n_releases"], x["majors"]) == ("2.0.10", 5, [1, 2])
    assert [(p["latest"], p["archives"]) for p in c.version_plan(r).collect()] == [("2.0.10", ["1.10.0"])]
    items = spark.createDataFrame([("/a", "2024-01-01", ["x", "y"]), ("/b", "2024-01-02", ["x"]), ("/c", "2024-01-03", ["z"]), ("/d", "2024-01-04", ["x", "y"])], "url string, date string, topics array<string>")
    got = [(r["other"], r["overlap"]) for r in c.related(items, 3).where("url = '/a'").orderBy("position").collect()]
    assert got == [("/d", 2), ("/b", 1), ("/c", 0)]
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (4, "D")], "k int, v string")
    live = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert sorted(tuple(x) for x in c.upsert(old, new, live, "k").collect()) == [(1, "a"), (2, "B"), (4, "D")]


def test_generated_queries(spark):
    pages = spark.createDataFrame([("/a/", "Delayed job queue retries", "waiting longer between several attempts", "queue,retry")], "url string, title string, summary string, keywords string")
    sec = spark.createDataFrame([("/a/", "Backoff settings explained well", "exponential jitter")], "url string, heading string, body string")
    ans = spark.createDataFrame([("/a/#q", "How do retries work today?")], "url string, title string")
    sym = spark.createDataFrame([("/api/x/queue.push/", "Queue.push", "")], "url string, title string, keywords string")
    q = lb.generate(pages, sec, ans, sym, lb.section_df(sec))
    buckets = {r["bucket"] for r in q.select("bucket").distinct().collect()}
    assert {"keywords", "title", "title-subset", "summary", "heading", "heading-subset", "question", "question-keywords", "symbol", "member", "path", "template"} <= buckets
    m = lb.merge(q.unionByName(q))
    assert m.count() == m.select("query").distinct().count()
    claimed = spark.createDataFrame([("same", f"/{i}/", "b") for i in range(5)] + [("few", "/1/#a", "b"), ("few", "/1/#b", "c")], "query string, url string, bucket string")
    assert [(r["query"], r["bucket"]) for r in lb.merge(claimed).collect()] == [("few", "b+c")]
    rr = lb.round_robin(spark.createDataFrame([(f"a{i}", "a") for i in range(9)] + [("b0", "b")], "query string, bucket string"), 4)
    assert [r["bucket"] for r in rr.collect()] == ["a", "b", "a", "a"]


def test_common_terms_go_to_the_queries(spark):
    """Nearly all queries have several words, so a shuffle by the only one puts them into one task."""
    pages = spark.createDataFrame([("/a/", "Delayed job queue retries", "", "queue,retry")], "url string, title string, summary string, keywords string")
    sec = spark.createDataFrame([(f"/{i}/", "queue", f"word{i} Queue’s") for i in range(20)], "url string, heading string, body string")
    sym = spark.createDataFrame([("/api/x/queue.push/", "Queue.push", "")], "url string, title string, keywords string")
    q = lb.generate(pages, sec, pages.select("url", "title"), sym, lb.section_df(sec))
    anti = [line for line in q._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in line]
    assert anti and all("BroadcastHashJoin" in line for line in anti)
    got = {(r["bucket"], r["query"]) for r in q.collect()}
    assert ("keywords", "retry") in got and ("symbol", "queue.push") in got and not {x for x in got if x[1] == "queue"}
    kept = lb.worded(sec)
    assert sorted(map(str, lb.section_df(kept).collect())) == sorted(map(str, lb.section_df(sec).collect()))
    assert sorted(map(str, lb.salient(kept, lb.section_df(sec), 1).collect())) == sorted(map(str, lb.salient(sec, lb.section_df(sec), 1).collect()))


def test_uneven_partitions_are_dealt_anew(spark):
    one = spark.range(1000).coalesce(1)
    assert storage.spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in storage.spread(one).collect()) == list(range(1000))
    even = spark.range(0, 1000, 1, 5)
    assert storage.spread(even) is even and storage.spread(spark.range(0)).count() == 0


def test_a_round_robin_takes_the_first_of_each_bucket_where_they_are(spark):
    rows = spark.range(3000).selectExpr("concat('q', id) AS query", "concat('b', id % 3) AS bucket").repartition(4)
    got = lb.round_robin(rows, 7)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["turn"], r["bucket"]) for r in got.collect()] == [(1, "b0"), (1, "b1"), (1, "b2"), (2, "b0"), (2, "b1"), (2, "b2"), (3, "b0")]


def test_sources(spark, tmp_path):
    (tmp_path / "site/x").mkdir(parents=True)
    (tmp_path / "site/x/index.md").write_text("# A\n")
    (tmp_path / "site/x/index.html").write_text("<p>hi</p>")
    (tmp_path / "site/x/other.md").write_text("no")
    root = f"{tmp_path}/site"
    assert [r["value"] for r in src.markdown_tree(spark, root).collect()] == ["# A\n"]
    assert [tuple(r) for r in src.html_tree(spark, root).collect()] == [("/x/", "<p>hi</p>")]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a/1/</loc><lastmod>2024-01-01</lastmod></url><url><loc> https://a/2/ </loc></url></urlset>")
    assert [(r["loc"], r["lastmod"], r["is_index"]) for r in src.sitemap(spark, f"{tmp_path}/s.xml").collect()] == [("https://a/1/", "2024-01-01", False), ("https://a/2/", None, False)]
    (tmp_path / "f.json").write_text(json.dumps({"pages": [["/a/", "A"]], "sections": [[0, "s", "Head", "text", "em"]]}))
    assert [tuple(r) for r in src.positional_sections(spark, f"{tmp_path}/f.json").select("url", "title", "anchor", "heading", "text", "emphasis").collect()] == [("/a/", "A", "s", "Head", "text", "em")]
    assert src.optional(spark, f"{tmp_path}/nope", "a int").count() == 0
    (tmp_path / "r.txt").write_text("# c\n/a /b\n/c/* /d/:splat 302\n")
    assert [tuple(r)[1:] for r in src.redirect_rules(spark, f"{tmp_path}/r.txt").collect()] == [("/a", "/b", 301), ("/c/*", "/d/:splat", 302)]
    lab = spark.createDataFrame([("b", "s"), ("a", "t"), ("a", "s")], "query string, src string")
    src.write_labels(lab, f"{tmp_path}/lab")
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/lab").collect()) == [("a", "s"), ("a", "t"), ("b", "s")]
    src.write_run(lab, f"{tmp_path}/runs", "r1", {"commit": "x"})
    assert src.read_run(spark, f"{tmp_path}/runs", "r1").first()["provenance"] == {"commit": "x"}
    recs = spark.createDataFrame([(0, "t" * 50)], "grp int, title string")
    with pytest.raises(ValueError):
        src.write_index(recs, f"{tmp_path}/idx", 10)
    assert src.write_index(recs, f"{tmp_path}/idx", 1000).count() == 1
    front = spark.createDataFrame([("/a/", "s", "d", "k", False), ("/b/", None, "d", "k", True), ("/c/", None, "d", "k", None)], "url string, summary string, description string, keywords string, generated boolean")
    assert sorted((r["url"], r["description"]) for r in src.curated(front).collect()) == [("/a/", "s"), ("/c/", "d")]


def test_release_records(spark, tmp_path):
    docs = [
        {"name": "a", "time": {"created": "2020-01-01T00:00:00Z", "1.0.0": "2020-01-02T00:00:00.000Z"}, "versions": {"1.0.0": {"license": "MIT"}, "1.1.0": {"deprecated": "old"}, "2.0.0-rc.1": {}}},
        {"name": "a", "time": {}, "versions": {"1.0.1": {"license": "X", "other": [1]}}}, {"name": "b", "time": {}, "versions": {}}, {"versions": {"1.0.0": {}}}, {"name": "c"},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)) + "\n{bad\n")
    got = {(r["package"], r["version"], r["license"], r["deprecated"]): r["published"] for r in src.release_records(spark, f"{tmp_path}/r.json").collect()}
    assert set(got) == {("a", "1.0.0", "MIT", False), ("a", "1.1.0", None, True), ("a", "1.0.1", "X", False)}
    assert got[("a", "1.0.0", "MIT", False)] is not None and got[("a", "1.1.0", None, True)] is None


def test_commit_records_and_renames(spark, tmp_path):
    log = """commit 2024-01-01T12:00:00+00:00

A\t/a/ commit x
A\t/p

commit 2024-02-01T12:00:00Z

R100\t/p\t/q
M\t/a/ commit x
odd line
commit never
A\t/z
commit 2024-03-01T12:00:00+02:00
R090\t/q\t/r
R100\t/s\t/t
R100\t/t\t/s
D\t/gone"""
    (tmp_path / "log").write_text(log)
    rows = src.commit_records(spark, f"{tmp_path}/log")
    assert sorted((r["path"], r["change"], r["source"]) for r in rows.collect()) == sorted([
        ("/a/ commit x", "A", None), ("/p", "A", None), ("/q", "R", "/p"), ("/a/ commit x", "M", None), ("/r", "R", "/q"), ("/t", "R", "/s"), ("/s", "R", "/t"), ("/gone", "D", None),
    ])
    day = lambda x: x and x.strftime("%m")
    got = {r["path"]: (day(r["published"]), day(r["modified"])) for r in c.page_dates(c.renamed(rows)).collect()}
    assert got == {"/a/ commit x": ("01", "02"), "/r": ("01", "03"), "/s": (None, "03"), "/t": (None, "03"), "/gone": (None, "03")}


def test_trees_and_maps_are_written(spark, tmp_path):
    files = spark.createDataFrame([("a/index.md", "x\n\u00e9"), ("/b/c/index.md", None), (None, "y"), ("a/other.md", "z")], "path string, value string")
    assert src.write_tree(files, f"file://{tmp_path}/t") == 3 and src.write_tree(files.where("path = 'none'"), f"file://{tmp_path}/t") == 0
    assert sorted((p.relative_to(tmp_path).as_posix(), p.read_text()) for p in (tmp_path / "t").rglob("*.md")) == [("t/a/index.md", "x\n\u00e9"), ("t/a/other.md", "z"), ("t/b/c/index.md", "")]
    e = spark.range(100).selectExpr("if(id < 90, 'hot', null) AS bucket", "concat('https://a/?x=<', id, '>&y') AS loc", "if(id = 3, date'2024-01-02', null) AS lastmod")
    e = e.unionByName(e).unionByName(spark.createDataFrame([("hot", None, None)], "bucket string, loc string, lastmod date"))
    n = src.write_sitemaps(e, f"file://{tmp_path}/m", "https://a", per_file=40)
    got = src.sitemap_tree(spark, f"{tmp_path}/m/sitemap.xml", f"{tmp_path}/m").collect()
    assert sorted(r["loc"] for r in got) == sorted(f"https://a/?x=<{i}>&y" for i in range(100)) and n == len({r["bucket"] for r in got}) >= 3
    assert [r["lastmod"] for r in got if "<3>" in r["loc"]] == ["2024-01-02"]


def test_feeds_of_several_files(spark, tmp_path):
    rows = [(f"/p{i}/", f"t{i}", f"a{j}", None if j else "h", "x" * i, "e") for i in range(30) for j in range(i % 3)]
    s = spark.createDataFrame([*rows, (None, "t", "a", "h", "x", "e")], "url string, title string, anchor string, heading string, text string, emphasis string")
    assert src.write_positional(s, f"file://{tmp_path}/f", per_file=5) > 1
    assert sorted(map(repr, (tuple(r) for r in src.positional_sections(spark, f"{tmp_path}/f").select(*s.columns).collect()))) == sorted(map(repr, rows))
    (tmp_path / "odd.json").write_text(json.dumps({"pages": [["/a/", "A"]], "sections": [[5, "s"], ["x", "s"], [0, "s"]]}))
    assert [(r["url"], r["anchor"], r["heading"]) for r in src.positional_sections(spark, f"{tmp_path}/odd.json").collect()] == [("/a/", "s", None)]


def test_rules_of_several_files_keep_their_order(spark, tmp_path):
    for name, text in (("a.txt", "# c\n/1 /x\n\n/2 /y 302"), ("b.txt", ""), ("c.txt", "/3 /z\n/bad\n/4 /w gone\n")):
        (tmp_path / name).write_text(text)
    got = sorted(tuple(r) for r in src.redirect_rules(spark, str(tmp_path)).collect())
    assert [r[1:] for r in got] == [("/1", "/x", 301), ("/2", "/y", 302), ("/3", "/z", 301), ("/4", "/w", 301)]


def test_sitemap_index_is_followed(spark, tmp_path):
    page = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    (tmp_path / "blog.xml").write_text(page("https://a/1/", "https://a/2/"))
    (tmp_path / "docs.xml").write_text(page("https://a/3/"))
    (tmp_path / "none.xml").write_text(page())
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    (tmp_path / "s.xml").write_text(index("https://a/blog.xml", "https://a/docs.xml"))
    got = sorted((r["bucket"], r["loc"]) for r in src.sitemap_tree(spark, f"{tmp_path}/s.xml", str(tmp_path)).collect())
    assert got == [("blog.xml", "https://a/1/"), ("blog.xml", "https://a/2/"), ("docs.xml", "https://a/3/")]
    assert [r["bucket"] for r in src.sitemap_tree(spark, f"{tmp_path}/docs.xml", str(tmp_path)).collect()] == ["docs.xml"]
    for names in (("https://a/blog.xml", "https://b/docs.xml"), ("https://a/none.xml",)):
        (tmp_path / "bad.xml").write_text(index(*names))
        with pytest.raises(ValueError):
            src.sitemap_tree(spark, f"{tmp_path}/bad.xml", str(tmp_path))


def test_index_budget_is_of_compressed_text(spark, tmp_path):
    recs = spark.createDataFrame([(i % 2, f"title {i} " + "x" * 200) for i in range(40)], "grp int, title string")
    r = {x["grp"]: x for x in src.index_sizes(recs).collect()}
    assert set(r) == {"0", "1"} and all(x["n_bytes"] > 20 * 200 > 5 * x["gz_bytes"] for x in r.values())
    assert src.write_index(recs, f"{tmp_path}/idx", 1000).count() == 2


def test_related_items_against_all_pairs(spark):
    import datetime
    import random

    rng = random.Random(4)
    rows = [(f"/{i}/", datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(9)), rng.choice([["hot"], ["hot", "b"], ["b", "c", "hot"], ["d"], [], None, ["d", "d", "c"]])) for i in range(80)]
    items = spark.createDataFrame(rows, "url string, date date, topics array<string>")
    for n, fill in ((3, True), (4, False), (7, True)):
        want = set()
        for u, _, t in rows:
            shared = [(len(set(t or ()) & set(t2 or ())), d2, u2) for u2, d2, t2 in rows if u2 != u]
            order = sorted((x for x in shared if fill or x[0]), key=lambda x: (-x[0], -x[1].toordinal(), x[2]))[:n]
            want |= {(u, u2, o, i) for i, (o, _, u2) in enumerate(order, 1)}
        assert {tuple(r) for r in c.related(items, n, fill).collect()} == want
    guided = spark.createDataFrame([("/g/", ["d", "hot"]), ("/h/", ["c"]), ("/none/", ["zz"])], "url string, topics array<string>")
    want = set()
    for u, t in (("/g/", ["d", "hot"]), ("/h/", ["c"])):
        hit = [(min(t.index(x) for x in t2 if x in t), -d2.toordinal(), u2) for u2, d2, t2 in rows if t2 and set(t2) & set(t)]
        want |= {(u, x[2], i) for i, x in enumerate(sorted(hit)[:6], 1)}
    assert {tuple(r) for r in c.guides(guided, items.where("topics IS NOT NULL")).collect()} == want


def test_ranges_on_mirror_lines(spark):
    lines = ["# T", "## one", "```", "x", "```", "### two", "~~~", "y"]
    mirror = spark.createDataFrame([("/a/", i, x) for i, x in enumerate(lines)], "url string, no int, line string")
    secs = [("/a/", "one", 1, 5), ("/a/", "two", 5, 8), ("/a/", "off", 3, 5), ("/b/", "x", 1, 2)]
    s = spark.createDataFrame(secs, "url string, anchor string, start int, end int")
    pages = spark.createDataFrame([("/a/",), ("/b/",)], "url string")
    ids = spark.createDataFrame([(u, a) for u, a, *_ in secs], "url string, id string")
    recs = spark.createDataFrame([("/a/", "t"), ("/b/", "t")], "url string, title string")
    got = {(r["url"], r["problem"]) for r in g.index_audit(recs, s, pages, ids, mirror).collect()}
    assert got == {("/a/", "no heading"), ("/a/", "unbalanced fence"), ("/b/", "no mirror")}
