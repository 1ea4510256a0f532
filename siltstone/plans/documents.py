"""Registered queries over texts: documents, benchmark items, conversations and HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import labels as lb
from ..operators import markdown as md
from ..storage import cut, spread
from .base import SYMBOLS_SQL, query, table

_R = lambda x, *steps: x if not steps else _R(f"regexp_replace({x}, '{steps[0][0]}', '{steps[0][1]}', 'g')", *steps[1:])
_CLEAN = lambda c: "trim(" + _R(f"lower({c})", (tx.QUOTES, ""), (tx.UNCLEAN, " ")) + ")"
_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")"
_CONTENT = lambda c: f"list_filter(string_split({_CLEAN(c)}, ' '), lambda w: w <> '' AND w NOT IN {_STOP} AND length(w) > 1)"
_STRIP = lambda c: _R(f"coalesce({c}, '')", (tx.UNSEEN, " "), (tx.LINK, r"\1"))
_READ = lambda c: f"array_to_string(list_transform(list_filter(string_split({_STRIP(c)}, chr(10)), lambda x: NOT regexp_matches(x, '{tx.WORDLESS}')), lambda x: regexp_replace(x, '{tx.BLOCK}', '')), ' ')"
_LINE = lambda c, *steps: "trim(" + _R(c, *steps, (r"\s+", " ")) + ")"
_PLAIN = lambda c: _LINE(_READ(c), (tx.MARKS, " "))
_HEADING = lambda c: _LINE(f"coalesce({c}, '')", (tx.ATTRIBUTES, " "), (tx.UNSEEN, " "), (tx.LINK, r"\1"), (tx.MARKS, ""))
_PARAGRAPHS = lambda c: f"regexp_split_to_array({c}, '\\n\\s*\\n')"
_CLIP = lambda c: f"CASE WHEN length({c}) <= 200 THEN {c} ELSE trim(CASE WHEN contains(substr({c}, 1, 200), ' ') THEN regexp_replace(substr({c}, 1, 200), ' [^ ]*$', '') ELSE substr({c}, 1, 199) END) || '…' END"
_SUMMARY = lambda c: f"coalesce(list_filter(list_transform({_PARAGRAPHS(c)}, lambda p: {_PLAIN('p')}), lambda p: p <> '')[1], '')"
_PIECES = lambda c: f"string_split({_R(f'regexp_replace({c}, {chr(39)}{tx.BLOCK}{chr(39)}, {chr(39)}{chr(39)})', (tx.BORDERS[0], r'\1*'), (tx.BORDERS[1], r'*\1'), (r'\*{2}', '*'))}, '*')"
_EMPHASIS = lambda c: f"list_concat(flatten(list_transform(string_split({c}, chr(10)), lambda y: list_transform(range(2, len({_PIECES('y')}), 2), lambda i: {_PIECES('y')}[i]))), list_transform(list_filter(string_split({c}, chr(10)), lambda x: regexp_matches(x, '{tx.QUOTED}')), lambda x: regexp_extract(x, '{tx.QUOTED}', 1)))"
_DEC = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_VISIBLE = "trim(" + _R(_DEC(_R("html", (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"<[^>]+>", " "))), (r"\s+", " ")) + ")"
_HASH = "count(*) AS n, sum(length({0})) AS chars"


@query("pf4_plain_text", f"SELECT doc_id, {_PLAIN('text')} AS plain FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.plain_text("text").alias("plain"))


@query("pf5_heading_text", f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_HEADING('x')}), chr(10)) AS headings FROM documents")
def _(spark, d):
    """Every line as if it were a heading."""
    lines = F.transform(F.split("text", "\n", -1), tx.heading_text)
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("headings"))


@query("pf7_summary", f"SELECT doc_id, {_CLIP('first')} AS summary FROM (SELECT doc_id, {_SUMMARY('text')} AS first FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.summary("text").alias("summary"))


_ENDS = "regexp_replace(plain, '([.!?])\\s+([A-Z\"''(])', '\\1' || chr(1) || '\\2', 'g')"


@query("pf8_clamped", f"""WITH p AS (SELECT doc_id, {_PLAIN('text')} AS plain FROM documents), s AS (SELECT doc_id, plain, string_split({_ENDS}, chr(1)) AS parts FROM p),
k AS (SELECT *, list_max(list_filter(range(1, len(parts) + 1), lambda k: length(array_to_string(parts[1:k], ' ')) <= 160)) AS k FROM s)
SELECT doc_id, CASE WHEN length(plain) <= 160 THEN plain WHEN k IS NOT NULL THEN array_to_string(parts[1:k], ' ') ELSE regexp_replace(regexp_replace(substr(plain, 1, 159), '\\s\\S*$', ''), '[,;:.]$', '') || '…' END AS description FROM k""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clamp_sentences(tx.plain_text("text")).alias("description"))


@query("pf9_prose_paragraph", f"""WITH p AS (SELECT doc_id, list_transform({_PARAGRAPHS("text")}, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS every FROM documents),
f AS (SELECT doc_id, list_filter(every, lambda p: NOT regexp_matches(p, '{tx.NO_PROSE}') AND regexp_matches(regexp_replace(p, '{tx.LABELS}', '', 'g'), '{tx.A_WORD}'))[1] AS first FROM p)
SELECT doc_id, CASE WHEN first IS NULL THEN '' ELSE {_PLAIN('first')} END AS prose FROM f""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.prose_paragraph("text").alias("prose"))


@query("pf6_emphasis", f"SELECT doc_id, {_PLAIN('spans')} AS emphasis FROM (SELECT doc_id, array_to_string({_EMPHASIS('text')}, ' ') AS spans FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.emphasis("text").alias("emphasis"))


_RULE = r"^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$"
_SLUG = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section')"
#: Sections of pages pg (url, body).
SECTIONS_SQL = rf"""ln AS (SELECT url, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS no FROM pg),
mk AS (SELECT *, nullif(substr(regexp_extract(line, '^\s{{0,3}}(```+|~~~+)', 1), 1, 1), '') AS mark FROM ln),
st AS (SELECT *, list_reduce(list_prepend('', coalesce(list_filter(list(mark) OVER (PARTITION BY url ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), []::VARCHAR[])), lambda s, m: CASE WHEN s = '' THEN m WHEN s = m THEN '' ELSE s END) <> '' AS inside,
  lag(line) OVER (PARTITION BY url ORDER BY no) AS before FROM mk),
fl AS (SELECT *, NOT inside AND mark IS NULL AND regexp_matches(line, '^#{{2,3}}\s+\S') AS is_head, NOT inside AND mark IS NULL AND regexp_matches(line, '{_RULE}') AND (before IS NULL OR trim(before) = '' OR regexp_matches(before, '{_RULE}')) AS is_break FROM st),
se AS (SELECT *, sum((is_head OR is_break)::INT) OVER (PARTITION BY url ORDER BY no ROWS UNBOUNDED PRECEDING) AS section FROM fl),
sg AS (SELECT url, section, max(line) FILTER (is_head) AS head, min(no) AS first, max(no) AS last, bool_or(is_break) AS broken, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT is_head AND NOT is_break), '') AS raw FROM se GROUP BY ALL),
sh AS (SELECT *, CASE WHEN head IS NULL THEN '' ELSE {_HEADING("regexp_extract(head, '^#{2,3}" + chr(92) + "s+(.+?)" + chr(92) + "s*$', 1)")} END AS heading FROM sg),
sb AS (SELECT *, CASE WHEN head IS NOT NULL THEN {_SLUG('heading')} END AS base FROM sh),
sections AS (SELECT url, section, heading, CASE WHEN head IS NULL THEN 0 ELSE length(regexp_extract(head, '^(#+)', 1)) END AS level,
  CASE WHEN base IS NULL THEN '' WHEN row_number() OVER b = 1 THEN base ELSE base || '-' || (row_number() OVER b - 1) END AS anchor,
  CASE WHEN broken THEN first + 1 ELSE first END AS start, coalesce(lead(first) OVER (PARTITION BY url ORDER BY section), last + 1) AS "end", raw, {_PLAIN('raw')} AS text, {_PLAIN("array_to_string(" + _EMPHASIS('raw') + ", ' ')")} AS emphasis
  FROM sb WINDOW b AS (PARTITION BY url, base ORDER BY section))"""


@query("pf2_sections", f"WITH pg AS (SELECT doc_id AS url, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 1 THEN '## ' || substr(x, 1, 20) ELSE x END), chr(10)) AS body FROM documents WHERE text IS NOT NULL), {SECTIONS_SQL} SELECT url AS doc_id, section, heading, level, anchor, start, \"end\", text, emphasis FROM sections")
def _(spark, d):
    """Documents as markdown: every fourth line becomes a heading, so that sections, slugs and repeats occur."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), F.substring(x, 1, 20))).otherwise(x))
    pages = table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))
    return md.split_sections(pages, "doc_id").drop("raw")


@query("pf3_anchor_slugs", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
h AS (SELECT doc_id, no, coalesce(nullif(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'section') AS base FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY no) AS i FROM h)
SELECT doc_id, (no - 1)::INT AS line, base || CASE WHEN i = 1 THEN '' ELSE '-' || (i - 1) END AS anchor FROM n""")
def _(spark, d):
    """Every line's slug, numbered where a document repeats it."""
    from pyspark.sql import Window as W

    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    n = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("line")) - 1
    x = x.select("doc_id", "line", tx.anchor_slug("words").alias("base"))
    return x.select("doc_id", "line", F.concat("base", F.when(n == 0, "").otherwise(F.concat(F.lit("-"), n))).alias("anchor"))


@query("pf10_group_labels", "SELECT url, CASE " + " ".join(f"WHEN regexp_matches(p, '{r}') THEN '{v}'" for r, v in tx.GROUPS) + " ELSE 'Docs' END AS label FROM (SELECT url, ['/blog/', '/tutorial/', '/cli/', '/docs/', '/support/', '/blog/topics/'][page_id % 6 + 1] || page_id AS p FROM pages)")
def _(spark, d):
    from .base import pick

    p = table(spark, d, "pages")
    path = F.concat(pick(("/blog/", "/tutorial/", "/cli/", "/docs/", "/support/", "/blog/topics/"), F.col("page_id") % 6), "page_id")
    return p.select("url", tx.group_label(path).alias("label"))


@query("pf15_visible_text", f"SELECT page_id, {_VISIBLE} AS visible FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.visible_text("html").alias("visible"))


_LINKS = r"""(?i)<(?:a|area|link|img|script|iframe|source)\b[^>]*?\s(?:href|src)="([^"]*)\""""


@query("pf16_links", f"SELECT page_id, raw, count(*) AS n FROM (SELECT page_id, {_DEC('unnest(regexp_extract_all(html, ' + chr(39) + _LINKS + chr(39) + ', 1))')} AS raw FROM pages) GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(tx.links("html")).alias("raw")).groupBy("page_id", "raw").agg(F.count("*").alias("n"))


@query("pf17_anchors", r"""SELECT page_id, id FROM (SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(h, '\sid="([^"]+)"', 1), regexp_extract_all(h, '(?i)<a\b[^>]*?\sname="([^"]+)"', 1)))) AS id FROM (SELECT page_id, replace(html, '<p>', '<p id="p' || (page_id % 9) || '">') AS h FROM pages))""")
def _(spark, d):
    """Paragraphs get ids first, as the pages have none."""
    p = table(spark, d, "pages")
    h = F.replace("html", F.lit("<p>"), F.concat(F.lit('<p id="p'), F.col("page_id") % 9, F.lit('">')))
    return p.select("page_id", F.explode(tx.anchors(h)).alias("id"))


@query("pf18_agent_markdown")
def _(spark, d):
    return md.agent_markdown(table(spark, d, "pages"), "html", "https://docs.example.org").select("page_id", "agent_md")


@query("pf19_absolute_links", r"SELECT page_id, regexp_replace(m, '\]\((/[^)\s]*)\)', '](https://docs.example.org\1)', 'g') AS md FROM (SELECT page_id, '[a](/x/' || page_id || ') and [b](other) ' || url AS m FROM pages)")
def _(spark, d):
    m = F.concat(F.lit("[a](/x/"), "page_id", F.lit(") and [b](other) "), "url")
    return table(spark, d, "pages").select("page_id", tx.absolute_links(m, "https://docs.example.org").alias("md"))


@query("pf20_link_rewrite", "WITH p AS (SELECT page_id, lead(page_id) OVER (ORDER BY page_id) AS nxt FROM pages), ids AS (SELECT page_id AS i FROM pages WHERE page_id % 2 = 0) SELECT 'page-' || page_id AS name, 'see [next](' || CASE WHEN page_id + 1 IN (SELECT i FROM ids) THEN '/p/' || (page_id + 1) || '/' ELSE 'page-' || (page_id + 1) END || '#top) and [x](' || CASE WHEN page_id * 2 IN (SELECT i FROM ids) THEN '/p/' || (page_id * 2) || '/' ELSE 'page-' || (page_id * 2) END || ')' AS body FROM p")
def _(spark, d):
    """Each page links to the next by name; even ones are known targets."""
    p = table(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("name"), F.concat(F.lit("see [next](page-"), F.col("page_id") + 1, F.lit("#top) and [x](page-"), F.col("page_id") * 2, F.lit(")")).alias("body"), "page_id")
    return md.rewrite_links(p, p.where("page_id % 2 = 0").select("name", F.concat(F.lit("/p/"), "page_id", F.lit("/")).alias("url")))


@query("pf21_tags", "SELECT url, array_to_string(list_slice(list_concat(['one', 'two'], list_filter(list_distinct(list_transform(topics, lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g'))), lambda t: t NOT IN ('one', 'two'))), 1, 4), ',') AS tags FROM (SELECT doc_id AS url, ['T-' || (doc_id % 5), 'Two', 'x ' || lang] AS topics FROM documents)".replace("list_distinct(list_transform", "(list_transform"))
def _(spark, d):
    topics = F.array(F.concat(F.lit("T-"), F.col("doc_id") % 5), F.lit("Two"), F.concat(F.lit("x "), "lang"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("url"), F.array_join(tx.normal_tags(topics, ("one", "two")), ",").alias("tags"))


@query("f1_content_words", f"SELECT item_id, array_to_string({_CONTENT('text')}, ' ') AS terms FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.content_words("text"), " ").alias("terms"))


@query("f2_squash", r"SELECT conv_id, turn, regexp_replace(lower(text), '\s+', '', 'g') AS squashed FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.squash("text").alias("squashed"))


@query("f3_url_parts", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host, coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_host("url").alias("host"), tx.url_path("url").alias("path"))


@query("f5_entities", f"SELECT page_id, length({_DEC('html')}) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(tx.decode_entities("html")).cast("long").alias("n"))


@query("f6_position_scores", "SELECT l_linenumber AS p, CASE WHEN l_linenumber BETWEEN 1 AND 10 THEN 100.0 - 10.0 * (l_linenumber - 1) ELSE 0.0 END AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("p"), tx.position_score("l_linenumber").alias("score")).agg(F.count("*").alias("n"))


@query("f8_normal_tail", "SELECT p_partkey, round(greatest(0, least(1, t * exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))), 6) AS p FROM (SELECT p_partkey, (p_size / 10.0) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * (p_size / 10.0) / sqrt(2.0)) AS t FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(tx.normal_two_sided(F.col("p_size") / 10.0), 6).alias("p"))


@query("f9_digests", "SELECT user_id, substr(sha256('10.0.0.' || user_id || chr(10) || 'agent' || chr(10) || 'salt'), 1, 32) AS digest FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", tx.visitor_digest(F.concat(F.lit("10.0.0."), "user_id"), F.lit("agent"), "salt").alias("digest"))


@query("f11_cookie_ids", "SELECT user_id, nullif(regexp_extract(c, '(?:^|;\\s*)_ga=GA\\d+\\.\\d+\\.(\\d+\\.\\d+)', 1), '') AS client FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'x=1; _ga=GA1.2.' || user_id || '.9' ELSE 'none' END AS c FROM events)")
def _(spark, d):
    c = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("x=1; _ga=GA1.2."), "user_id", F.lit(".9"))).otherwise("none")
    return table(spark, d, "events").select("user_id", tx.ga_client_id(c).alias("client")).distinct()


@query("f17_typos")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.typo(tx.clean_query("text")).alias("typo"))


@query("io8_harvested", r"SELECT DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS query FROM conversations WHERE role = 'user' AND length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) > 2")
def _(spark, d):
    return lb.harvested(table(spark, d, "conversations").where("role = 'user'"), "text")


_Q = r"hq AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS query FROM conversations)"


@query("s1_coverage", f"WITH {_Q}, a AS (SELECT DISTINCT query FROM hq WHERE turn = 0), b AS (SELECT DISTINCT query FROM hq WHERE turn > 0) SELECT query, 'missing' AS side FROM (SELECT query FROM a EXCEPT SELECT query FROM b) UNION ALL SELECT query, 'extra' FROM (SELECT query FROM b EXCEPT SELECT query FROM a)")
def _(spark, d):
    from ..operators.graph import set_diff

    q = table(spark, d, "conversations").withColumn("query", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return set_diff(q.where("turn = 0"), q.where("turn > 0"), "query")


#: Each word of a conversation's opening and of its later turns, once a conversation: the two lists that should not decide a word twice.
_LISTS = r"""hw AS (SELECT DISTINCT conv_id, coalesce(turn > 0, false) AS later, unnest(string_split_regex(lower(text), '\s+')) AS query FROM conversations)"""


def _lists(spark, d):
    w = table(spark, d, "conversations").select("conv_id", F.coalesce(F.col("turn") > 0, F.lit(False)).alias("later"), F.explode(F.split(F.lower("text"), r"\s+", -1)).alias("query")).distinct()
    return w.where("NOT later"), w.where("later")


@query("s2_decided_once", f"WITH {_LISTS} SELECT query, count(*) AS n FROM hw GROUP BY query HAVING count(*) <> 1")
def _(spark, d):
    return lb.not_decided_once(*_lists(spark, d))


@query("s3_overlap", f"WITH {_LISTS} SELECT query FROM hw WHERE NOT later INTERSECT SELECT query FROM hw WHERE later")
def _(spark, d):
    return lb.overlap(*_lists(spark, d))


_JUDGED = "SELECT 'q' || doc_id AS query, CASE WHEN toxic = 1 THEN 'wrong' WHEN quality = 0 THEN 'missing' WHEN doc_id % 50 = 7 THEN 'odd' ELSE 'good' END AS verdict FROM labels"


def _judged(spark, d):
    v = F.when(F.col("toxic") == 1, "wrong").when(F.col("quality") == 0, "missing").when(F.col("doc_id") % 50 == 7, "odd").otherwise("good")
    return table(spark, d, "labels").select(F.concat(F.lit("q"), "doc_id").alias("query"), v.alias("verdict"))


@query("lb1_assembled", f"SELECT query, verdict, CASE verdict WHEN 'good' THEN 'label' WHEN 'missing' THEN 'content gap' ELSE 'negative' END AS class FROM ({_JUDGED}) WHERE verdict <> 'odd'")
def _(spark, d):
    return lb.assemble(_judged(spark, d), spark.createDataFrame(list(lb.VERDICTS), "verdict string, class string"))[0].select("query", "verdict", "class")


@query("lb1_unknown_verdicts", f"SELECT query, verdict FROM ({_JUDGED}) WHERE verdict = 'odd'")
def _(spark, d):
    return lb.assemble(_judged(spark, d), spark.createDataFrame(list(lb.VERDICTS), "verdict string, class string"))[1].select("query", "verdict")


@query("lb2_held_out", "SELECT source AS topic, source IN ('src1', 'src4') AS held_out, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return lb.held_out(table(spark, d, "documents").withColumnRenamed("source", "topic"), ("src1", "src4")).groupBy("topic", "held_out").agg(F.count("*").alias("n"))


_SDF = f"sd AS (SELECT doc_id, split_part(text, chr(10), 1) AS heading, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents), sw AS (SELECT DISTINCT doc_id, unnest(string_split({_CLEAN(chr(98) + chr(111) + 'dy || ' + chr(39) + ' ' + chr(39) + ' || heading')}, ' ')) AS term FROM sd), sdf AS (SELECT term, count(*) AS df FROM sw WHERE term <> '' GROUP BY term)"


def _sections(spark, d):
    from .search import sections

    return sections(spark, d)


@query("gq2_common_terms", f"WITH {_SDF}, n AS (SELECT count(*) AS n FROM documents) SELECT term, df FROM sdf, n WHERE df > greatest(8, floor(n * 0.05 + 0.5))")
def _(spark, d):
    s = _sections(spark, d)
    return lb.too_common(lb.section_df(s), s)


@query("gq3_salient_terms", f"WITH {_SDF}, c AS (SELECT DISTINCT doc_id, unnest({_CONTENT('body')}) AS term FROM sd) SELECT '/doc/' || doc_id || '/' AS url, string_agg(term, ' ' ORDER BY df, term) AS terms FROM c JOIN sdf USING (term) WHERE length(term) > 3 AND df BETWEEN 2 AND 12 GROUP BY doc_id")
def _(spark, d):
    s = _sections(spark, d)
    return lb.salient(s, lb.section_df(s)).withColumn("terms", F.array_join("terms", " "))


def _generated(spark, d):
    """The generated queries. Words of sections and their frequencies are written once."""
    s = cut(lb.worded(spread(_sections(spark, d).select("url", "heading", "body"))), "section-words")
    pages = spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source")).select(F.concat(F.lit("/doc/"), "doc_id", F.lit("/")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), tx.summary("text").alias("summary"), F.concat_ws(",", "lang", "source").alias("keywords"))
    answers = table(spark, d, "conversations").where("role = 'user'").select(F.concat(F.lit("/conv/"), "conv_id", F.lit("#"), "turn").alias("url"), F.col("text").alias("title"))
    from .base import symbols

    return lb.generate(pages, s, answers, symbols(spark, d).select("url", F.col("symbol").alias("title"), F.lit("").alias("keywords")), cut(lb.section_df(s), "section-df"))


@query("gq1_generated")
def _(spark, d):
    return _generated(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("query").alias("n_queries"))


@query("gq4_merged")
def _(spark, d):
    return lb.merge(_generated(spark, d))


@query("gq5_typo_queries")
def _(spark, d):
    return lb.typos(lb.merge(_generated(spark, d)))


@query("w14_round_robin")
def _(spark, d):
    """A sample of 500 queries, in turn from each bucket; the sample is the feature."""
    return lb.round_robin(lb.merge(_generated(spark, d)), 500)


@query("ev12_seeded_sample")
def _(spark, d):
    """Restraint over a seeded sample of 400 conversations' first words; the sample is the feature."""
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.length("text").cast("double").alias("top_score"))
    return ev.restraint(q, 400)


@query("ag4_median", "SELECT lang, round(median(n_chars), 6) AS med FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.median("n_chars"), 6).alias("med"))


@query("ag12_large_fingerprint")
def _(spark, d):
    return ev.large_fingerprint(table(spark, d, "documents"))


@query("pf14_eligible", r"WITH p AS (SELECT '/api/pkg-' || (page_id % 5) || '/' || CASE WHEN page_id % 3 = 0 THEN 'latest/' ELSE '1.0.' || page_id || '/' END || CASE WHEN page_id % 4 = 0 THEN '' ELSE 'x/' END AS url FROM pages UNION ALL SELECT '/docs/' || page_id || '/' FROM pages) SELECT url, NOT regexp_matches(url, '^/api/[^/]+/latest/$') AS is_page, true AS has_sections FROM p WHERE NOT (regexp_matches(url, '^/api/[^/]+/[^/]+/') AND NOT regexp_matches(url, '^/api/[^/]+/latest/$'))")
def _(spark, d):
    p = table(spark, d, "pages")
    i = F.col("page_id")
    api = p.select(F.concat(F.lit("/api/pkg-"), i % 5, F.lit("/"), F.when(i % 3 == 0, "latest/").otherwise(F.concat(F.lit("1.0."), i, F.lit("/"))), F.when(i % 4 == 0, "").otherwise("x/")).alias("url"))
    return md.eligible(api.unionByName(p.select(F.concat(F.lit("/docs/"), i, F.lit("/")).alias("url"))))


@query("gr9_leaks", "SELECT page_id, leak FROM (SELECT page_id, unnest(list_filter([CASE WHEN contains(html, '<script') THEN 'script' END, CASE WHEN contains(html, '<!--') THEN 'comment' END, CASE WHEN contains(html, '{%') THEN 'template' END], lambda x: x IS NOT NULL)) AS leak FROM pages)")
def _(spark, d):
    return md.leak_scan(table(spark, d, "pages"), "html", (("script", "<script"), ("comment", "<!--"), ("template", r"\{%"))).select("page_id", "leak")


@query("j19_answers_in_page", rf"SELECT page_id, contains(regexp_replace(lower({_VISIBLE}), '\s+', '', 'g'), regexp_replace(lower(CASE WHEN page_id % 3 = 0 THEN reverse({_VISIBLE}) ELSE replace({_VISIBLE}, ' ', chr(10) || ' ') END), '\s+', '', 'g')) AS found FROM pages")
def _(spark, d):
    """The answers are whole visible texts in lines of a word, or back to front, which the page then lacks."""
    from ..operators.graph import answers_in_page

    v = table(spark, d, "pages").select(F.col("page_id").alias("url"), tx.visible_text("html").alias("text"))
    said = F.when(F.col("url") % 3 == 0, F.reverse("text")).otherwise(F.replace("text", F.lit(" "), F.lit("\n ")))
    return answers_in_page(v.select("url", said.alias("answer")), v).select(F.col("url").alias("page_id"), "found")


def _markdown(spark, d):
    """Documents as markdown pages: title, source, every fourth line a heading, some of them FAQ sections with questions. Synthetic, by fixed arithmetic."""
    head = lambda x: F.substring(x, 1, 20)
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(i % 16 == 0, "## FAQ").when(i % 8 == 0, F.concat(F.lit("## "), head(x))).when(i % 4 == 0, F.concat(F.lit("### "), head(x), F.lit("?"))).when(i % 4 == 1, F.concat(F.lit("**"), F.substring(x, 1, 9), F.lit("** "), x)).otherwise(x),
    )
    top = F.concat(F.lit("# Page "), "doc_id", F.lit("\nSource: https://docs.example.org/d/"), "doc_id", F.lit("/\nTopics: x\n\n"))
    return table(spark, d, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit("/index.md")).alias("path"), F.concat(top, F.array_join(lines, "\n")).alias("value"))


_PAGES = """pg AS (SELECT doc_id, 'd/' || doc_id || '/index.md' AS path, 'Page ' || doc_id AS title, '/d/' || doc_id || '/' AS url, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 16 = 1 THEN '## FAQ' WHEN i % 8 = 1 THEN '## ' || substr(x, 1, 20)
  WHEN i % 4 = 1 THEN '### ' || substr(x, 1, 20) || '?' WHEN i % 4 = 2 THEN '**' || substr(x, 1, 9) || '** ' || x ELSE x END), chr(10)) AS body FROM documents WHERE text IS NOT NULL)"""


@query("pf1_headers", f"WITH {_PAGES} SELECT path, title, url, body, 4 AS body_line FROM pg")
def _(spark, d):
    return md.parse_headers(_markdown(spark, d))


@query("w16_section_ranges", f"WITH {_PAGES}, {SECTIONS_SQL} SELECT url, anchor, start, \"end\" FROM sections WHERE anchor <> ''")
def _(spark, d):
    return md.split_sections(md.parse_headers(_markdown(spark, d)), "url").where("anchor <> ''").select("url", "anchor", "start", "end")


_ANSWERS = f"an AS (SELECT heading AS title, CASE WHEN anchor <> '' THEN url || '#' || anchor ELSE url END AS url, {_SUMMARY('text')} AS first, pg.title AS kind FROM sections JOIN pg USING (url) WHERE level BETWEEN 2 AND 3 AND ends_with(heading, '?') AND text <> '')"


@query("pf11_answers", f"WITH {_PAGES}, {SECTIONS_SQL}, {_ANSWERS} SELECT title, url, {_CLIP('first')} AS summary, kind FROM an")
def _(spark, d):
    p = md.parse_headers(_markdown(spark, d))
    return md.answers(md.split_sections(p, "url").join(p.select("url", "title").hint("merge"), "url"))


@query("pf12_faq_pairs", rf"""WITH {_PAGES}, ln AS (SELECT url, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM pg),
fl AS (SELECT *, regexp_matches(line, '^##\s') AS h2, regexp_matches(line, '^###\s+\S') AS is_q FROM ln),
fb AS (SELECT *, coalesce(last_value(CASE WHEN h2 THEN regexp_matches(line, '(?i)^##\s+(?:FAQ|Frequently asked)') END IGNORE NULLS) OVER w, false) AS in_faq, sum((h2 OR is_q)::INT) OVER w AS block FROM fl WINDOW w AS (PARTITION BY url ORDER BY no ROWS UNBOUNDED PRECEDING)),
fx AS (SELECT *, NOT is_q AND trim(line) <> '' AS is_text, trim(line) = '' AS blank FROM fb WHERE in_faq AND NOT h2),
fc AS (SELECT *, max(is_text::INT) OVER (PARTITION BY url, block ORDER BY no ROWS UNBOUNDED PRECEDING) AS begun FROM fx),
fd AS (SELECT *, max((begun = 1 AND blank)::INT) OVER (PARTITION BY url, block ORDER BY no ROWS UNBOUNDED PRECEDING) AS closed FROM fc),
fg AS (SELECT url, block, max(line) FILTER (is_q) AS q, string_agg(trim(line), ' ' ORDER BY no) FILTER (is_text AND closed = 0) AS a FROM fd GROUP BY ALL),
fz AS (SELECT url, {_HEADING("regexp_extract(q, '^###" + chr(92) + "s+(.+?)" + chr(92) + "s*$', 1)")} AS question, {_PLAIN('a')} AS answer FROM fg WHERE q IS NOT NULL AND a IS NOT NULL)
SELECT * FROM fz WHERE ends_with(question, '?')""")
def _(spark, d):
    return md.faq_pairs(md.parse_headers(_markdown(spark, d)), "url", "body")


@query("pf13_terms", f"WITH {_PAGES}, {SECTIONS_SQL}, un AS (SELECT *, coalesce(last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER (PARTITION BY url ORDER BY section ROWS UNBOUNDED PRECEDING), '') AS section_title FROM sections) SELECT url, section_title, heading AS term, {_SUMMARY('raw')} AS definition FROM un WHERE level = 3 AND text <> ''")
def _(spark, d):
    return md.defined_terms(md.split_sections(md.parse_headers(_markdown(spark, d)), "url"))


@query("sr1_records", f"""WITH {_PAGES}, {SECTIONS_SQL}, {_ANSWERS}, cu AS (SELECT '/d/' || doc_id || '/' AS url, CASE WHEN doc_id % 5 = 0 THEN 'about ' || lang END AS curated, source AS keywords FROM documents), pf AS (SELECT title, url, curated, {_SUMMARY('body')} AS first, keywords FROM pg LEFT JOIN cu USING (url)), sy AS ({SYMBOLS_SQL})
SELECT 0 AS grp, title, url, coalesce(curated, {_CLIP('first')}) AS summary, 'Docs' AS kind, keywords FROM pf UNION ALL SELECT 2, title, url, {_CLIP('first')}, kind, NULL FROM an UNION ALL SELECT 1, symbol, url, summary, 'symbol', NULL FROM sy""")
def _(spark, d):
    from .base import symbols

    p = md.eligible(md.parse_headers(_markdown(spark, d)))
    about = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("about "), "lang")).alias("description")
    curated = table(spark, d, "documents").select(F.concat(F.lit("/d/"), "doc_id", F.lit("/")).alias("url"), F.lit(None).cast("string").alias("summary"), about, F.col("source").alias("keywords"))
    sym = symbols(spark, d).select(F.col("symbol").alias("title"), "url", "summary", F.lit("symbol").alias("kind"))
    return md.records(p, md.split_sections(p, "url"), curated, sym)
