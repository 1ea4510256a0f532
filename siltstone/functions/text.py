"""Column functions over text, markdown, HTML, URLs and dates. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to carry a query.
STOP_WORDS = tuple(
    (
        "a an the and or but if then than that this these those of in on at to for from by with "
        "as is are was were be been being do does did doing have has had having it its into over "
        "under about between out up down not no nor so such can could will would should may might "
        "must you your yours we our us they them their he she his her i me my what which who whom "
        "when where why how all any both each few more most other some only own same too very s t "
        "just also via per vs"
    ).split()
)

# Group labels by URL prefix, first match wins.
GROUPS = (
    ("^/blog/topics/", "Topic"),
    ("^/blog/authors/", "Author"),
    ("^/blog/", "Article"),
    ("^/tutorial/", "Tutorial"),
    ("^/cli/", "CLI"),
    ("^/mcp/", "MCP"),
    ("^/agents/", "Recipe"),
    ("^/glossary/", "Glossary"),
    ("^/compare/", "Compare"),
    ("^/(?:license|terms|privacy|contributing|support|contact)/?", "Project"),
)
# Inline and block tags that plain text leaves out.
_TAGS = "a|code|pre|em|strong|b|i|span|br|kbd|sup|sub|small|abbr|div|p|ul|ol|li|table|thead|tbody|tr|th|td|img|figure|figcaption|details|summary|section|nav|h[1-6]"

# The patterns below are read alike by Java and RE2.
#: What a reader of the page does not see: template tags, comments, markup.
UNSEEN = r"(?is)\{%.*?%\}|<!--.*?-->|</?(?:" + _TAGS + r")\b[^>]*>"
#: An image, or a link whose group is its text.
LINK = r"!\[[^\]]*\]\([^)]*\)|\[([^\]]*)\]\([^)]*\)"
#: Lines without words: code fences, rules of tables, thematic breaks.
WORDLESS = r"^\s*(?:```|~~~|[\s:|-]{6,}$)"
#: Block markers in front of a line, one inside the other.
BLOCK = r"^(?:\s*(?:#{1,6}\s|>|[-*+]\s|\d+\.\s))+"
#: Inline marks and the bars of table cells.
MARKS = r"[`|*]|__|~~"
#: Attributes in braces, which headings may carry.
ATTRIBUTES = r"\{[#.][^}]*\}"
#: Underscores at the border of a word mean what a star does; those within a word mean nothing. Replacements are for the group that each pattern has.
BORDERS = (r"(^|[^A-Za-z0-9])_{1,2}", r"_{1,2}($|[^A-Za-z0-9])")
QUOTED = r"^\s{0,3}>\s?(.+)$"
#: How a block begins that is no prose: headings, fences, tables, markup, quotes, rules, lists.
NO_PROSE = r"^(?:#|```|~~~|\||<|>|-{3}|[-*+]\s|\d+\.\s)"
#: What may stand in prose but is none alone: links and images, code, bold labels.
LABELS = r"!?\[[^\]]*\]\([^)]*\)|`[^`]*`|\*\*[^*]*\*\*"
A_WORD = r"\p{L}{2}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chain(x: Column | str, *steps: tuple[str, str]) -> Column:
    """Regex replacements one after the other."""
    out = _c(x)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return out


def first_match(x: Column, rules, default: Column | str | None = None) -> Column:
    """The label of the first rule (pattern, label) whose pattern is found in x."""
    out = None
    for pattern, label in rules:
        on = x.rlike(pattern)
        out = F.when(on, F.lit(label)) if out is None else out.when(on, F.lit(label))
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def squash(x) -> Column:
    """Lower case without white space."""
    return chain(F.lower(_c(x)), (r"\s+", ""))


#: Curly quotes close up; of the rest letters, digits and the signs of scopes, paths, versions and languages stay.
QUOTES, UNCLEAN = "[‘’“”]+", r"[^a-z0-9@/.+\-]+"


#: A run of what UNCLEAN leaves.
CLEAN = r"[a-z0-9@/.+\-]+"


def clean_query(x) -> Column:
    """Lower case, curly quotes dropped, runs of anything but letters, digits and @ / . + - as one space, trimmed."""
    return F.array_join(words(x), " ")


def words(x) -> Column:
    """The words of clean_query(), found rather than cut: replacing each gap takes Spark three times as long."""
    return F.regexp_extract_all(chain(F.lower(_c(x)), (QUOTES, "")), F.lit(CLEAN), F.lit(0))


def telling(w) -> Column:
    """Whether a word says something: no stop word, and two letters or more."""
    return (~w.isin(*STOP_WORDS)) & (F.length(w) > 1)


def content_words(x) -> Column:
    return F.filter(words(x), telling)


def tokens(x) -> Column:
    """Lower-case alphanumeric tokens in order."""
    return F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda w: w != "")


#: Words that hyphens join.
HYPHENATED = "[a-z0-9]+(?:-[a-z0-9]+)+"


def closed_up(x) -> Column:
    """Hyphenated words of a text without their hyphens."""
    return F.transform(F.regexp_extract_all(F.lower(_c(x)), F.lit(HYPHENATED), F.lit(0)), lambda h: F.replace(h, F.lit("-"), F.lit("")))


def slug(x) -> Column:
    """Lower case, non-alphanumerics as single hyphens, trimmed."""
    return chain(F.lower(_c(x)), ("[^a-z0-9]+", "-"), ("^-|-$", ""))


def anchor_slug(x) -> Column:
    s = slug(x)
    return F.when(s == "", F.lit("section")).otherwise(s)


def _one_line(x: Column) -> Column:
    """Runs of white space as one space, trimmed. A single space stays as it is: most are, and each replacement costs."""
    return F.trim(chain(x, (r"\s{2,}|[^\S ]", " ")))


def plain_text(md) -> Column:
    """Markdown as one line of plain text: unseen markup and link targets go first, then lines lose their block markers, then inline marks go."""
    lines = F.split(chain(F.coalesce(_c(md), F.lit("")), (UNSEEN, " "), (LINK, "$1")), "\n", -1)
    read = F.transform(F.filter(lines, lambda x: ~x.rlike(WORDLESS)), lambda x: F.regexp_replace(x, BLOCK, ""))
    return _one_line(chain(F.array_join(read, " "), (MARKS, " ")))


def heading_text(md) -> Column:
    """A heading as plain text without attributes; marks leave no gap."""
    return _one_line(chain(F.coalesce(_c(md), F.lit("")), (ATTRIBUTES, " "), (UNSEEN, " "), (LINK, "$1"), (MARKS, "")))


def emphasis(md) -> Column:
    """Spans that stand out, in order, then quoted lines, as plain text. Every line is split at its stars, and each second piece that a star closes stands out."""
    lines = F.split(_c(md), "\n", -1)
    pieces = F.transform(lines, lambda x: F.split(chain(x, (BLOCK, ""), (BORDERS[0], "$1*"), (BORDERS[1], "*$1"), (r"\*{2}", "*")), r"\*", -1))
    stressed = F.flatten(F.transform(pieces, lambda ps: F.filter(ps, lambda p, i: (i % 2 == 1) & (i < F.size(ps) - 1))))
    quotes = F.transform(F.filter(lines, lambda x: x.rlike(QUOTED)), lambda x: F.regexp_extract(x, QUOTED, 1))
    return plain_text(F.array_join(F.concat(stressed, quotes), " "))


def clip_words(x, size: int, mark: str = "…") -> Column:
    """At most size characters, cut back to the last space, with a mark where something went."""
    c = _c(x)
    head = F.substring(c, 1, size)
    cut = F.when(head.contains(" "), chain(head, (r" [^ ]*$", ""))).otherwise(F.substring(head, 1, size - 1))
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.trim(cut), F.lit(mark)))


def paragraphs(md) -> Column:
    return F.split(_c(md), r"\n\s*\n", -1)


def summary(md, size: int = 200) -> Column:
    """The first paragraph that is not empty as plain text, clipped at a word."""
    first = F.aggregate(paragraphs(md), F.lit(""), lambda found, p: F.when(found != "", found).otherwise(plain_text(p)))
    # As an element of a list the paragraph is found once, however often clipping names it.
    return F.transform(F.array(F.coalesce(first, F.lit(""))), lambda x: clip_words(x, size))[0]


def clamp_sentences(x, size: int = 160) -> Column:
    """Whole sentences up to size characters; else a cut at a word."""
    c = _c(x)
    sentences = F.split(c, r"(?<=[.!?])\s+(?=[A-Z\"'(])")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def take(acc, s):
        longer = F.when(acc["out"] == "", s).otherwise(F.concat(acc["out"], F.lit(" "), s))
        stop = acc["full"] | ((acc["out"] != "") & (F.length(longer) > size))
        return F.struct(F.when(stop, acc["out"]).otherwise(longer).alias("out"), stop.alias("full"))

    out = F.aggregate(sentences, start, take)["out"]
    cut = chain(F.substring(c, 1, size - 1), (r"\s\S*$", ""), ("[,;:.]$", ""))
    return F.when(F.length(c) <= size, c).when((F.length(out) > 0) & (F.length(out) <= size), out).otherwise(F.concat(cut, F.lit("…")))


def prose_paragraph(md) -> Column:
    """The first paragraph that is prose, as plain text: no block of another kind, and with a word of its own beside links, code and labels."""
    trimmed = F.transform(paragraphs(md), lambda p: chain(p, (r"^\s+|\s+$", "")))
    prose = F.filter(trimmed, lambda p: ~p.rlike(NO_PROSE) & F.regexp_replace(p, LABELS, "").rlike(A_WORD))
    return F.coalesce(plain_text(F.get(prose, F.lit(0))), F.lit(""))


def group_label(url) -> Column:
    return first_match(_c(url), GROUPS, "Docs")


def decode_entities(x) -> Column:
    """Named and numeric entities of text and attributes; the ampersand last."""
    out = _c(x)
    # Entities and what they stand for.
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(to))
    return out


def visible_text(html) -> Column:
    """Text of an HTML page without scripts, styles and tags."""
    bare = chain(_c(html), (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"<[^>]+>", " "))
    return F.trim(chain(decode_entities(bare), (r"\s+", " ")))


def links(html) -> Column:
    """Array of the href and src values of a page, entities decoded."""
    pattern = r'(?i)<(?:a|area|link|img|script|iframe|source)\b[^>]*?\s(?:href|src)="([^"]*)"'
    return F.transform(F.regexp_extract_all(_c(html), F.lit(pattern), F.lit(1)), decode_entities)


def anchors(html) -> Column:
    """Array of the ids and names that a link's fragment can point to."""
    ids = F.regexp_extract_all(_c(html), F.lit(r'\sid="([^"]+)"'), F.lit(1))
    names = F.regexp_extract_all(_c(html), F.lit(r'(?i)<a\b[^>]*?\sname="([^"]+)"'), F.lit(1))
    return F.array_union(ids, names)


def absolute_links(md, origin: str) -> Column:
    return chain(_c(md), (r"\]\((/[^)\s]*)\)", rf"]({origin}$1)"))


def normal_tags(topics, fixed: tuple[str, ...], cap: int = 4) -> Column:
    """Fixed tags, then topics as bare lower-case words, distinct, at most cap."""
    mapped = F.transform(_c(topics), lambda t: chain(F.lower(t), ("[^a-z0-9]", "")))
    return F.slice(F.array_distinct(F.concat(F.array(*[F.lit(t) for t in fixed]), F.filter(mapped, lambda t: t != ""))), 1, cap)


def has_mirror(path, mirror=None, draft=None) -> Column:
    """Whether a page path has a markdown twin."""
    p = _c(path)
    ok = p.rlike("^/") & p.rlike("/$") & ~p.rlike(r"/page/\d+/$") & ~p.rlike(r"^/api/(?!$)(?!faq/$)(?!.*/latest/)")
    if mirror is not None:
        ok = ok & F.coalesce(_c(mirror), F.lit(True))
    return ok if draft is None else ok & ~F.coalesce(_c(draft), F.lit(False))


def sitemap_bucket(path) -> Column:
    p = _c(path)
    return F.when(p.rlike("^/api/"), "api").when(p.rlike("^/blog/"), "blog").otherwise("pages")


def url_host(url) -> Column:
    """Lower-case host without www.; null without one."""
    host = F.lower(F.try_parse_url(_c(url), F.lit("HOST")))
    return chain(host, (r"^www\.", ""))


def url_path(url) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/"))


def resolve_link(base, href) -> Column:
    """A link against the URL of its page: absolute, rooted, same page or relative to the folder."""
    b, h = _c(base), _c(href)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(b), r"[^/]*$", "")
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("#") | (h == ""), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .otherwise(F.concat(origin, folder, h))
    )


def is_semver(x) -> Column:
    return _c(x).rlike(r"^\d+\.\d+\.\d+$")


def version_key(x) -> Column:
    """a.b.c as an array of ints, which compares by number."""
    return F.transform(F.split(F.regexp_extract(_c(x), r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda p: p.try_cast("int"))


def major(x) -> Column:
    return F.split(_c(x), r"\.")[0].try_cast("int")


def iso_utc(x) -> Column:
    """A timestamp text as ISO with Z; null if it is none."""
    return F.date_format(F.try_to_timestamp(_c(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def visitor_digest(ip, agent, salt: str | None) -> Column:
    """First 128 bits of a salted SHA-256 as hex; null without an address or a salt."""
    if not salt:
        return F.lit(None).cast("string")
    full = F.sha2(F.concat(_c(ip), F.lit("\n"), F.coalesce(_c(agent), F.lit("")), F.lit("\n" + salt)), 256)
    return F.when(F.coalesce(_c(ip), F.lit("")) != "", F.substring(full, 1, 32))


def ga_client_id(cookie) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(cookie), F.lit("")), r"(?:^|;\s*)_ga=GA\d+\.\d+\.(\d+\.\d+)", 1), F.lit(""))


def half_hour(ts) -> Column:
    return F.floor(F.unix_millis(_c(ts).cast("timestamp")) / F.lit(1800000)).cast("long")


def title_parts(title) -> tuple[Column, Column]:
    """(name, kind) of a reference page's title such as 'Cache.get() method'."""
    t = F.trim(_c(title))
    kind = F.lower(F.element_at(F.split(t, r"\s+"), -1))
    known = kind.isin("class", "interface", "enum", "function", "method", "property", "variable", "type", "namespace", "constructor")
    name = F.when(known, F.trim(chain(t, (r"\s+\S+$", "")))).otherwise(t)
    return chain(name, (r"\(\)$", "")), F.when(known, kind).otherwise(F.lit("package"))


def position_score(p) -> Column:
    """100 at place 1, ten less each place, 0 beyond 10 or without one."""
    c = _c(p)
    return F.when((c >= 1) & (c <= 10), 100.0 - 10.0 * (c - 1)).otherwise(0.0)


def best_hit_gain(p, gain, ideal: float = 3.0) -> Column:
    """A hit's gain over the ideal one, discounted by its place; 0 beyond 10."""
    c = _c(p)
    return F.when((c >= 1) & (c <= 10), _c(gain) / F.lit(ideal) / F.log2(c + F.lit(1))).otherwise(0.0)


def normal_two_sided(z) -> Column:
    """Two-sided normal tail by a rational approximation of the error function (error under 1.5e-7)."""
    # The approximation's coefficients.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    x = F.abs(_c(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    erf = 1 - t * F.exp(-x * x) * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf))


# Neighbours on the keyboard.
NEIGHBOURS = (("a", "s"), ("e", "w"), ("i", "o"), ("o", "i"), ("s", "a"), ("t", "r"), ("n", "m"), ("r", "e"), ("l", "k"), ("c", "x"))


def typo(query, seed: int = 1) -> Column:
    """The query with one letter, not its first, swapped for its keyboard neighbour; null if no letter has one.

    The letters that have a neighbour are ordered by a seeded hash of the query and their place, and the first is swapped: linear in the query's length.
    """
    q = _c(query)
    source, target = ("".join(x) for x in zip(*NEIGHBOURS))
    # The hash of the query comes in as an element, so that it is computed once and not for each letter.
    keyed = F.array(F.xxhash64(q, F.lit(seed)))
    places = F.filter(F.transform(F.split(q, ""), lambda c, i: F.when((i > 0) & F.lit(source).contains(c) & (c != ""), i + 1)), lambda i: i.isNotNull())
    order = F.transform(keyed, lambda h: F.array_min(F.transform(places, lambda i: F.struct(F.xxhash64(h, i).alias("h"), i.alias("i"))))["i"])
    return F.transform(order, lambda i: F.overlay(q, F.translate(F.substring(q, i, F.lit(1)), source, target), i, F.lit(1)))[0]
