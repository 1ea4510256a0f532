"""Batch retrieval: a table of queries against a table of sections, by BM25F over an inverted index.

Sections carry id, title, heading, body, emphasis, keywords, path, package, grp (0 page, 1 symbol, 2 answer) and external. The index is one row for each
term and section; scores are a join on the term, a sum by query and section, and a window for the rank. All hits of a query are as many as its terms'
postings; index.top_hits() gives the best of them from part of a stored index.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, closed_up, tokens
from ..storage import cut

FIELDS = ("keywords", "heading", "emphasis", "title", "path", "body")


@dataclass(frozen=True)
class Scoring:
    """Weights of the model."""

    weights: dict = field(default_factory=lambda: {"keywords": 4.0, "heading": 3.0, "emphasis": 1.8, "title": 1.5, "path": 1.2, "body": 1.0})
    k1: float = 1.2
    b: float = 0.75
    idf_power: float = 0.6
    stop_weight: float = 0.2
    lemma_weight: float = 0.55
    infix_weight: float = 0.75
    span_bonus: float = 0.5
    order_bonus: float = 0.2
    exact_bonus: float = 2.0
    answer_boost: float = 1.55
    miss_penalty: float = 0.5
    min_terms: int = 3
    min_matched: int = 2


def sections_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as sections: the first line is the heading, the rest the body."""
    head = F.split("text", "\n", 2)
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("/doc/"), F.col("doc_id"), F.lit("/")).alias("url"), head[0].alias("heading"),
        F.coalesce(F.get(head, F.lit(1)), F.lit("")).alias("body"), F.lit(False).alias("external"), F.lit(0).alias("grp"),
    )


def longest_sentence(text):
    """The longest piece of a text between sentence ends; the first in order among equals."""
    parts = F.transform(F.split(text, r"[.!?\n]+\s*"), F.trim)
    best = F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return best[0]["p"]


def postings(sections: DataFrame, fields: tuple[str, ...] = ("heading", "body")) -> DataFrame:
    """(term, id, tf_<field>...): one row for each term and section. A hyphenated word counts as its parts and once more closed up."""
    own = lambda f: F.coalesce(F.col(f), F.lit(""))
    both = F.array(*[F.struct(F.lit(f).alias("f"), F.concat(tokens(own(f)), closed_up(own(f))).alias("ts")) for f in fields])
    flat = sections.select("id", F.explode(both).alias("x")).select("id", F.col("x.f").alias("f"), F.explode("x.ts").alias("term"))
    return flat.groupBy("term", "id").agg(*[F.sum((F.col("f") == f).cast("long")).alias(f"tf_{f}") for f in fields])


def lengths(post: DataFrame, fields: tuple[str, ...] = ("heading", "body")) -> DataFrame:
    """(id, len_<field>...): tokens of each section that has any."""
    return post.groupBy("id").agg(*[F.sum(f"tf_{f}").alias(f"len_{f}") for f in fields])


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(n, df, power: float = 0.6):
    return F.pow(F.ln(1 + (n - df + 0.5) / (df + 0.5)), power)


def weighted_postings(sections: DataFrame, post: DataFrame, s: Scoring = Scoring(), fields: tuple[str, ...] = ("heading", "body"), only: DataFrame | None = None) -> DataFrame:
    """(term, id, w): the saturated, length-normalised weight of a term in a section, times its idf. A field's mean length is over the sections that have it.

    only (term): the terms that are asked for; postings of others are left out before they meet the lengths.
    """
    size = lengths(post, fields)
    mean = size.agg(F.count("*").alias("n"), *[F.greatest(F.avg(F.when(F.col(f"len_{f}") > 0, F.col(f"len_{f}"))), F.lit(1e-9)).alias(f"avg_{f}") for f in fields])
    asked = post if only is None else post.join(only.select("term").distinct().hint("shuffle_hash"), "term", "left_semi")
    full = asked.join(document_frequency(asked).hint("shuffle_hash"), "term").join(size.hint("merge"), "id").crossJoin(F.broadcast(mean))  # mean is one row
    tf = sum((F.lit(s.weights[f]) * F.col(f"tf_{f}") / (1 - s.b + s.b * F.col(f"len_{f}") / F.col(f"avg_{f}")) for f in fields), F.lit(0.0))
    stop = F.when(F.col("term").isin(*STOP_WORDS), s.stop_weight).otherwise(1.0)
    return full.withColumn("tf", tf).select("term", "id", (stop * idf(F.col("n"), F.col("df"), s.idf_power) * F.col("tf") * (s.k1 + 1) / (F.col("tf") + s.k1)).alias("w"))


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) -> (query_id, term, content, closed): distinct terms, and hyphenated words closed up, which are no content terms."""
    own, joined = F.array_distinct(tokens("query")), F.array_except(closed_up("query"), tokens("query"))
    both = F.concat(F.transform(own, lambda t: F.struct(t.alias("term"), F.lit(False).alias("closed"))), F.transform(joined, lambda t: F.struct(t.alias("term"), F.lit(True).alias("closed"))))
    t = queries.select("query_id", F.explode(both).alias("t")).select("query_id", "t.term", "t.closed")
    return t.select("query_id", "term", (~F.col("closed") & ~F.col("term").isin(*STOP_WORDS)).alias("content"), "closed")


def covered():
    """What a hit of a term counts towards coverage: one for a content term, two for a closed-up word, which stands for its parts."""
    return F.when(F.col("closed"), 2).otherwise(F.col("content").cast("long"))


def with_lemmas(terms: DataFrame, vocabulary: DataFrame, lemmas: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """terms (query_id, term, content) with other words of the same lemma at a lower match weight: (query_id, term, match, match_weight, content)."""
    lemma = lemmas.select("form", "lemma")
    of = terms.join(lemma.hint("merge"), F.col("term") == F.col("form"), "left").withColumn("base", F.coalesce("lemma", "term")).drop("form", "lemma")
    forms = vocabulary.join(lemma.hint("merge"), F.col("word") == F.col("form"), "left").select(F.col("word").alias("match"), F.coalesce("lemma", "word").alias("base"))
    near = of.join(forms.hint("merge"), "base").select("query_id", "term", "match", F.when(F.col("match") == F.col("term"), 1.0).otherwise(s.lemma_weight).alias("match_weight"), "content")
    own = terms.select("query_id", "term", F.col("term").alias("match"), F.lit(1.0).alias("match_weight"), "content")
    return own.unionByName(near).groupBy("query_id", "term", "match", "content").agg(F.max("match_weight").alias("match_weight"))


def with_infixes(terms: DataFrame, vocabulary: DataFrame, s: Scoring = Scoring(), min_len: int = 5) -> DataFrame:
    """Words of the vocabulary that hold a query term of min_len letters or more: whole at their start, at a lower weight inside.

    The distinct vocabulary is exploded into its substrings of the lengths that queries have, so the join is an equi-join.
    """
    long = terms.where(F.length("term") >= min_len)
    sizes = long.select(F.length("term").alias("n")).distinct()
    cut = vocabulary.where(F.length("word") >= min_len).join(F.broadcast(sizes), F.length("word") >= F.col("n"))  # as many rows as term lengths
    parts = cut.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("at"))
    parts = parts.select("word", F.substring("word", F.col("at"), F.col("n")).alias("term"), "at")
    hit = long.hint("merge").join(parts, "term").where(F.col("word") != F.col("term")).groupBy("query_id", "term", F.col("word").alias("match"), "content").agg(F.min("at").alias("at"))
    near = hit.select("query_id", "term", "match", F.when(F.col("at") == 1, 1.0).otherwise(s.infix_weight).alias("match_weight"), "content")
    return terms.select("query_id", "term", F.col("term").alias("match"), F.lit(1.0).alias("match_weight"), "content").unionByName(near)


#: Letters of a gram; grams of a term that are looked up, the rarest first.
GRAM, PICKED = 3, 2


def _grams(word):
    return F.transform(F.sequence(F.lit(1), F.length(word) - GRAM + 1), lambda i: F.substring(word, i, F.lit(GRAM)))


def gram_index(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (word) -> (gram, word, at): where each gram begins in each word, a row for each letter but GRAM - 1 of them. For storage."""
    return vocabulary.where(F.length("word") >= GRAM).select("word", F.posexplode(_grams(F.col("word"))).alias("at", "gram")).select("gram", "word", "at")


def with_infixes_by_grams(terms: DataFrame, grams: DataFrame, s: Scoring = Scoring(), min_len: int = 5) -> DataFrame:
    """with_infixes() from a stored gram_index(): the lists of a term's PICKED rarest grams are met at the places that the term gives them, and the words
    that are in all of these lists are verified."""
    long = terms.where(F.length("term") >= max(min_len, GRAM))
    of = long.select("term").distinct().select("term", F.posexplode(_grams(F.col("term"))).alias("off", "gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rare = of.hint("merge").join(often, "gram", "left").withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy(F.coalesce("n", F.lit(0)), "off")))
    picked = rare.where(F.col("_r") <= PICKED).select("term", "gram", "off")
    size = F.least(F.lit(PICKED), F.length("term") - GRAM + 1)
    met = picked.hint("merge").join(grams, "gram").groupBy("term", "word", (F.col("at") - F.col("off")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == size)
    held = met.where((F.substring("word", F.col("start") + 1, F.length("term")) == F.col("term")) & (F.col("word") != F.col("term")))
    found = held.groupBy("term", F.col("word").alias("match")).agg(F.min("start").alias("start"))
    near = long.hint("merge").join(found, "term").select("query_id", "term", "match", F.when(F.col("start") == 0, 1.0).otherwise(s.infix_weight).alias("match_weight"), "content")
    return terms.select("query_id", "term", F.col("term").alias("match"), F.lit(1.0).alias("match_weight"), "content").unionByName(near)


def score(terms: DataFrame, weighted: DataFrame) -> DataFrame:
    """(query_id, id, score, matched, n_content): sums over terms of the best match of each; matched counts content terms, and closed-up words twice."""
    t = terms if "match" in terms.columns else terms.select("query_id", "term", F.col("term").alias("match"), F.lit(1.0).alias("match_weight"), "content", *(["closed"] if "closed" in terms.columns else []))
    t = t if "closed" in t.columns else t.withColumn("closed", F.lit(False))
    hits = t.hint("merge").join(weighted.withColumnRenamed("term", "match"), "match")
    best = hits.groupBy("query_id", "id", "term", "content", "closed").agg(F.max(F.col("w") * F.col("match_weight")).alias("w"))
    sums = best.groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"), F.sum(covered()).alias("matched"))
    size = t.select("query_id", "term", "content").distinct().groupBy("query_id").agg(F.sum(F.col("content").cast("long")).alias("n_content"))
    return sums.join(size.hint("merge"), "query_id")


def coverage_floor(scored: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """Drops hits of queries with min_terms content terms or more that matched fewer than min_matched."""
    return scored.where((F.col("n_content") < s.min_terms) | (F.col("matched") >= s.min_matched))


def rarest_term(terms: DataFrame, df: DataFrame) -> DataFrame:
    """(query_id, topic_term): the content term with the least document frequency; an unseen term counts as 0."""
    t = terms.where("content").select("query_id", "term").distinct().hint("merge").join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return t.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("topic_term"))


def adjust(scored: DataFrame, queries: DataFrame, sections: DataFrame, post: DataFrame | None = None, s: Scoring = Scoring()) -> DataFrame:
    """Bonuses and penalties on scored hits: all terms in the heading, words in the query's order, an exact title, questions
    that meet answers, and hits without the query's rarest term.

    Hits that say has_topic (null: the query has no topic) need no postings. Queries are written first, so that a join sees their size; headings go to the hits.
    """
    q = cut(queries.select("query_id", F.lower("query").alias("q"), F.array_distinct(tokens("query")).alias("q_terms")), "adjusted-queries")
    x = scored.join(q, "query_id").join(sections.select("id", F.lower("heading").alias("h"), F.array_distinct(tokens("heading")).alias("h_terms"), "grp").hint("shuffle_hash"), "id")
    if "has_topic" not in scored.columns:
        topic = rarest_term(query_terms(queries), document_frequency(post))
        has = post.select("id", F.col("term").alias("topic_term"), F.lit(True).alias("_in"))
        x = x.join(topic.hint("merge"), "query_id", "left").hint("merge").join(has, ["id", "topic_term"], "left")
        x = x.withColumn("has_topic", F.when(F.col("topic_term").isNotNull(), F.col("_in").isNotNull()))
    span = F.when(F.size(F.array_intersect("q_terms", "h_terms")) == F.size("q_terms"), 1 + s.span_bonus).otherwise(1.0)
    order = F.when(F.col("h").contains(F.col("q")), 1 + s.order_bonus).otherwise(1.0)
    last = F.element_at(F.split("h", "[./]"), -1)
    exact = F.when((F.col("h") == F.col("q")) | (last == F.col("q")), s.exact_bonus).otherwise(1.0)
    asks = F.when(F.col("q").rlike(r"^(?:how|what|why|when|where|which|who|can|does|do|is|are)\b") & (F.col("grp") == 2), s.answer_boost).otherwise(1.0)
    miss = F.when(~F.col("has_topic"), s.miss_penalty).otherwise(1.0)
    return x.select("query_id", "id", F.round(F.col("score") * span * order * exact * asks * miss, 6).alias("score"), "matched", "n_content")


def scoped(queries: DataFrame) -> DataFrame:
    """queries with scope (the value of pkg:x, or null) and query without it."""
    pkg = F.nullif(F.regexp_extract("query", r"(?:^|\s)pkg:(\S+)", 1), F.lit(""))
    return queries.withColumn("scope", pkg).withColumn("query", F.trim(F.regexp_replace("query", r"(?:^|\s)pkg:\S+", " ")))


def rank(scored: DataFrame, sections: DataFrame, per_page: int | None = None) -> DataFrame:
    """(query_id, id, url, external, score, position): places within each query and edition, ties by id; at most per_page hits of one page."""
    s = scored.join(sections.select("id", "url", "external").hint("shuffle_hash"), "id")
    if per_page:
        page = W.partitionBy("query_id", F.split("url", "#")[0]).orderBy(F.desc("score"), "id")
        s = s.withColumn("_n", F.row_number().over(page)).where(F.col("_n") <= per_page).drop("_n")
    place = W.partitionBy("query_id", "external").orderBy(F.desc("score"), "id")
    return s.select("query_id", "id", "url", "external", "score", F.row_number().over(place).alias("position"))


def merged_order(ranked: DataFrame) -> DataFrame:
    """One list a query, own sections before those of the other edition."""
    w = W.partitionBy("query_id").orderBy("external", F.desc("score"), "id")
    return ranked.withColumn("merged_position", F.row_number().over(w))


def deletions(x):
    """A word and its variants with one letter less."""
    return F.array_union(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.overlay(x, F.lit(""), i, F.lit(1))))


def swaps(x):
    """All ways to swap two neighbouring letters of a word."""
    at = F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x))))


def one_edit(a, b):
    """Whether one letter put in, taken out, replaced or swapped with its neighbour makes the words equal."""
    return (F.levenshtein(a, b) == 1) | ((a != b) & (F.length(a) == F.length(b)) & F.array_contains(swaps(a), b))


def spelling(terms: DataFrame, vocabulary: DataFrame, min_len: int = 4) -> DataFrame:
    """(term, word, df): words of the vocabulary (word, df) one edit away from terms that it lacks.

    Both sides list their deletions, the equi-join meets them, and built-in functions verify the few pairs left.
    """
    lost = terms.select("term").distinct().hint("merge").join(vocabulary, F.col("term") == F.col("word"), "left_anti").where(F.length("term") >= min_len)
    left = lost.select("term", F.explode(deletions(F.col("term"))).alias("key"))
    right = vocabulary.where(F.length("word") >= min_len).select("word", "df", F.explode(deletions(F.col("word"))).alias("key"))
    pairs = left.hint("merge").join(right, "key").select("term", "word", "df").distinct()
    return pairs.where(one_edit(F.col("term"), F.col("word")))


def relaxed_queries(empty: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """empty (query_id, query) -> (query_id, query, confident): rewrites of queries without results. A dotted compound is split (confident);
    else each unknown term takes its most frequent neighbour, the first by letters among equals."""
    split = empty.where(F.col("query").rlike(r"\w\.\w")).select("query_id", F.regexp_replace("query", r"\.", " ").alias("query"), F.lit(True).alias("confident"))
    rest = empty.join(split.hint("merge"), "query_id", "left_anti")
    terms = rest.select("query_id", F.posexplode(tokens("query")).alias("at", "term"))
    best = spelling(terms, vocabulary).groupBy("term").agg(F.min_by("word", F.struct((-F.col("df")).alias("d"), "word")).alias("word"))
    fixed = terms.join(best.hint("merge"), "term", "left").withColumn("word", F.coalesce("word", "term"))
    new = fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("query"), F.max(F.col("word") != F.col("term")).alias("changed"))
    return split.unionByName(new.where("changed").select("query_id", "query", F.lit(False).alias("confident")))


def search(queries: DataFrame, sections: DataFrame, post: DataFrame, s: Scoring = Scoring(), fields: tuple[str, ...] = ("heading", "body")) -> DataFrame:
    """Scored hits (query_id, id, score, matched, n_content) of queries (query_id, query) that cover enough of their terms."""
    terms = query_terms(queries)
    return coverage_floor(score(terms, weighted_postings(sections, post, s, fields, only=terms)), s)


def relaxed_hits(queries: DataFrame, weighted: DataFrame, vocabulary: DataFrame, s: Scoring = Scoring()) -> DataFrame:
    """Scored hits over weighted (term, id, w), and for queries without a hit, and only those, the hits of their rewrite: confident ones first, guesses where
    those find nothing. vocabulary: (word, df). weighted and vocabulary are read from where they are stored: give no plans that are dear to run.

    corrected holds the rewrite, null where the query stands as it is. Each step is written before the next asks what it left empty.
    """
    find = lambda some: coverage_floor(score(query_terms(some), weighted), s)
    without = lambda some, found: some.join(found.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    answered = lambda some: cut(find(some).join(some.select("query_id", F.col("query").alias("corrected")).hint("merge"), "query_id"), "relaxed-hits")
    hits = cut(find(queries).withColumn("corrected", F.lit(None).cast("string")), "hits")
    new = cut(relaxed_queries(without(queries.select("query_id", "query"), hits), vocabulary), "rewrites")
    sure = new.where("confident").select("query_id", "query")
    found = answered(sure)
    # A split that finds nothing is spelt afresh.
    guesses = cut(new.where("NOT confident").unionByName(relaxed_queries(without(sure, found), vocabulary)).select("query_id", "query"), "guesses")
    return hits.unionByName(found).unionByName(answered(guesses))


def search_relaxed(queries: DataFrame, sections: DataFrame, post: DataFrame, s: Scoring = Scoring(), fields: tuple[str, ...] = ("heading", "body")) -> DataFrame:
    """relaxed_hits() over postings that are not stored yet."""
    return relaxed_hits(queries, cut(weighted_postings(sections, post, s, fields), "weights"), cut(document_frequency(post).withColumnRenamed("term", "word"), "vocabulary"), s)


# Suffix rules of English inflection, in order.
DETACH = (
    ("ches", "ch"), ("shes", "sh"), ("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ies", "y"), ("ves", "f"), ("ves", "fe"), ("ing", ""), ("ing", "e"),
    ("ied", "y"), ("ed", ""), ("ed", "e"), ("es", ""), ("es", "e"), ("s", ""), ("men", "man"), ("ae", "a"), ("i", "us"),
)


def stem_candidates(words: DataFrame) -> DataFrame:
    """(word, rule, stem): what each rule that applies leaves; a doubled last consonant also single, right after its own stem."""
    options = []
    for i, (suffix, by) in enumerate(DETACH):
        stem = F.concat(F.expr(f"left(word, length(word) - {len(suffix)})"), F.lit(by))
        on = F.col("word").endswith(suffix) & (F.length("word") - len(suffix) >= 2)
        options.append(F.when(on, F.struct(F.lit(2 * i).alias("rule"), stem.alias("stem"))))
        options.append(F.when(on & stem.rlike(r"([bdfglmnprt])\1$"), F.struct(F.lit(2 * i + 1).alias("rule"), F.expr(f"left(concat(left(word, length(word) - {len(suffix)}), '{by}'), length(word) - {len(suffix)} + {len(by)} - 1)").alias("stem"))))
    return words.select("word", F.explode(F.array_compact(F.array(*options))).alias("c")).select("word", "c.rule", "c.stem")


def lemmas(words: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None, project: DataFrame | None = None) -> DataFrame:
    """(form, lemma) of the words whose lemma differs: project words stay, exceptions come next, then the first rule whose stem is in
    the dictionary (lemma). Every distinct word takes part; a single letter is no exception's form."""
    w = words.select("word").distinct()
    found = stem_candidates(w).hint("merge").join(dictionary.select(F.col("lemma").alias("stem")).distinct(), "stem").groupBy("word").agg(F.min_by("stem", "rule").alias("stem"))
    out = w.join(found.hint("merge"), "word", "left")
    if exceptions is not None:
        out = out.join(exceptions.where(F.length("form") >= 2).select(F.col("form").alias("word"), F.col("lemma").alias("irregular")), "word", "left").withColumn("stem", F.coalesce("irregular", "stem"))
    if project is not None:
        out = out.join(project.select("word").distinct(), "word", "left_anti")
    return out.where("stem IS NOT NULL AND stem <> word").select(F.col("word").alias("form"), F.col("stem").alias("lemma"))


def missing_stems(words: DataFrame, dictionary: DataFrame, ignored: DataFrame) -> DataFrame:
    """(stem, saw_as): stems that the dictionary lacks but the corpus uses as words."""
    c = stem_candidates(words.select("word").distinct()).where(F.length("stem") >= 3)
    c = c.hint("merge").join(dictionary.select(F.col("lemma").alias("stem")), "stem", "left_anti").hint("merge").join(words.select(F.col("word").alias("stem")).distinct(), "stem", "left_semi")
    return c.hint("merge").join(ignored.select(F.col("word").alias("stem")), "stem", "left_anti").groupBy("stem").agg(F.min("word").alias("saw_as"))
