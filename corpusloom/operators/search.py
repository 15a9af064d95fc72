"""Ranked search over sections: BM25 on substring hits, with bonuses for title, phrase and keywords."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as t
from corpusloom.operators import batch, postings
from corpusloom.operators.batch import B, K1, KEYWORD_BONUS, PHRASE_BONUS, ROUNDING, TITLE_BONUS
from corpusloom.operators.postings import CONTENT, KEYWORDS, TITLE, matched_few
from corpusloom.session import discard, stash

DEFAULT_LIMIT, MAX_LIMIT = 5, 20
#: Terms of all queries of a batch, repeats counted, up to which they are sent to the tasks.
FEW_TERMS = 500_000

RESULT = [
    "id", "title", "type", "document_id", "relevance_score", "preview", "match_count", "summary", "heading_level",
    "parent_title", "previous_section_id", "next_section_id", "hierarchy_path",
]


def clamped(limit: int) -> int:
    return max(1, min(MAX_LIMIT, limit))


def _total(terms: list[Column]) -> Column:
    """A sum in a fixed order, so that results don't depend on the plan."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _saturated(tf: Column, size: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + F.lit(B) * size / average))


def search(sections: DataFrame, query: str, document_id: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best sections for a query, in one document or in all, by relevance and then by place.

    Document frequencies always count the whole corpus; the average length is that of the scope. Each section is
    scored on its own text (section ids are unique in a document only). One aggregate brings the statistics, a number a
    term, to the driver; they are literals of a single scan, and the top rows come without a full sort. These, MAX_LIMIT
    at most, are the result. Sections without a hit are left out; a query without terms finds nothing. Neighbours are
    those in the scope, so without a document they cross its border.
    """
    terms = t.terms_of(query)
    spark = sections.sparkSession
    if not terms:
        return spark.createDataFrame([], f"{', '.join(f'{c} {k}' for c, k in _kinds().items())}").select(RESULT)
    lc, title = F.col("content_lc"), F.col("title_lc")
    scoped = F.lit(True) if not document_id else F.col("document_id") == document_id
    counts = [F.sum(lc.contains(w).cast("long")) for w in terms]
    size = F.length("content")
    n, average, *hits = sections.agg(F.count(F.lit(1)), F.avg(F.when(scoped, size)), *counts).first()  # a number a term
    idf = [F.lit(math.log((n - h + 0.5) / (h + 0.5) + 1.0) if h else 0.0) for h in hits]
    rows, mean = sections.where(scoped), F.lit(average or 1.0)
    body = [
        F.when(lc.contains(w), i * _saturated(t.count_occurrences(lc, F.lit(w)), size, mean)).otherwise(0.0)
        for w, i in zip(terms, idf)
    ]
    titles = [F.when(title.contains(w), i * TITLE_BONUS).otherwise(0.0) for w, i in zip(terms, idf)]
    phrase = [F.when(lc.contains(" ".join(terms)), PHRASE_BONUS).otherwise(0.0)] if len(terms) > 1 else []
    keywords = [
        F.when(F.exists("keywords", lambda k: F.lower(k).contains(w)), i * KEYWORD_BONUS).otherwise(0.0)  # noqa: B023
        for w, i in zip(terms, idf)
    ]
    score = _total([*body, *titles, *phrase, *keywords])
    found = (
        rows.withColumn("score", score)
        .where("score > 0")
        .withColumn("relevance_score", (F.col("score") * 100 + ROUNDING).cast("int"))
        .orderBy(F.desc("relevance_score"), "doc_ord", "ord")
        .limit(clamped(limit))
    )
    hits = sum((lc.contains(w).cast("int") for w in terms), F.lit(0))
    found = found.withColumn("match_count", hits).withColumn("preview", t.context_preview(F.col("content"), lc, [F.lit(w) for w in terms]))
    found = found.withColumn("previous_section_id", F.col("prev_section_id")).select(*_projected())
    top = found.orderBy(F.desc("relevance_score"), "doc_ord", "ord").collect()
    if not document_id:
        top = across_borders(top, ends_of(sections))
    return spark.createDataFrame(top, found.schema).select(RESULT)


def _projected() -> list[Column]:
    return [
        F.col("section_id").alias("id"), F.col("title"), F.lit("section").alias("type"), F.col("document_id"),
        F.col("relevance_score"), F.col("preview"), F.col("match_count"), F.col("summary"), F.col("heading_level"),
        F.col("parent_title"), F.col("previous_section_id"), F.col("next_section_id"),
        t.hierarchy_path(F.col("heading_level"), F.col("parent_title"), F.col("title")).alias("hierarchy_path"),
        F.col("doc_ord"), F.col("ord"),
    ]


def _kinds() -> dict[str, str]:
    whole = {"relevance_score", "match_count", "heading_level"}
    return {c: "int" if c in whole else "string" for c in RESULT}


def ends_of(sections: DataFrame) -> DataFrame:
    """(doc_ord, first_section_id, last_section_id): the sections without a neighbour before or after them."""
    first = F.when(F.col("prev_section_id").isNull(), F.col("section_id")).alias("first_section_id")
    last = F.when(F.col("next_section_id").isNull(), F.col("section_id")).alias("last_section_id")
    return sections.where("prev_section_id IS NULL OR next_section_id IS NULL").select("doc_ord", first, last)


def across_borders(top: list[Row], ends: DataFrame) -> list[Row]:
    """Found rows with neighbours also where they are first or last in their documents: the nearest documents' ends.

    One aggregate over the ends of documents, with a number for each such row; there are MAX_LIMIT at most.
    """
    before = sorted({r["doc_ord"] for r in top if r["previous_section_id"] is None})
    after = sorted({r["doc_ord"] for r in top if r["next_section_id"] is None})
    if not before and not after:
        return top
    place = lambda name: F.when(F.col(name).isNotNull(), F.struct("doc_ord", F.col(name).alias("section_id")))
    near = ends.agg(
        F.count(F.lit(1)),
        *[F.max(F.when(F.col("doc_ord") < d, place("last_section_id"))) for d in before],
        *[F.min(F.when(F.col("doc_ord") > d, place("first_section_id"))) for d in after],
    ).first()
    near = [x and x["section_id"] for x in near[1:]]
    previous, following = dict(zip(before, near)), dict(zip(after, near[len(before) :]))
    out = []
    for r in top:
        own = r.asDict()
        own["previous_section_id"] = own["previous_section_id"] or previous.get(r["doc_ord"])
        own["next_section_id"] = own["next_section_id"] or following.get(r["doc_ord"])
        out.append(Row(**own))
    return out


def search_batch(sections: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(query_id, rank, document_id, section_id, relevance_score) for each row of ``queries`` (query_id, query).

    Queries are a table, in one plan for any number of them. Up to FEW_TERMS terms of all queries go to the tasks, which
    read the sections twice, once for document frequencies and once for scores, and keep the best ``limit`` sections of
    each query (``batch``); pairs of queries and sections are never written. Beyond, terms meet tokens and tokens their
    postings by joins. Null queries and queries without terms find nothing; rows that repeat a query_id share one ranking.
    """
    asked = queries.select("query_id", t.query_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    asked = asked.select("query_id", F.array_join("terms", " ").alias("phrase"), "terms").distinct()
    asked = stash(asked.withColumn("q", F.monotonically_increasing_id()).withColumn("of", F.size("terms")), "queries")
    n, chars = sections.agg(F.count(F.lit(1)), F.sum("char_count")).first()
    average = chars / n if n and chars else 1.0
    few = None
    if (asked.agg(F.sum("of")).first()[0] or 0) <= FEW_TERMS:
        few = batch.Batch.of(asked.select("q", "phrase", "terms").collect(), clamped(limit))
    if few is not None and len(few.numbers) <= postings.AUTOMATON_TERMS:
        ranked = batch.best(sections, few, n, average).join(asked.select("q", "query_id"), "q")
    else:
        scored = _scored_by_joins(sections, asked, n, average)
        ranked = scored.withColumn("relevance_score", (F.col("score") * 100 + ROUNDING).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "doc_ord", "ord")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    best = ranked.where(F.col("rank") <= clamped(limit)).select("query_id", "rank", "doc_ord", "ord", "relevance_score")
    return best.join(sections.select("doc_ord", "ord", "document_id", "section_id"), ["doc_ord", "ord"]).select(
        "query_id", "rank", "document_id", "section_id", "relevance_score"
    )


def _scored_by_joins(sections: DataFrame, asked: DataFrame, n: int, average: float) -> DataFrame:
    """(query_id, q, doc_ord, ord, score) of all pairs that score, for any number of queries: what each term adds to a
    section's score is summed for each query and section. Texts are read again only for sections that hold all terms of
    a query, to look for its phrase."""
    found = stash(postings.postings(sections), "postings")
    each = asked.select("q", F.explode("terms").alias("term"))
    terms = stash(each.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    each = each.join(terms, "term").select("q", "t")
    hits = stash(hits_of(postings.matched(terms, found), found, "t"), "hits")
    counts = hits.where("tf > 0").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    flag = lambda name, bonus: F.when(F.col(name), bonus).otherwise(0.0)
    body = F.when(F.col("tf") > 0, _saturated(F.col("tf"), F.col("size"), F.lit(average))).otherwise(0.0)
    added = idf * (body + flag("in_title", TITLE_BONUS) + flag("in_keywords", KEYWORD_BONUS))
    weights = hits.join(counts, "t").select("t", "doc_ord", "ord", (F.col("tf") > 0).cast("int").alias("hit"), added.alias("added"))
    scored = each.join(weights, "t").groupBy("q", "doc_ord", "ord").agg(F.sum("added").alias("score"), F.sum("hit").alias("hit"))
    scored = stash(scored.where("score > 0").join(asked.select("q", "query_id", "of"), "q"), "scores")
    whole = scored.where("of > 1 AND hit = of").select("q", "doc_ord", "ord").join(asked.select("q", "phrase"), "q")
    texts = sections.select("doc_ord", "ord", "content_lc")
    spoken = whole.join(texts, ["doc_ord", "ord"]).where(F.contains("content_lc", "phrase")).select("q", "doc_ord", "ord", F.lit(PHRASE_BONUS).alias("bonus"))
    return scored.join(spoken, ["q", "doc_ord", "ord"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))


def hits_of(words: DataFrame, found: DataFrame, term: str = "term") -> DataFrame:
    """(term, doc_ord, ord, size, tf, in_title, in_keywords) of the sections that hold a term, from tokens that do and
    their postings."""
    n = F.col("n") * F.col("times")
    return found.join(words, "token").groupBy(term, "doc_ord", "ord").agg(
        F.max("size").alias("size"),
        F.sum(F.when(F.col("place") == CONTENT, n).otherwise(0)).alias("tf"),
        F.max(F.col("place") == TITLE).alias("in_title"),
        F.max(F.col("place") == KEYWORDS).alias("in_keywords"),
    )


#: Tokens, or documents, up to which a search asks for them by name, so that files skip the pages that lack them.
FEW = 1000
#: Tokens up to which they are sent to the postings; beyond, all postings are shuffled.
MANY = 500_000


def search_index(index: Any, query: str, document_id: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """What ``search`` finds, row for row, from a stored index: its postings are read for the tokens that hold a term,
    its sections only where the result, or the phrase, asks for their text.

    The index's own totals replace a scan. One aggregate over the hits gives document frequencies; scores without the
    phrase then give the last score that counts, and only sections that hold all terms and can reach it with the phrase
    are read.
    """
    spark, terms = index.sections.sparkSession, t.terms_of(query)
    if not terms:
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in _kinds().items())).select(RESULT)
    scope = index.files.where(F.col("document_id") == document_id) if document_id else None
    n, chars = index.totals if scope is None else scope.agg(F.sum("section_count"), F.sum("total_characters")).first()
    found = looked_up = stash(matched_few(terms, index.grams), "words")
    words = found.limit(FEW + 1).collect()
    read = index.postings
    if len(words) <= FEW:
        read = read.where(F.col("token").isin(sorted({r["token"] for r in words})))
        found = F.broadcast(spark.createDataFrame(words, found.schema))
    elif found.count() <= MANY:
        found = F.broadcast(found)
    hits = hits_of(found, read).groupBy("doc_ord", "ord").agg(
        F.max("size").alias("size"),
        *[F.max(F.when(F.col("term") == w, F.struct("tf", "in_title", "in_keywords"))).alias(f"t{i}") for i, w in enumerate(terms)],
    )
    hits = stash(hits, "hits")
    tf = [F.coalesce(F.col(f"t{i}.tf"), F.lit(0)) for i in range(len(terms))]
    counts = hits.agg(*[F.sum((x > 0).cast("long")) for x in tf]).first()  # a number a term
    idf = [F.lit(math.log((index.totals[0] - h + 0.5) / (h + 0.5) + 1.0) if h else 0.0) for h in counts]
    mean, size = F.lit(float(chars) / n if n and chars else 1.0), F.col("size")
    flag = lambda i, name: F.coalesce(F.col(f"t{i}.{name}"), F.lit(False))
    body = [F.when(x > 0, w * _saturated(x, size, mean)).otherwise(0.0) for x, w in zip(tf, idf)]
    bonus = [F.when(flag(i, name), w * b).otherwise(0.0) for name, b in (("in_title", TITLE_BONUS), ("in_keywords", KEYWORD_BONUS)) for i, w in enumerate(idf)]
    if scope is not None:
        hits = hits.join(scope.select("doc_ord"), "doc_ord", "left_semi")
    place = ["doc_ord", "ord"]
    rows = hits.select(*place, _total([*body, *bonus]).alias("score"), sum((x > 0).cast("int") for x in tf).alias("match_count"))
    rated = lambda score: (score * 100 + ROUNDING).cast("int")
    order = [F.desc("relevance_score"), "doc_ord", "ord"]
    best = lambda df: df.withColumn("relevance_score", rated(F.col("score"))).where("score > 0").orderBy(*order).limit(clamped(limit)).collect()
    top = best(rows)
    if len(terms) > 1:
        least = top[-1]["relevance_score"] if len(top) == clamped(limit) else 0
        may = rows.where((F.col("match_count") == len(terms)) & (rated(F.col("score") + PHRASE_BONUS) >= least))
        near = may.select("doc_ord").distinct().limit(FEW + 1).collect()
        texts = index.sections
        if len(near) <= FEW:
            texts = texts.where(F.col("doc_ord").isin([r["doc_ord"] for r in near]))
        spoken = texts.select(*place, "content_lc").join(may.select(*place), place).where(F.col("content_lc").contains(" ".join(terms))).select(*place, F.lit(PHRASE_BONUS).alias("bonus"))
        top = best(rows.join(spoken, place, "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))))
    discard(hits)
    discard(looked_up)
    kind = "doc_ord long, ord int, match_count int, relevance_score int"
    found = spark.createDataFrame([(r["doc_ord"], r["ord"], r["match_count"], r["relevance_score"]) for r in top], kind)
    texts = index.sections.where(F.col("doc_ord").isin([r["doc_ord"] for r in top])).join(F.broadcast(found), place)
    lc = F.col("content_lc")
    texts = texts.withColumn("preview", t.context_preview(F.col("content"), lc, [F.lit(w) for w in terms])).withColumn("previous_section_id", F.col("prev_section_id"))
    shown = texts.select(*_projected())
    rows = sorted(shown.collect(), key=lambda r: (-r["relevance_score"], r["doc_ord"], r["ord"]))
    if not document_id:
        files = index.files.where("section_count > 0")
        rows = across_borders(rows, files.select("doc_ord", F.col("first_section_id"), F.col("last_section_id")))
    return spark.createDataFrame(rows, shown.schema).select(RESULT)
