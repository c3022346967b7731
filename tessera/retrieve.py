"""Retrieval from a corpus of records: screening, measure contract, lexical and dense ranking, authority, projection.

A record has: id, evidence_type, piece, topic, answer, retrieval_text, relevance_text strings;
measure_range ranges; measure_status, measure_scope strings; and may have retrieval_aliases,
an array of strings, source_ids, and retrieval_eligible, which is true where missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import guidance
from tessera.functions import ranges as R
from tessera.functions import text as X
from tessera.operators import lexical, questions, ranking, screening, selection
from tessera.session import kept

ALIAS_WEIGHT, OVER_FETCH, CONTEXT_ROWS, MEANING_PLACES = 20.0, 24, 2, 6
FINAL_LINEAGE, SEPARATE_LINEAGE, DIRECT_LINEAGE = "expert_annotation", "web_coaching", "sumijo_feedback"
# Reasons for no evidence, the first that holds.
REASONS = ("rejected_question", "measure_contract", "no_corpus_evidence", "generation_unavailable")


@dataclass(frozen=True)
class Request:
    """A literal question with its selected ranges and filters. anchors: words for what it intends beyond its own, each of which some record has to have."""

    question: str
    ranges: tuple[tuple[int, int], ...] = ()
    piece: str | None = None
    topic: str | None = None
    top_k: int = 8
    titles: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    scaffold: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    forms: dict[str, str] = field(default_factory=dict)

    def range_column(self) -> Column:
        return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in self.ranges)) if self.ranges else F.array().cast(R.RANGES)


def reason(spark, request: Request) -> str | None:
    """Why a request isn't answered at all, or null."""
    asked = spark.createDataFrame([(request.question,)], "q string")
    form = X.screen_form(F.col("q"))
    row = asked.select(screening.question_reason(form).alias("a"), questions.contract(F.col("q"), request.range_column()).alias("b")).first()
    return "rejected_question" if row["a"] else "measure_contract" if row["b"] else None


def eligible(records: DataFrame, request: Request) -> Column:
    """Eligible unless it says not, of the piece, with the topic as a part of its topic."""
    found = F.coalesce(F.col("retrieval_eligible"), F.lit(True)) if "retrieval_eligible" in records.columns else F.lit(True)
    if request.piece:
        found = found & (F.col("piece") == request.piece)
    return found & F.contains(F.col("topic"), F.lit(request.topic)) if request.topic else found


def split_lineages(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Main, separate and direct records: each is indexed by itself, so none shifts another's statistics."""
    kind = F.coalesce(F.col("evidence_type"), F.lit(""))
    return records.filter(~kind.isin(SEPARATE_LINEAGE, DIRECT_LINEAGE)), records.filter(kind == SEPARATE_LINEAGE), records.filter(kind == DIRECT_LINEAGE)


@dataclass(frozen=True)
class Asked:
    """What a request's question comes down to: groups of token variants (its own, then the anchors'), concepts, the relation it asks for, and whether it asks for guidance in general."""

    groups: list[list[str]]
    n_own: int
    concepts: list[str]
    relation: str | None
    broad: bool
    terms: list[str]
    facets: list[str]


def understood(spark, request: Request) -> Asked:
    plain = questions.without_measures(questions.without_titles(F.col("q"), list(request.titles)))
    concepts = questions.concepts(plain, request.forms, request.stop, scaffold=request.scaffold)
    asked = spark.createDataFrame([(request.question,)], "q string").select("q", X.query_tokens(plain, request.scaffold).alias("g"), concepts.alias("c"))
    anchors = [X.variants(F.lit(x)) for x in request.anchors]
    row = asked.select(
        "g", "c", F.array(*anchors).alias("a") if anchors else F.array().cast("array<array<string>>").alias("a"), questions.asked_relation(F.col("q"), F.col("c")).alias("r"),
        guidance.asks_broadly(F.col("q"), F.col("c"), request.titles).alias("b"), guidance.asked_terms(F.col("q")).alias("t"), guidance.asked_facets(F.col("q")).alias("f"),
    ).first()
    own = row["g"] or []
    return Asked([*own, *(row["a"] or [])], len(own), row["c"] or [], row["r"], bool(row["b"] and request.piece and not request.ranges), row["t"] or [], row["f"] or [])


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _aliases(records: DataFrame, request: Request, wanted: Column) -> Column:
    aliases = F.coalesce(F.col("retrieval_aliases"), _strings([])) if "retrieval_aliases" in records.columns else _strings([])
    return X.alias_score(wanted, F.transform(aliases, lambda a: questions.concepts(a, request.forms, request.stop)))


def scored(records: DataFrame, request: Request, asked: Asked | None = None) -> DataFrame:
    """Candidates with all scores and the groups that they cover.

    Statistics are those of all records; the text that ranks is retrieval_text, the one that admits
    relevance_text. Where the question has concepts, a candidate has them all. Where it has none,
    it shares a token with the question or an anchor.
    """
    asked = understood(records.sparkSession, request) if asked is None else asked
    terms = list(dict.fromkeys(t for g in asked.groups for t in g))
    text = lexical.score(records, "id", X.document_tokens(F.coalesce(F.col("retrieval_text"), F.col("answer"), F.lit(""))), terms, eligible(records, request)).withColumnRenamed("score", "text_score")
    wanted = _strings(asked.concepts)
    required = [c for c in asked.concepts if c != asked.relation]
    relevance = F.coalesce(F.col("relevance_text"), F.col("answer"), F.lit(""))
    in_answer = questions.concepts(F.coalesce(F.col("answer"), F.lit("")), request.forms, request.stop)
    relation = questions.states_relation(F.col("answer"), F.col("__content"), _strings(required)) if asked.relation else F.lit(False)
    groups = F.array(*map(_strings, asked.groups)) if asked.groups else F.array().cast("array<array<string>>")
    own = F.lit(bool(asked.concepts))
    q = request.range_column()
    final = F.col("evidence_type") == FINAL_LINEAGE
    out = (
        text.withColumn("__known", questions.concepts(relevance, request.forms, request.stop))
        .withColumn("__content", in_answer)
        .withColumn("__tokens", X.document_tokens(relevance))
        .withColumn("scope_match", R.scope_label(F.col("measure_range"), F.col("measure_status"), q))
        .filter("scope_match <> 'unspecified_context'")
        .withColumn("concept_coverage", X.coverage(wanted, F.col("__known")))
        .filter((F.lit(not asked.concepts)) | (F.col("concept_coverage") >= 1.0))
        .withColumn("covers", F.filter(F.transform(groups, lambda g, i: F.when((own & (i < asked.n_own)) | F.arrays_overlap(g, F.col("__tokens")), i)), lambda i: i.isNotNull()))
        .filter(F.size("covers") > 0)
        .withColumn("alias_score", _aliases(records, request, wanted))
        .withColumn("content_coverage", X.coverage(_strings(required), F.col("__content")))
        .withColumn("relation_score", F.coalesce(relation, F.lit(False)).cast("double"))
        .withColumn("measure_score", R.scope_boost(F.col("measure_range"), F.col("measure_status"), F.col("measure_scope"), final, q))
        .withColumn("scope_priority", R.scope_priority(F.col("scope_match"), q))
        .withColumn("score", F.col("text_score") + F.col("measure_score") + ALIAS_WEIGHT * F.col("alias_score"))
    )
    return out.drop("__known", "__content", "__tokens")


#: What tells candidates apart, the weightiest first, all descending; the id ends every tie.
MERITS = ("scope_priority", "alias_score", "relation_score", "content_coverage", "concept_coverage", "score", "text_score")


def strict_order() -> list[Column]:
    """Nine keys, all descending, the id too: merits, with whether an alias fits at all before how well."""
    return [F.desc("scope_priority"), (F.col("alias_score") > 0).desc(), *(F.desc(c) for c in MERITS[1:]), F.desc("id")]


def covering(candidates: DataFrame, groups: int, k: int) -> list | None:
    """Ids of the best k rows at most that cover all groups together, or null.

    Best: the highest scope, the fewest rows, then the sums of merits in turn, then the earliest in
    strict order. Of the rows that cover the same groups the first in strict order has every merit,
    so one row a set of groups, however many candidates there are, comes to the driver.
    """
    firsts = candidates.withColumn("__n", F.row_number().over(W.partitionBy("covers").orderBy(*strict_order()))).filter("__n = 1").orderBy(*strict_order())
    rows = firsts.select("id", "covers", *MERITS).collect()
    chosen = best_cover([sum(1 << i for i in r["covers"]) for r in rows], [[float(r[m]) for m in MERITS] for r in rows], groups, k)
    return None if chosen is None else [rows[i]["id"] for i in chosen]


def best_cover(masks: list[int], merits: list[list[float]], groups: int, k: int) -> tuple[int, ...] | None:
    """Places of the best k rows at most whose masks reach all groups together, or null. Rows are in strict order, one a mask."""
    full = (1 << groups) - 1

    def quality(chosen: tuple[int, ...]) -> tuple:
        sums = [sum(merits[i][m] for i in chosen) for m in range(len(MERITS))]
        return (max((merits[i][0] for i in chosen), default=0.0), -len(chosen), *sums, tuple(-i for i in chosen))

    held: dict[int, tuple[int, ...]] = {0: ()}
    for i, mask in enumerate(masks):
        for reached, chosen in list(held.items()):
            if len(chosen) < k:
                known, now = held.get(reached | mask), (*chosen, i)
                if known is None or quality(now) > quality(known):
                    held[reached | mask] = now
    return held.get(full)


def broad_search(records: DataFrame, request: Request, asked: Asked) -> DataFrame:
    """The answer to a question for guidance in general: a balanced set of the piece's expert records. Columns as search() gives them."""
    empty = F.array().cast(R.RANGES)
    final = F.col("evidence_type") == FINAL_LINEAGE
    pools = F.create_map(*(F.lit(x) for kv in guidance.POOLS.items() for x in kv))
    found = (
        records.filter(eligible(records, request) & F.col("evidence_type").isin(*guidance.LINEAGES))
        .withColumn("__found", guidance.profile(F.col("answer"), F.col("measure_range")))
        .filter((F.col("__found.score") > 0) & guidance.answers_request(F.col("__found"), asked.terms))
        .withColumn("scope_match", R.scope_label(F.col("measure_range"), F.col("measure_status"), empty))
        .withColumn("pool", F.element_at(pools, F.col("scope_match")))
        .filter("pool IS NOT NULL")
        .withColumn("facets", F.col("__found.facets"))
    )
    named = guidance.FACET_WEIGHT * F.size(F.array_intersect("facets", _strings(asked.facets))) + guidance.TERM_WEIGHT * F.size(F.array_intersect(F.col("__found.terms"), _strings(asked.terms)))
    found = (
        found.withColumn("text_score", F.col("__found.score") + named)
        .withColumn("measure_score", R.scope_boost(F.col("measure_range"), F.col("measure_status"), F.col("measure_scope"), final, empty))
        .withColumn("scope_priority", R.scope_priority(F.col("scope_match"), empty))
        .withColumn("alias_score", _aliases(records, request, _strings(asked.concepts)))
        .withColumns({c: F.lit(1.0) for c in ("concept_coverage", "content_coverage")})
        .withColumn("relation_score", F.lit(0.0))
        .withColumn("covers", F.array().cast("array<int>"))
        .withColumn("score", F.col("text_score") + F.col("measure_score"))
        .drop("__found")
    )
    return guidance.choose(found, request.top_k).drop("pool", "facets")


def search(records: DataFrame, request: Request) -> DataFrame:
    """The request's best records with rank, or none rather than a weak match.

    The fewest records that cover the question together come first in their order, then the other
    candidates up to top_k. If a candidate overlaps the selected range but none of the covering ones
    does, nothing is found. A question for guidance in general takes another way.
    """
    asked = understood(records.sparkSession, request)
    if asked.broad and request.top_k > 0:
        return broad_search(records, request, asked)
    found = scored(records, request, asked)
    nothing = found.withColumn("rank", F.lit(0)).limit(0)
    if request.top_k < 1 or not asked.groups:
        return nothing
    chosen = covering(found, len(asked.groups), request.top_k)
    if chosen is None:
        return nothing
    picked = F.col("id").isin(chosen)
    if request.ranges:
        hits = found.filter("scope_match = 'overlaps_query_range'").agg(F.count("*").alias("n"), F.count(F.when(picked, 1)).alias("own")).first()
        if hits["n"] and not hits["own"]:
            return nothing
    order = [F.desc("__picked"), *strict_order()]
    best = found.withColumn("__picked", picked.cast("int")).orderBy(*order).limit(request.top_k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order))).drop("__picked")


def search_fused(records: DataFrame, request: Request, vectors: DataFrame, query_vector: list[float]) -> DataFrame:
    """The separate lineage's ranking: BM25 (repeated terms count again) and cosine, fused by reciprocal ranks. vectors: (id, vector)."""
    spark = records.sparkSession
    terms = spark.createDataFrame([(request.question,)], "q string").select(X.document_tokens(F.col("q"))).first()[0] or []
    text = lexical.score(records, "id", X.document_tokens(F.coalesce(F.col("retrieval_text"), F.col("answer"), F.lit(""))), terms, eligible(records, request)).withColumnRenamed("score", "text_score")
    q = spark.createDataFrame([(0, query_vector)], "q int, qv array<double>")
    dense = ranking.cosine(q, vectors, "q", "id", "qv", "vector").select("id", F.col("score").alias("dense_score"))
    if request.top_k < 1:
        return text.join(dense, "id", "left").withColumn("rank", F.lit(0)).limit(0)
    best = ranking.fused_top(kept(text.join(dense, "id", "left"), "fused"), "text_score", "dense_score", "id", request.top_k).filter("fused > 0")  # top_k rows
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("fused"), "id")))


def search_direct(records: DataFrame, request: Request, vectors: DataFrame, query_vector: list[float], least: float = ranking.LEAST_SCORE, margin: float = ranking.LEAST_MARGIN) -> DataFrame:
    """Direct feedback: lexical matches, led by the one dense match that is strong and clear enough."""
    lexical_rows = search(records, request)
    q = records.sparkSession.createDataFrame([(0, query_vector)], "q int, qv array<double>")
    fits = records.filter(eligible(records, request)).withColumn("scope_match", R.scope_label(F.col("measure_range"), F.col("measure_status"), request.range_column()))
    if request.ranges:
        fits = fits.filter(F.col("scope_match").isin("overlaps_query_range", "global_context"))
    dense = ranking.cosine(q, vectors.join(fits.select("id"), "id"), "q", "id", "qv", "vector")
    best = fits.join(ranking.confident(dense, ["q"], "score", "id", least, margin).select("id", F.col("score").alias("dense_score")), "id").withColumn("rank", F.lit(0))
    first = best.withColumn("one", F.lit(0))
    rest = lexical_rows.withColumn("one", F.lit(0)).withColumn("dense_score", F.lit(None).cast("double"))
    merged = selection.merge_tiers(first.withColumnRenamed("rank", "place"), rest.withColumnRenamed("rank", "place"), ["one"], "id", "place", [selection.scope_tier(F.col("scope_match"))], request.top_k)
    return merged.drop("one", "place")


def retrieve(records: DataFrame, request: Request) -> tuple[str | None, DataFrame]:
    """(reason for none, evidence): screened, searched per lineage, merged by authority, projected.

    The main search fetches more than is asked for, so that authority decides among relevant records.
    """
    spark = records.sparkSession
    why = reason(spark, request)
    main, _, direct = split_lineages(records)
    wide = Request(**{**request.__dict__, "top_k": max(request.top_k, OVER_FETCH)})
    if why:
        return why, evidence(search(main.limit(0), request))
    first, second = (search(df, wide).withColumn("one", F.lit(0)).withColumnRenamed("rank", "place") for df in (direct, main))
    tiers = [selection.scope_tier(F.col("scope_match")), selection.authority(F.col("evidence_type"))]
    merged = selection.merge_tiers(first, second, ["one"], "id", "place", tiers, request.top_k)
    capped = selection.cap_label(merged, ["one"], F.col("scope_match") == "other_range_context", [F.col("rank")], CONTEXT_ROWS)
    out = evidence(capped)
    return (None if out.head(1) else "no_corpus_evidence"), out


def evidence(results: DataFrame) -> DataFrame:
    """What a caller sees: id, lineage, text, scope and role, and scores to six places, half to even. The topic stays inside."""
    scores = [F.bround(c, MEANING_PLACES).alias(c) for c in ("score", "text_score", "measure_score", "alias_score", "concept_coverage") if c in results.columns]
    return results.select("id", "evidence_type", F.col("answer").alias("text"), R.formatted(F.col("measure_range")).alias("measures"), "scope_match", R.scope_role(F.col("scope_match")).alias("role"), *scores, "rank")
