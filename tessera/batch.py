"""Retrieval for a table of requests: all questions are answered by the same joins, none by a job of its own.

A request has request_id, question, ranges, piece, topic, top_k and anchors; a record is as in
tessera.retrieve, whose rules apply. Requests meet the records that can answer them, and no others:
a request with concepts meets the records that have its rarest ones, a request without any those that
share a token with it. Of all records only terms, length and concepts are looked at; the rest is computed
of those met. Whatever a request decides by itself (covers, gates, ranks) is decided in a window
or group of its candidates' distinct covers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import guidance, retrieve
from tessera.functions import ranges as R
from tessera.functions import text as X
from tessera.operators import lexical, questions, screening, selection
from tessera.session import kept

REQUEST = f"request_id string, question string, ranges {R.RANGES}, piece string, topic string, top_k int, anchors array<string>"
#: A table of so many rows at most, counted first, is sent to every task; a larger one is joined.
SMALL = 20_000
NEAR = 3  # a fuzzy match's lengths differ by no more
SEEDS = 3  # a request meets the records that have so many of its rarest concepts, or all if it has fewer


@dataclass(frozen=True)
class Language:
    """What belongs to the corpus and not to a request: names of pieces, scaffolding, stop words, and forms of concepts."""

    titles: tuple[str, ...] = ()
    scaffold: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    forms: dict[str, str] = field(default_factory=dict)

    def concepts(self, text: Column, scaffold: bool = False) -> Column:
        return questions.concepts(text, self.forms, self.stop, scaffold=self.scaffold if scaffold else ())


def _some(column: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(column), F.array().cast(kind))


def understood(requests: DataFrame, language: Language = Language()) -> DataFrame:
    """requests with reason (why one isn't answered at all, or null), groups of token variants (n_own of the question, then the anchors'), concepts, relation, broad, and the terms and facets it names."""
    plain = questions.without_measures(questions.without_titles(F.col("question"), list(language.titles)))
    out = requests.withColumns({"ranges": _some("ranges", R.RANGES), "anchors": _some("anchors"), "top_k": F.coalesce("top_k", F.lit(8))})
    out = out.withColumn("__form", X.screen_form(F.col("question"))).withColumn("__breach", questions.contract(F.col("question"), F.col("ranges")))
    out = out.withColumn("reason", F.when(screening.question_reason(F.col("__form")).isNotNull(), "rejected_question").when(F.col("__breach").isNotNull(), "measure_contract")).drop("__form", "__breach")
    out = out.withColumn("__own", X.query_tokens(plain, language.scaffold)).withColumn("concepts", language.concepts(plain, True))
    out = out.withColumn("groups", F.concat("__own", F.transform("anchors", X.variants))).withColumn("n_own", F.size("__own")).drop("__own")
    out = out.withColumn("relation", questions.asked_relation(F.col("question"), F.col("concepts")))
    broad = guidance.asks_broadly(F.col("question"), F.col("concepts"), language.titles) & F.col("piece").isNotNull() & (F.size("ranges") == 0)
    return out.withColumn("broad", F.coalesce(broad, F.lit(False))).withColumn("named_terms", guidance.asked_terms(F.col("question"))).withColumn("named_facets", guidance.asked_facets(F.col("question")))


def completed(records: DataFrame) -> DataFrame:
    """records with the columns that they may lack."""
    return records.withColumns({c: F.lit(None).cast(kind) for c, kind in (("retrieval_aliases", "array<string>"), ("retrieval_eligible", "boolean"), ("source_ids", "array<string>")) if c not in records.columns})


def _ranking() -> Column:
    return F.coalesce(F.col("retrieval_text"), F.col("answer"), F.lit(""))


def _relevance() -> Column:
    return F.coalesce(F.col("relevance_text"), F.col("answer"), F.lit(""))


def _aliases(language: Language) -> Column:
    return F.transform(_some("retrieval_aliases"), lambda a: language.concepts(a))


def looked_at(records: DataFrame, language: Language = Language()) -> DataFrame:
    """(id, __dl, __terms, __known) as a table: what requests look at of every record."""
    out = records.select("id", _ranking().alias("__ranks"), _relevance().alias("__admits"))
    out = out.select("id", "__ranks", "__admits", X.document_tokens(F.col("__ranks")).alias("__text"))
    out = out.select("id", "__ranks", "__admits", F.size("__text").alias("__dl"), F.array_distinct("__text").alias("__terms"))
    known = language.concepts(F.col("__admits"))
    if questions.rules_are_hangul(language.forms, language.stop):  # then the concepts of a text without Hangul are its terms
        known = F.when((F.col("__ranks") == F.col("__admits")) & ~X.has_hangul(F.col("__admits")), F.col("__terms")).otherwise(known)
    return kept(out.select("id", "__dl", "__terms", known.alias("__known")), "records")


def prepared(records: DataFrame, language: Language = Language()) -> DataFrame:
    """records, completed(), with what a request looks at of a record that it meets: tokens to rank and to admit by, concepts, and aliases' concepts."""
    return records.withColumns({
        "__text": X.document_tokens(_ranking()), "__admits": F.array_distinct(X.document_tokens(_relevance())), "__known": language.concepts(_relevance()),
        "__content": language.concepts(F.coalesce(F.col("answer"), F.lit(""))), "__aliases": _aliases(language),
    })


def _near_prefixes(word: Column) -> Column:
    """The word's beginnings that a fuzzy match of it may equal, itself too."""
    size = F.length(word)
    return F.transform(F.sequence(F.greatest(F.lit(1), size - NEAR), size), lambda i: F.left(word, i))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def matching_words(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(wanted, known): pairs of a wanted concept and a known one that supports it. One begins with the other, so they meet on that beginning."""
    shorter = wanted.withColumn("__key", F.explode(_near_prefixes(F.col("wanted")))).join(vocabulary.withColumn("__key", F.col("known")), "__key")
    longer = wanted.withColumn("__key", F.col("wanted")).join(vocabulary.withColumn("__key", F.explode(_near_prefixes(F.col("known")))), "__key")
    return shorter.unionByName(longer).filter(X.concept_matches(F.col("wanted"), F.array("known"))).select("wanted", "known").distinct()


def met(records: DataFrame, looked: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, id): the records that can answer a request, before any of its rules is looked at. looked is looked_at(records)."""
    known = looked.select("id", F.explode("__known").alias("known"))
    asked = kept(requests.filter(F.size("concepts") > 0).select("request_id", F.explode("concepts").alias("wanted")), "asked")
    words = asked.select("wanted").distinct()
    vocabulary = known.groupBy("known").agg(F.count("*").alias("__df"))
    pairs = kept(matching_words(words, vocabulary.select("known")).join(vocabulary, "known"), "words")
    costs = words.join(pairs.groupBy("wanted").agg(F.sum("__df").alias("__cost")), "wanted", "left").withColumn("__cost", F.coalesce("__cost", F.lit(0)))
    rarest = asked.join(costs, "wanted").groupBy("request_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("__cost", "wanted"))), 1, SEEDS).alias("x"))
    rarest = rarest.select("request_id", F.size("x").alias("__n"), F.posexplode("x.wanted").alias("__place", "wanted"))
    seeds = rarest.join(pairs.select("wanted", "known"), "wanted").select("request_id", "known", F.expr("shiftleft(1, __place)").alias("__has"), (F.expr("shiftleft(1, __n)") - 1).alias("__all"))
    by_concept = known.join(_sent(kept(seeds, "seeds")), "known").groupBy("request_id", "id").agg(F.bit_or("__has").alias("__has"), F.first("__all").alias("__all")).filter("__has = __all").select("request_id", "id")
    tokens = requests.filter(F.size("concepts") == 0).select("request_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("token"))
    by_token = records.select("id", F.explode(F.array_distinct(X.document_tokens(_relevance()))).alias("token")).join(_sent(kept(tokens, "tokens")), "token").select("request_id", "id")
    return by_concept.unionByName(by_token).distinct()


def _weights(looked: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, weights): the request's terms with their idf, over all records whatever the request's filters."""
    terms = kept(requests.select("request_id", F.explode(F.array_distinct(F.flatten("groups"))).alias("term")), "terms")
    held = looked.select(F.explode("__terms").alias("term")).join(_sent(terms.select("term").distinct()), "term", "left_semi")
    n = looked.count()
    df = held.groupBy("term").agg(F.count("*").alias("__df")).select("term", lexical.idf(F.col("__df"), F.lit(n)).alias("idf"))
    return terms.join(df, "term").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("weights"))


def eligible() -> Column:
    piece = F.col("r_piece").isNull() | (F.col("piece") == F.col("r_piece"))
    topic = F.col("r_topic").isNull() | F.contains(F.col("topic"), F.col("r_topic"))
    return F.coalesce(F.col("retrieval_eligible"), F.lit(True)) & piece & topic


def _with_request(requests: DataFrame) -> DataFrame:
    return requests.withColumnsRenamed({"piece": "r_piece", "topic": "r_topic"}).drop("question", "anchors", "reason")


def scored(records: DataFrame, requests: DataFrame, language: Language = Language()) -> DataFrame:
    """Candidates of each request with all scores and the groups that they cover; see retrieve.scored(). records are completed(), requests understood()."""
    looked = looked_at(records, language)
    mean = looked.agg(F.avg("__dl")).first()[0] or 0.0
    pairs = kept(met(records, looked, requests), "met")
    asked = _with_request(requests).join(_weights(looked, requests), "request_id", "left")
    found = kept(prepared(records.join(_sent(pairs.select("id").distinct()), "id", "left_semi"), language), "found")
    parts = max(records.sparkSession.sparkContext.defaultParallelism, pairs.count() // 2000)  # rows are few and dear, so their size says nothing
    rows = found.join(pairs, "id").repartition(parts, "request_id", "id").join(asked, "request_id").filter(eligible())
    dl = F.size("__text")

    def gain(total: Column, w: Column) -> Column:
        tf = dl - F.size(F.array_remove("__text", w["term"]))  # no step a token
        return total + F.when(tf > 0, w["idf"] * lexical.weight(tf, dl, F.lit(mean))).otherwise(0.0)

    wanted, q = F.col("concepts"), F.col("ranges")
    required = F.filter(wanted, lambda c: ~c.eqNullSafe(F.col("relation")))
    final = F.col("evidence_type") == retrieve.FINAL_LINEAGE
    own = F.size(wanted) > 0
    relation = F.when(F.col("relation").isNotNull(), questions.states_relation(F.col("answer"), F.col("__content"), required))
    out = (
        rows.withColumn("scope_match", R.scope_label(F.col("measure_range"), F.col("measure_status"), q))
        .filter("scope_match <> 'unspecified_context'")
        .withColumn("concept_coverage", X.coverage(wanted, F.col("__known")))
        .filter(~own | (F.col("concept_coverage") >= 1.0))
        .withColumn("covers", F.filter(F.transform("groups", lambda g, i: F.when((own & (i < F.col("n_own"))) | F.arrays_overlap(g, F.col("__admits")), i)), lambda i: i.isNotNull()))
        .filter(F.size("covers") > 0)
        .withColumn("text_score", F.aggregate(F.coalesce("weights", F.array().cast("array<struct<term:string,idf:double>>")), F.lit(0.0), gain))
        .withColumn("alias_score", X.alias_score(wanted, F.col("__aliases")))
        .withColumn("content_coverage", X.coverage(required, F.col("__content")))
        .withColumn("relation_score", F.coalesce(relation, F.lit(False)).cast("double"))
        .withColumn("measure_score", R.scope_boost(F.col("measure_range"), F.col("measure_status"), F.col("measure_scope"), final, q))
        .withColumn("scope_priority", R.scope_priority(F.col("scope_match"), q))
        .withColumn("score", F.col("text_score") + F.col("measure_score") + retrieve.ALIAS_WEIGHT * F.col("alias_score"))
    )
    return out.withColumn("n_groups", F.size("groups")).drop("__known", "__content", "__text", "__admits", "__aliases", "weights", "groups")


def covers(candidates: DataFrame) -> DataFrame:
    """(request_id, id): the best rows of each request that cover all of its groups together; none for a request that can't be covered.

    A request brings to its group one row a set of covered groups, however many candidates there are.
    """
    firsts = candidates.withColumn("__n", F.row_number().over(W.partitionBy("request_id", "covers").orderBy(*retrieve.strict_order()))).filter("__n = 1")
    slim = firsts.select("request_id", "id", "covers", "n_groups", "top_k", *retrieve.MERITS)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [(r.scope_priority, r.alias_score > 0, *(getattr(r, m) for m in retrieve.MERITS[1:]), r.id) for r in rows.itertuples()]
        rows = rows.iloc[sorted(range(len(rows)), key=keys.__getitem__, reverse=True)]
        masks = [sum(1 << int(i) for i in c) for c in rows["covers"]]
        chosen = retrieve.best_cover(masks, rows[list(retrieve.MERITS)].astype(float).to_numpy().tolist(), int(rows["n_groups"].iloc[0]), int(rows["top_k"].iloc[0]))
        return rows.iloc[list(chosen or ())][["request_id", "id"]]

    return slim.groupBy("request_id").applyInPandas(choose, f"request_id {kinds['request_id']}, id {kinds['id']}")


def broad(records: DataFrame, requests: DataFrame, language: Language = Language()) -> DataFrame:
    """Answers to the requests for guidance in general: a balanced set each; see retrieve.broad_search(). Records of other pieces aren't read for guidance."""
    none = F.array().cast(R.RANGES)
    final = F.col("evidence_type") == retrieve.FINAL_LINEAGE
    pools = F.create_map(*(F.lit(x) for kv in guidance.POOLS.items() for x in kv))
    pieces = _sent(kept(requests.filter("broad").select("piece").distinct(), "pieces"))  # a broad request names its piece
    found = records.filter(F.col("evidence_type").isin(*guidance.LINEAGES)).join(pieces, "piece", "left_semi").withColumn("__found", guidance.profile(F.col("answer"), F.col("measure_range"))).filter("__found.score > 0")
    found = found.withColumn("scope_match", R.scope_label(F.col("measure_range"), F.col("measure_status"), none)).withColumn("pool", F.element_at(pools, F.col("scope_match"))).filter("pool IS NOT NULL")
    asked = _with_request(requests.filter("broad"))
    rows = found.join(asked, found["piece"] == asked["r_piece"]).filter(eligible())
    tone = F.array(*map(F.lit, guidance.FACETS[guidance.TONE]))
    of_tone, other = F.array_intersect("named_terms", tone), F.array_except("named_terms", tone)
    serves = (F.size("named_terms") == 0) | ((F.size(of_tone) > 0) & F.array_contains(F.col("__found.facets"), guidance.TONE)) | F.arrays_overlap(other, F.col("__found.terms"))
    named = guidance.FACET_WEIGHT * F.size(F.array_intersect(F.col("__found.facets"), "named_facets")) + guidance.TERM_WEIGHT * F.size(F.array_intersect(F.col("__found.terms"), "named_terms"))
    rows = (
        rows.filter(serves)
        .withColumn("facets", F.col("__found.facets"))
        .withColumn("text_score", F.col("__found.score") + named)
        .withColumn("measure_score", R.scope_boost(F.col("measure_range"), F.col("measure_status"), F.col("measure_scope"), final, none))
        .withColumn("scope_priority", R.scope_priority(F.col("scope_match"), none))
        .withColumn("alias_score", X.alias_score(F.col("concepts"), _aliases(language)))
        .withColumns({c: F.lit(1.0) for c in ("concept_coverage", "content_coverage")})
        .withColumn("relation_score", F.lit(0.0))
        .withColumn("score", F.col("text_score") + F.col("measure_score"))
    )
    return guidance.choose_all(rows, "request_id", "top_k")


ANSWER = ("request_id", "id", "evidence_type", "answer", "measure_range", "scope_match", *retrieve.MERITS, "measure_score", "top_k", "rank")


def search(records: DataFrame, requests: DataFrame, language: Language = Language()) -> DataFrame:
    """(request_id, id, ..., scores, rank): the best records of each request, or none rather than a weak match; see retrieve.search()."""
    records = completed(records)
    plain = requests.filter("NOT broad AND top_k > 0").filter(F.size("groups") > 0)
    found = kept(scored(records, plain, language), "candidates")
    here = W.partitionBy("request_id")
    chosen = covers(found).withColumn("__picked", F.lit(1))
    rows = found.join(chosen, ["request_id", "id"], "left").withColumn("__picked", F.coalesce("__picked", F.lit(0))).withColumn("__covered", F.max("__picked").over(here))
    hit = F.when((F.size("ranges") > 0) & (F.col("scope_match") == "overlaps_query_range"), F.col("__picked"))  # null where not in the range
    rows = rows.withColumn("__hit", F.max(hit).over(here)).filter((F.col("__covered") == 1) & F.coalesce(F.col("__hit") == 1, F.lit(True)))
    ranked = rows.withColumn("rank", F.row_number().over(here.orderBy(F.desc("__picked"), *retrieve.strict_order()))).filter("rank <= top_k")
    return ranked.select(*ANSWER).unionByName(broad(records, requests.filter("top_k > 0"), language).select(*ANSWER))


def answer(records: DataFrame, requests: DataFrame, language: Language = Language()) -> tuple[DataFrame, DataFrame]:
    """((request_id, id, lineage, text, scope, role, scores, rank), (request_id, reason)): the evidence of each request that has any, and why the others have none; see retrieve.retrieve()."""
    asked = kept(understood(requests, language), "requests")
    fine = asked.filter("reason IS NULL")
    main, _, direct = retrieve.split_lineages(records)
    wide = fine.withColumn("__k", F.col("top_k")).withColumn("top_k", F.greatest("top_k", F.lit(int(retrieve.OVER_FETCH))))
    first, second = (search(df, wide.drop("__k"), language).withColumnRenamed("rank", "place") for df in (direct, main))
    tiers = [selection.scope_tier(F.col("scope_match")), selection.authority(F.col("evidence_type"))]
    merged = selection.merge_tiers(first.drop("top_k"), second.drop("top_k"), ["request_id"], "id", "place", tiers, (1 << 31) - 1)
    merged = merged.join(wide.select("request_id", "__k"), "request_id").filter(F.col("rank") <= F.col("__k"))
    capped = selection.cap_label(merged, ["request_id"], F.col("scope_match") == "other_range_context", [F.col("rank")], retrieve.CONTEXT_ROWS)
    scores = [F.bround(c, retrieve.MEANING_PLACES).alias(c) for c in ("score", "text_score", "measure_score", "alias_score", "concept_coverage")]
    shown = capped.select("request_id", "id", "evidence_type", F.col("answer").alias("text"), R.formatted(F.col("measure_range")).alias("measures"), "scope_match", R.scope_role(F.col("scope_match")).alias("role"), *scores, "rank")
    shown = kept(shown, "evidence")
    silent = fine.join(shown.select("request_id").distinct(), "request_id", "left_anti").select("request_id", F.lit("no_corpus_evidence").alias("reason"))
    return shown, asked.filter("reason IS NOT NULL").select("request_id", "reason").unionByName(silent)
