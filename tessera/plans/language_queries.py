"""Rules of language on every sentence of the documents, and a table of requests answered from the documents.

The texts are Latin, so the Korean rules get sentences derived from them: each word becomes one of
SPOKEN, by its length and first letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import batch, corpus, guidance
from tessera.functions import ranges as R
from tessera.functions import text as X
from tessera.operators import questions
from tessera.plans.base import Tables, query
from tessera.plans.retrieval_queries import SIX, TOKENS_SQL

SPOKEN = (
    "음색을", "발음은", "노래에서", "주의할", "점은", "무엇을", "의미하나요", "호흡이", "고음에서는", "딕션을", "피아노와", "p", "3마디를", "2마디부터", "4마디까지", "어떻게", "부르는", "연습하려면", "이", "곡의", "조언해줘", "악센트는", "상징하는", "템포는", "제대로", "소화", "가사이에요", "17", "x", "그리고",
)


def spoken(spark, sf_dir: str) -> DataFrame:
    """(doc_id, k, q): sentence k of each document in the words of SPOKEN."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split(F.lower("text"), r"[.!?\n]+")).alias("k", "s"))
    word = lambda w: F.element_at(F.array(*map(F.lit, SPOKEN)), (F.length(w) * 7 + F.ascii(w)) % len(SPOKEN) + 1)
    words = F.regexp_extract_all("s", F.lit("[a-z]+"), F.lit(0))
    return docs.filter(F.col("s").rlike("[a-z]")).select("doc_id", "k", F.array_join(F.transform(words, word), " ").alias("q"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(values) -> str:
    return "|".join(sorted(values, key=len, reverse=True))


SPOKEN_SQL = f"""
s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s, generate_subscripts(regexp_split_to_array(lower(text), '[.!?\\n]+'), 1) - 1 AS k FROM documents),
q AS (SELECT doc_id, k, list_aggregate(list_transform(w, lambda x: {_list(SPOKEN)}[(length(x) * 7 + ascii(x)) % {len(SPOKEN)} + 1]), 'string_agg', ' ') AS q
      FROM (SELECT doc_id, k, regexp_extract_all(s, '[a-z]+') AS w FROM s) WHERE len(w) > 0)"""
PLAIN_SQL = "regexp_extract_all(q, '[0-9]+|[A-Za-zÀ-ÖØ-öø-ÿ]+|[가-힣]+')"
FORMS_SQL = "coalesce(map_extract(MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in X.NORMAL_FORMS.items()) + "}, t)[1], t)"
KEPT_SQL = "length(t) > 1 OR regexp_matches(t, '^[0-9]$') OR t IN ('p', 'f')"


def _stripped(particles) -> str:
    return f"list_transform({PLAIN_SQL}, lambda t: regexp_replace(t, '^([가-힣]{{2,}}?)(?:{_any(particles)})$', '\\1'))"


def _digest_sql(values: str) -> str:
    return f"md5(coalesce(list_aggregate(list_sort(list_distinct({values})), 'string_agg', '|'), ''))"


def _digest(values):
    return F.md5(F.array_join(F.sort_array(F.array_distinct(values)), "|"))


STEM_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '^[가-힣]{{2,}}{'?' if k == 0 else ''}(?:{e})$') THEN regexp_extract(t, '^([가-힣]{{2,}}{'?' if k == 0 else ''})(?:{e})$', 1)" for k, e in enumerate(X.STEM_ENDINGS)) + " ELSE t END"
VARIANTS_SQL = """CASE WHEN regexp_matches(t, '^[가-힣]+$') THEN list_distinct([t] || CASE WHEN length(t) > 2 THEN list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) ELSE [] END
  || CASE WHEN length(t) > 3 THEN list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) ELSE [] END) ELSE [t] END"""


@query(f"""WITH {SPOKEN_SQL},
d AS (SELECT doc_id, k, flatten(list_transform(list_filter(list_transform({_stripped(X.PARTICLES)}, lambda t: {FORMS_SQL}), lambda t: {KEPT_SQL}), lambda t: {VARIANTS_SQL})) AS d FROM q),
g AS (SELECT doc_id, k, list_distinct(list_filter(list_transform(list_transform({PLAIN_SQL}, lambda t: {FORMS_SQL}), lambda t: {STEM_SQL}), lambda t: ({KEPT_SQL}) AND t <> '그리고' AND NOT (length(t) > 2 AND regexp_matches(t, '하는$')))) AS g FROM q)
SELECT doc_id, k::INT AS k, len(d)::INT AS n_tokens, {_digest_sql('d')} AS doc_tokens, len(g)::INT AS n_groups, {_digest_sql("flatten(list_transform(g, lambda t: " + VARIANTS_SQL + "))")} AS query_tokens
FROM d JOIN g USING (doc_id, k)""")
def token_rules(spark, sf_dir):
    q = F.col("q")
    df = spoken(spark, sf_dir).withColumn("d", X.document_tokens(q)).withColumn("g", X.query_tokens(q, ("그리고",), ("하는",)))
    return df.select("doc_id", "k", F.size("d").alias("n_tokens"), _digest(F.col("d")).alias("doc_tokens"), F.size("g").alias("n_groups"), _digest(F.flatten("g")).alias("query_tokens"))


ENDINGS = ("하나요", "하는")
CONCEPTS_SQL = f"""list_filter(list_transform(list_filter({_stripped((*X.PARTICLES, *X.CONCEPT_ONLY_PARTICLES))}, lambda t: t <> '그리고'), lambda u:
  list_transform([regexp_replace(list_transform([u], lambda t: {FORMS_SQL})[1], '^(.{{2,}}?)(?:{_any(ENDINGS)})$', '\\1')], lambda t: {FORMS_SQL})[1]), lambda t: {KEPT_SQL})"""
RELATED_SQL = f"list_filter(list_distinct(c), lambda x: len(list_filter({_list(questions.RELATION_ROOTS)}, lambda r: starts_with(x, r) OR starts_with(r, x))) > 0)"
ASKS_SQL = " OR ".join(f"regexp_matches(q, '{p}')" for p in (x.replace(r"(?=\s|[?？.]|$)", r"(?:\s|[?？.]|$)") for x in questions.RELATION_REQUESTS))
FACETS_SQL = " || ".join(f"CASE WHEN len(list_filter({_list(terms)}, lambda t: contains(q, t))) > 0 THEN '{name}|' ELSE '' END" for name, terms in guidance.FACETS.items())


@query(f"""WITH {SPOKEN_SQL}, c AS (SELECT doc_id, k, q, {CONCEPTS_SQL} AS c FROM q)
SELECT doc_id, k::INT AS k, {_digest_sql('c')} AS concepts, len({RELATED_SQL})::INT AS n_relations, (({ASKS_SQL}) AND len({RELATED_SQL}) > 0) AS asks_relation, {FACETS_SQL} AS facets,
       len(list_filter({_list(guidance.ALL_TERMS)}, lambda t: contains(q, t)))::INT AS n_terms FROM c""")
def concept_rules(spark, sf_dir):
    q, c = F.col("q"), F.col("c")
    df = spoken(spark, sf_dir).withColumn("c", questions.concepts(q, endings=ENDINGS, scaffold=("그리고",))).withColumn("t", guidance.asked_terms(q))
    facets = F.array_join(F.transform(guidance.named_facets(F.col("t")), lambda f: F.concat(f, F.lit("|"))), "")
    return df.select("doc_id", "k", _digest(c).alias("concepts"), F.size(questions.relations(c)).alias("n_relations"), questions.asked_relation(q, c).isNotNull().alias("asks_relation"), facets.alias("facets"), F.size("t").alias("n_terms"))


SPAN = "([0-9]+)마디부터 ([0-9]+)마디"


@query(f"""WITH {SPOKEN_SQL},
p AS (SELECT *, regexp_extract_all(q, '{SPAN}', 1) AS a, regexp_extract_all(q, '{SPAN}', 2) AS b, regexp_extract_all(regexp_replace(q, '{SPAN}', ' ', 'g'), '([0-9]+)마디', 1) AS c FROM q),
r AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE a[i] || '-' || b[i] END) || c AS parts, list_max(list_transform(b || c, lambda x: x::INT)) AS last FROM p)
SELECT doc_id, k::INT AS k, coalesce(list_aggregate(parts, 'string_agg', ', '), 'general / no specific measure') AS ranges, CASE WHEN last > 3 THEN 'outside_selection' END AS breach,
       len(regexp_extract_all(regexp_replace(regexp_replace(q, '{SPAN}(?:부터|까지|에서|에는|의|는|를)?', ' ', 'g'), '[0-9]+마디(?:부터|까지|에서|에는|의|는|를)?', ' ', 'g'), '[^ ]+'))::INT AS n_words_left FROM r""")
def question_parts(spark, sf_dir):
    """Measures that a sentence names, whether they lie in the selected measures 1 to 3, and what is left of it without them."""
    q = F.col("q")
    selected = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    left = F.regexp_extract_all(questions.without_measures(q), F.lit("[^ ]+"), F.lit(0))
    return spoken(spark, sf_dir).select("doc_id", "k", R.formatted(questions.question_ranges(q)).alias("ranges"), questions.contract(q, selected).alias("breach"), F.size(left).alias("n_words_left"))


def _named(terms) -> str:
    return f"len(list_filter({_list(terms)}, lambda t: contains(q, t))) > 0"


def _begins(terms, either: bool = True) -> str:
    return f"len(list_filter({_list(terms)}, lambda t: starts_with(x, t){' OR starts_with(t, x)' if either else ''})) > 0"


@query(f"""WITH {SPOKEN_SQL}, c AS (SELECT doc_id, k, q, list_distinct({CONCEPTS_SQL}) AS c, contains(q, '{guidance.IDIOM}') AS idiom, {_named(guidance.WHOLE_PIECE_TERMS)} AS whole FROM q),
f AS (SELECT *, list_filter(c, lambda x: NOT ({_begins(guidance.GENERIC_PREFIXES)} OR (idiom AND {_begins(guidance.IDIOM_PREFIXES, False)}) OR (whole AND {_begins(guidance.ALL_TERMS)}))) AS special,
  list_filter(c, lambda x: {_begins(guidance.SUBJECT_PREFIXES, False)}) AS subject,
  list_transform(list_filter({_list(guidance.ALL_TERMS)}, lambda t: contains(q, t)), lambda t: {' || '.join(f"CASE WHEN t IN ({_list(terms)[1:-1]}) THEN ['{name}'] ELSE [] END" for name, terms in guidance.FACETS.items())}) AS facets FROM c)
SELECT doc_id, k::INT AS k, len(c) > 0 AND len(special) = 0 AND ({_named(guidance.SUBJECT_TERMS)} OR idiom OR len(subject) > 0) AND {_named(guidance.ADVICE_TERMS)}
  AND NOT (whole AND len(facets) > 0 AND regexp_matches(q, '{guidance.ONE_SLOT}') AND len(list_filter(facets, lambda a: len(list_filter(facets, lambda b: NOT list_has_any(a, b))) > 0)) = 0) AS broad FROM f""")
def broad_question_rules(spark, sf_dir):
    q = F.col("q")
    df = spoken(spark, sf_dir).withColumn("c", questions.concepts(q, endings=ENDINGS, scaffold=("그리고",)))
    return df.select("doc_id", "k", guidance.asks_broadly(q, F.col("c")).alias("broad"))


def records_of(documents: DataFrame) -> DataFrame:
    """Documents as evidence records: the source says the lineage, the length the measures."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).cast("int"), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, ("expert_annotation", "web_database", "sumijo_feedback", "web_coaching"))), number % 4 + 1)
    start = (F.col("n_chars") % 40 + 1).cast("int")
    some = F.col("n_chars") % 3 > 0
    ranges = F.when(some, F.array(F.struct(start.alias("start"), (start + 3).alias("end")))).otherwise(F.array().cast(R.RANGES))
    status = F.when(F.col("n_chars") % 11 == 0, "unspecified").when(some, "specific").otherwise("whole_piece")
    out = documents.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), kind.alias("evidence_type"), F.coalesce("lang", F.lit("")).alias("piece"), F.coalesce("source", F.lit("")).alias("topic"), F.lit(None).cast("string").alias("question"),
        F.coalesce("text", F.lit("")).alias("answer"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("array<string>").alias("retrieval_aliases"), F.array("lang").alias("source_ids"), ranges.alias("measure_range"), status.alias("measure_status"),
        F.when(some, "local").otherwise("global").alias("measure_scope"),
    )
    return corpus.texts(out)


REQUESTS_SQL = f"""
r AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), '')::INT, 0) % 4 AS kind, coalesce(lang, '') AS piece, (n_chars % 40 + 1) AS s, n_chars % 3 > 0 AS has_range, n_chars % 11 = 0 AS vague,
      list_filter({TOKENS_SQL}, lambda t: {KEPT_SQL}) AS t FROM (SELECT * REPLACE (concat_ws(chr(10), nullif(source, ''), text) AS text) FROM documents)),
b AS (SELECT item_id, item_id % 3 = 1 AS ranged, item_id % 5 = 0 AS only_en, list_distinct(list_filter({TOKENS_SQL}, lambda t: {KEPT_SQL})) AS c FROM benchmark),
lineage AS (SELECT 0 AS l, * FROM r WHERE kind = 2 UNION ALL SELECT 1, * FROM r WHERE kind < 2),
own AS (SELECT l, id, unnest(list_distinct(t)) AS d FROM lineage),
words AS (SELECT DISTINCT unnest(c) AS w FROM b), vocab AS (SELECT DISTINCT d FROM own),
fits AS (SELECT w, d FROM words, vocab WHERE w = d OR (length(w) >= 4 AND length(d) >= 4 AND abs(length(w) - length(d)) <= 3 AND (starts_with(w, d) OR starts_with(d, w)))),
hits AS (SELECT l, item_id, id, count(DISTINCT w) AS n FROM (SELECT item_id, unnest(c) AS w FROM b) JOIN fits USING (w) JOIN own USING (d) GROUP BY ALL),
stats AS (SELECT l, count(*) AS n, avg(len(t)) AS mean FROM lineage GROUP BY l),
df AS (SELECT l, d AS w, count(*) AS df FROM own GROUP BY ALL),
cand AS (
  SELECT h.l, h.item_id, x.*, b.c, b.ranged, (x.s <= 20 AND 10 <= x.s + 3 AND x.has_range) AS meets FROM hits h JOIN b USING (item_id) JOIN lineage x ON x.id = h.id AND x.l = h.l
  WHERE h.n = len(b.c) AND (NOT only_en OR piece = 'en') AND NOT (ranged AND vague)),
text AS (
  SELECT l, item_id, id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / mean))) ELSE 0 END) AS text_score
  FROM (SELECT l, item_id, id, len(t) AS dl, w, len(list_filter(t, lambda x: x = w)) AS tf FROM (SELECT l, item_id, id, t, unnest(c) AS w FROM cand)) JOIN stats USING (l) LEFT JOIN df USING (l, w) GROUP BY ALL),
boost AS (
  SELECT cand.*, text_score, CASE WHEN NOT ranged THEN CASE WHEN kind = 0 THEN 1.0 WHEN vague THEN 0.0 WHEN NOT has_range THEN 1.5 ELSE 0.75 END WHEN NOT has_range THEN 0.25 WHEN meets THEN 5.0 ELSE -1.0 END AS m,
         CASE WHEN NOT ranged THEN CASE WHEN vague THEN 'unspecified_scope' WHEN has_range THEN 'local_example' ELSE 'general_evidence' END WHEN NOT has_range THEN 'global_context' WHEN meets THEN 'overlaps_query_range' ELSE 'other_range_context' END AS scope
  FROM cand JOIN text USING (l, item_id, id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY l, item_id ORDER BY CASE scope WHEN 'overlaps_query_range' THEN 3 WHEN 'global_context' THEN 2 ELSE 1 END DESC, text_score + m DESC, text_score DESC, id DESC) AS place FROM boost QUALIFY place <= 24),
told AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE scope WHEN 'other_range_context' THEN 2 WHEN 'global_context' THEN 1 ELSE 0 END, CASE kind WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, l, place) AS rank FROM placed QUALIFY rank <= 5),
shown AS (SELECT * FROM told QUALIFY scope <> 'other_range_context' OR row_number() OVER (PARTITION BY item_id, scope ORDER BY rank) <= 2)"""


def _answers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    selected = F.when(F.col("item_id") % 3 == 1, F.array(F.struct(F.lit(10).alias("start"), F.lit(20).alias("end"))))
    piece = F.when(F.col("item_id") % 5 == 0, "en")
    asked = t.benchmark.select(F.col("item_id").cast("string").alias("request_id"), F.col("text").alias("question"), selected.alias("ranges"), piece.alias("piece"), F.lit(None).cast("string").alias("topic"), F.lit(5).alias("top_k"), F.lit(None).cast("array<string>").alias("anchors"))
    return batch.answer(records_of(t.documents), asked)


@query(f"""WITH {REQUESTS_SQL}
SELECT item_id::VARCHAR AS request_id, id, scope AS scope_match, CASE scope WHEN 'overlaps_query_range' THEN 'selected_range_support' WHEN 'global_context' THEN 'general_context' WHEN 'other_range_context' THEN 'other_range_context_only'
       WHEN 'general_evidence' THEN 'general_support' WHEN 'unspecified_scope' THEN 'unconfirmed_scope_support' ELSE 'local_example' END AS role,
       CASE WHEN has_range THEN s::VARCHAR || '-' || (s + 3)::VARCHAR ELSE 'general / no specific measure' END AS measures, round(text_score, 5) AS text_score, rank::INT AS rank FROM shown""")
def request_table_answers(spark, sf_dir):
    """Every benchmark passage as a request to the documents as records: those that have all of its concepts, by scope, authority and score."""
    return _answers(spark, sf_dir)[0].select("request_id", "id", "scope_match", "role", "measures", F.round("text_score", 5).alias("text_score"), "rank")


@query(f"WITH {REQUESTS_SQL} SELECT item_id::VARCHAR AS request_id, 'no_corpus_evidence' AS reason FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM shown)")
def request_table_reasons(spark, sf_dir):
    return _answers(spark, sf_dir)[1]
