"""Text expressions: tokens, variants, identifiers, and the screening normaliser."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token pattern and the particles that documents and concepts shed.
TOKEN = r"[0-9]+|[A-Za-zÀ-ÖØ-öø-ÿ]+|[가-힣]+"
PARTICLES = (
    "에게서", "으로는", "에서는", "부터는", "까지는", "은요", "는요", "이요", "가요", "도요", "이랑", "하고", "으로", "에서", "에게", "부터", "까지", "은", "는", "이", "가", "을", "를", "의", "와", "과", "랑", "에", "도", "만", "로",
)
CONCEPT_ONLY_PARTICLES = ("마다",)
HANGUL = re.compile("[가-힣]")
KEPT_LETTERS = ("p", "f")
#: The tokens of a text without Hangul that is_kept() keeps. Particles, forms and variants change nothing in such a text.
PLAIN_TOKEN = rf"[0-9]+|[A-Za-zÀ-ÖØ-öø-ÿ]{{2,}}|[{''.join(KEPT_LETTERS)}]"
NORMAL_FORMS = {
    "딕션": "발음", "관할권별": "관할권", "파트": "반주", "박의": "박자", "나타내는": "나타낸", "바뀌": "변화", "바뀌는": "변화",
    "바뀌나요": "변화", "달라지": "변화", "달라지는지": "변화", "달라지나요": "변화",
}
STEM_ENDINGS = ("이에요|예요|에요|인가요|입니까|일까요", "하려면", "할지", "할까", "해야", "하")


def tokens(text: Column) -> Column:
    """Digit, Latin and Hangul runs of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip_particles(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Hangul words of two syllables or more without the particle they end in."""
    endings = "|".join(sorted((*PARTICLES, *extra), key=len, reverse=True))
    # a particle ends its word, so what no match from the word's begin finds, no later one does
    return F.regexp_replace(text, rf"(?U)(?=[가-힣])(?<![가-힣])([가-힣]{{2,}}?)(?:{endings})\b", "$1")


def normalised(token: Column, forms: dict[str, str] = NORMAL_FORMS) -> Column:
    """The token's normal form. token is written out twice, so let it be a column or a lambda's variable."""
    table = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
    return F.when(token.isin(*forms), F.element_at(table, token)).otherwise(token)


def is_kept(token: Column) -> Column:
    return (F.length(token) > 1) | token.rlike("^[0-9]$") | token.isin(*KEPT_LETTERS)


def grams(token: Column, n: int) -> Column:
    """The pieces of n characters of a longer token; none of others."""
    pieces = F.regexp_extract_all(token, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(token) > n, pieces).otherwise(F.array().cast("array<string>"))


def token_grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """The grams() of all tokens of a text, with repeats: at each place the piece of one kind of letter that has a further one before or behind it."""
    low = F.lower(text)
    kinds = TOKEN.replace("+", "").split("|")

    def pieces(n: int) -> Column:
        within = "|".join(f"{k}{{{n}}}(?={k})|(?<={k}){k}{{{n}}}" for k in kinds)
        return F.regexp_extract_all(low, F.lit(f"(?=({within}))"), F.lit(1))

    return F.concat(*map(pieces, sizes))


def variants(token: Column) -> Column:
    """A Hangul token with its pieces of two and three syllables, distinct, in order; other tokens alone."""
    longer = (F.length(token) > 2) & token.rlike("^[가-힣]+$")
    return F.when(longer, F.array_distinct(F.concat(F.array(token), grams(token, 2), grams(token, 3)))).otherwise(F.array(token))


def document_tokens(text: Column) -> Column:
    """Tokens of a document, with repeats: particles off, forms normalised, single letters dropped, variants added."""
    found = F.transform(F.regexp_extract_all(strip_particles(F.lower(text)), F.lit(TOKEN), F.lit(0)), lambda t: normalised(t))
    return F.when(has_hangul(text), F.flatten(F.transform(F.filter(found, is_kept), variants))).otherwise(plain_tokens(text))


def plain_tokens(text: Column) -> Column:
    """document_tokens() of a text without Hangul, by one pattern and no step a token."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN_TOKEN), F.lit(0))


def stem(token: Column) -> Column:
    """Without a question ending; the first pattern that fits the whole token. A token is held against the patterns only if its last syllable is one of theirs."""
    last = sorted({e[-1] for endings in STEM_ENDINGS for e in endings.split("|")})
    out = F.when(~F.right(token, F.lit(1)).isin(*last), token)
    for k, ending in enumerate(STEM_ENDINGS):
        least = "{2,}?" if k == 0 else "{2,}"
        pattern = f"^([가-힣]{least})(?:{ending})$"
        out = out.when(token.rlike(pattern), F.regexp_extract(token, pattern, 1))
    return out.otherwise(token)


def query_tokens(text: Column, scaffold: tuple[str, ...] = (), scaffold_endings: tuple[str, ...] = ()) -> Column:
    """Groups of variants, one for each distinct token of a question that isn't scaffolding."""
    found = F.transform(F.transform(tokens(text), lambda t: normalised(t)), stem)  # one at a time: a nested call is written out at each mention
    found = F.array_distinct(F.filter(found, is_kept))
    if scaffold:
        found = F.filter(found, lambda t: ~t.isin(*scaffold))
    if scaffold_endings:
        endings = "|".join(map(re.escape, scaffold_endings))
        found = F.filter(found, lambda t: ~((F.length(t) > 2) & t.rlike(f"(?:{endings})$")))
    return F.transform(found, variants)


def any_of(terms) -> str:
    """A pattern of the terms by their first letters, eight letters a branch, the longest term that fits first. An empty term is everywhere."""
    if "" in terms:
        return ""
    first = sorted({t[0] for t in terms})
    rest = lambda c: "|".join(map(re.escape, sorted({t[1:] for t in terms if t[0] == c}, key=len, reverse=True)))
    letters = [first[k : k + 8] for k in range(0, len(first), 8)]
    return "|".join(f"(?=[{re.escape(cs[0])}-{re.escape(cs[-1])}])(?:{'|'.join(f'{re.escape(c)}(?:{rest(c)})' for c in cs)})" for cs in letters)


def names_any(text: Column, terms) -> Column:
    return text.rlike(any_of(terms)) if terms else F.lit(False)


def begins(word: Column, terms) -> Column:
    return word.rlike(f"^(?:{any_of(terms)})")


def begins_either_way(word: Column, terms) -> Column:
    return word.isin(*sorted({t[:n] for t in terms for n in range(len(t) + 1)})) | begins(word, terms)


def concept_matches(concept: Column, known: Column) -> Column:
    """Equal, or one begins the other with lengths that differ little: by 2 for Hangul of 2 up, else by 3 for 4 up."""
    hangul = concept.rlike("^[가-힣]+$")
    least, more = F.when(hangul, 2).otherwise(4), F.when(hangul, 2).otherwise(3)
    # few words begin alike, so the lengths of the others aren't looked at
    near = F.exists(known, lambda d: (F.startswith(concept, d) | F.startswith(d, concept)) & (F.length(d) >= least) & (F.abs(F.length(concept) - F.length(d)) <= more))
    return F.array_contains(known, concept) | ((F.length(concept) >= least) & near)


def all_covered(wanted: Column, known: Column) -> Column:
    return (F.size(wanted) > 0) & F.forall(wanted, lambda c: concept_matches(c, known))


def coverage(wanted: Column, known: Column) -> Column:
    """The share of wanted concepts that known supports; 0 for none wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda c: concept_matches(c, known))) / F.size(wanted)).otherwise(0.0)


def alias_score(query: Column, aliases: Column) -> Column:
    """aliases: array of concept arrays. The best of |query| / |alias|, at most 1, over aliases that cover the query."""
    scores = F.transform(F.filter(aliases, lambda a: all_covered(query, a)), lambda a: F.least(F.lit(1.0), F.size(query) / F.greatest(F.lit(1), F.size(a))))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def joined_text(*parts: Column) -> Column:
    """Parts that aren't blank, one a line."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(F.trim(p), F.lit("")) != ""), "\n")


def content_id(*parts: Column, size: int = 16, prefix: str = "") -> Column:
    """A short identifier of the parts: the first size hex digits of their SHA-256, NUL between them."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, size))


def hash_mod(text: Column, n: Column, salt: str = "") -> Column:
    """The first 8 bytes, big-endian, of SHA-256(salt + text) modulo n."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), text), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % n.cast("decimal(20,0)")).cast("long")


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")


def strip_thinking(text: Column) -> Column:
    """Without closed think blocks, without what stands before a lone end or after a lone begin of one."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?is)^.*</think>", "")
    return F.trim(F.regexp_replace(out, r"(?is)<think>.*$", ""))


def clean_translation(text: Column) -> Column:
    """The first line that isn't blank, without a label or one pair of quotes."""
    out = F.regexp_extract(strip_thinking(text), r"(?m)^[ \t]*(\S.*)$", 1)
    out = F.trim(F.regexp_replace(out, r"(?i)^(?:korean\s+)?(?:translation|번역)\s*[:：]\s*", ""))
    return F.when(F.length(out) >= 2, F.regexp_replace(out, r"^[\"“'‘](.*)[\"”'’]$", "$1")).otherwise(out)


def sentences(text: Column) -> Column:
    """Parts at sentence ends followed by white space, and at line ends; blank ones dropped."""
    return F.filter(F.split(text, r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.trim(s) != "")


def folded(x: str | None) -> str | None:
    """NFKC, invisible characters dropped, white space squeezed, case folded."""
    if x is None:
        return None
    x = "".join(ch for ch in unicodedata.normalize("NFKC", x) if ch.isspace() or unicodedata.category(ch) not in ("Cf", "Cc"))
    return re.sub(r"\s+", " ", x).strip().casefold()


@F.pandas_udf(T.StringType())
def screen_form(text: pd.Series) -> pd.Series:
    """folded() of each text. Spark has no native NFKC or case folding."""
    return text.map(folded)


@F.pandas_udf(T.ArrayType(T.StringType()))
def screen_forms(texts: pd.Series) -> pd.Series:
    """folded() of each string of each array."""
    return texts.map(lambda strings: [folded(x) for x in strings] if strings is not None else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(document: pd.Series) -> pd.Series:
    """Every string in a JSON document, keys as well as values, at any depth; the text itself if it isn't JSON."""

    def walk(value: object) -> list[str]:
        if isinstance(value, str):
            return [value]
        if isinstance(value, dict):
            return [s for k, v in value.items() for s in (*walk(k), *walk(v))]
        return [s for v in value for s in walk(v)] if isinstance(value, list) else []

    def one(x: str | None) -> list[str]:
        try:
            return walk(json.loads(x)) if x is not None else []
        except (ValueError, RecursionError):
            return [x]

    return document.map(one)


@F.pandas_udf(T.StringType())
def canonical_sha256(document: pd.Series) -> pd.Series:
    """SHA-256 of a JSON document with sorted keys and no spaces."""
    import hashlib

    def one(x: str | None) -> str | None:
        return None if x is None else "sha256:" + hashlib.sha256(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return document.map(one)


def untrusted_json(value: Column) -> Column:
    """A struct as JSON data in which no markup or chat delimiter is left in the clear."""
    out = F.to_json(value, {"ignoreNullFields": "false"})
    for plain, coded in (("<", "\\u003c"), (">", "\\u003e"), ("[INST]", "\\u005bINST\\u005d"), ("[/INST]", "\\u005b/INST\\u005d")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out
