"""Rules over texts as Column expressions; all stay within the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def formatted_number(n: Column) -> Column:
    """A whole number with a comma between thousands."""
    return F.format_number(n, 0)


def formatted_bytes(n: Column) -> Column:
    """Bytes in the largest unit that they fill, with one decimal."""
    in_unit = lambda size, name: F.format_string(f"%.1f {name}", n / F.lit(float(size)))
    return F.when(n >= 1 << 30, in_unit(1 << 30, "GB")).when(n >= 1 << 20, in_unit(1 << 20, "MB")).when(n >= 1 << 10, in_unit(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


# ---------------------------------------------------------------- PII

_MASKS = {kind: "|".join(f"(?:{p})" for p, k in R.PII_PATTERNS if k == kind) for _, kind in R.PII_PATTERNS}


#: One alternation of all kinds, a group each: at a place the first kind in order wins.
_ALL_MASKS = "|".join(f"({p})" for p in _MASKS.values())
#: Something that every match has, cheap to look for.
_HINT = r"@|\d{3}|(?i:pass|pwd)|sk-|pk_|AKIA|gsk_|xai-|ghp_|glpat-"
#: Noncharacters that stand around the groups of a match until they are named.
_EDGES = "".join(chr(0xFDD0 + i) for i in range(len(_MASKS) + 1))


def pii_mask(text: Column) -> Column:
    """Matches replaced by [MASKED:kind], from the left and without overlaps; where two kinds begin at one place the first in
    the order of the patterns wins. (Noncharacters of a text that has matches become U+FFFD.)"""
    marked = "".join(f"{_EDGES[i]}${i + 1}" for i in range(len(_MASKS))) + _EDGES[-1]
    out = F.regexp_replace(F.translate(text, _EDGES, "\ufffd" * len(_EDGES)), _ALL_MASKS, marked)
    for i, kind in enumerate(_MASKS):
        out = F.regexp_replace(out, f"{_EDGES[: i + 1]}[^{_EDGES[i + 1]}]+{_EDGES[i + 1 :]}", f"[MASKED:{kind}]")
    return F.when(F.rlike(text, F.lit(_HINT)), out).otherwise(text)


def pii_matches(text: Column) -> Column:
    """array<struct<kind, start, end, masked>> of the matches that pii_mask replaces, places in code points, ends exclusive."""
    hit = F.regexp_extract_all(text, F.lit(_ALL_MASKS), F.lit(0))
    kinds = [F.regexp_extract_all(text, F.lit(_ALL_MASKS), F.lit(i + 1)) for i in range(len(_MASKS))]
    between = F.split(text, _ALL_MASKS)
    sizes = lambda parts: F.transform(parts, F.length)
    upto = lambda lengths, n: F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    named = F.zip_with(hit, F.sequence(F.lit(0), F.size(hit) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def told(x: Column) -> Column:
        kind = F.coalesce(*[F.when(F.get(k, x["i"]) != "", F.lit(name)) for k, name in zip(kinds, _MASKS, strict=True)])
        start = upto(sizes(between), x["i"] + 1) + upto(sizes(hit), x["i"])
        return F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(x["h"])).alias("end"), F.concat(F.lit("[MASKED:"), kind, F.lit("]")).alias("masked"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,masked:string>>")
    return F.when(F.size(hit) > 0, F.transform(named, told)).otherwise(none)


def pii_counts(text: Column) -> dict[str, Column]:
    return {kind: F.regexp_count(text, F.lit(p)).cast("long") for kind, p in _MASKS.items()}


def sensitivity(text: Column) -> Column:
    strong = "|".join(f"(?:{p})" for p, k in R.PII_PATTERNS if k in ("api_key", "password"))
    weak = "|".join(f"(?:{p})" for p, k in R.PII_PATTERNS if k not in ("api_key", "password"))
    return F.when(F.rlike(text, F.lit(strong)), "Restricted").when(F.rlike(text, F.lit(weak)), "Private").otherwise("Public")


def allowed_for_provider(sens: Column, local: Column) -> Column:
    """What may be sent: public always, private to local providers, the rest never; an unknown row counts as public."""
    s = F.coalesce(sens, F.lit("Public"))
    return F.when(s == "Public", True).when(s == "Private", local).otherwise(False)


def content_for_provider(content: Column, masked: Column, sens: Column, local: Column) -> Column:
    """The raw text goes to local providers unless it is restricted or blocked; others get the masked text."""
    shown = F.coalesce(masked, content)
    return F.when(sens == "Public", content).when((sens == "Private") & local, content).when(sens == "Private", shown).otherwise(F.lit(None).cast("string"))


# ---------------------------------------------------------------- rewriting, categories


def temporal_phrase(text: Column) -> Column:
    """The first phrase in the order of the patterns, in lower case. Texts without any are told by one look."""
    some = F.rlike(text, F.lit("|".join(f"(?:{p})" for p in R.TEMPORAL_PHRASES)))
    return F.when(some, _first_phrase(text))


def _first_phrase(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.lower(F.trim(F.regexp_extract(text, p, 0))), F.lit("")) for p in R.TEMPORAL_PHRASES])


def reformulate(text: Column, phrase: Column | None = None) -> Column:
    """The text as a statement, or with its temporal phrase in front, or null. phrase: that of the trimmed text, if at hand."""
    t = F.trim(text)
    ruled = [F.when(F.rlike(t, F.lit(p)) & (F.regexp_replace(t, p, to) != t), F.regexp_replace(t, p, to)) for p, to in R.REFORMULATIONS]
    phrase = temporal_phrase(t) if phrase is None else phrase
    return F.when(t == "", F.lit(None).cast("string")).otherwise(F.coalesce(*ruled, F.when(phrase.isNotNull(), F.concat(F.lit("Temporal: "), phrase, F.lit(" — "), t))))


def category(text: Column, lower: Column | None = None) -> Column:
    """lower: the lower-cased text, where it is at hand as a column of its own."""
    lower = F.lower(text) if lower is None else lower
    out = None
    for name, words in R.CATEGORIES:
        out = F.when(_any(lower, words), name) if out is None else out.when(_any(lower, words), name)
    return out.otherwise("Conversation")


def category_parameter(cat: Column, which: str) -> Column:
    at = {"half_life_days": 1, "importance": 2, "actr_d": 3}[which]
    out = None
    for row in R.CATEGORY_PARAMETERS:
        out = F.when(cat == row[0], F.lit(row[at])) if out is None else out.when(cat == row[0], F.lit(row[at]))
    return out.otherwise(F.lit(dict((r[0], r[at]) for r in R.CATEGORY_PARAMETERS)["Default"]))


def source_weight(source: Column) -> Column:
    """Weight of where a text came from."""
    out = None
    for weight, names in R.SOURCE_WEIGHTS:
        out = F.when(source.isin(*names), weight) if out is None else out.when(source.isin(*names), weight)
    return out.otherwise(R.OTHER_SOURCE_WEIGHT)


# ---------------------------------------------------------------- labels


def has_date(lower: Column) -> Column:
    """A month with a year after it (at the month's first place), or an ISO date."""
    months = [F.rlike(F.regexp_extract(lower, f"(?s){m}(.*)", 1), F.lit(r"^\s*\d{4}")) for m in R.MONTHS]
    return reduce(lambda a, b: a | b, months) | F.rlike(lower, F.lit(r"\d{4}-\d{2}-\d{2}"))


def entities(text: Column) -> Column:
    """Capitalised words that do not begin a sentence, in lower case, without common words."""
    # capitalised words whose neighbour before ends no sentence; a colon ends one, but not after the very first word
    inner = F.regexp_extract_all(text, F.lit(r"(?:(?<=[^.!?:\s])\s+|^\s*\S+:\s+)([^\s\p{L}\p{N}]*\p{Lu}\S*)"), F.lit(1))
    clean = F.transform(inner, lambda w: F.regexp_replace(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"('|’)s$", ""))
    common = F.array(*[F.lit(w) for w in R.COMMON_WORDS])
    bare = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
    good = F.filter(clean, lambda w: (F.octet_length(w) >= 2) & F.rlike(w, F.lit(r"^\p{Lu}")) & ~F.array_contains(common, w) & ~F.array_contains(common, bare(w)))
    return F.array_distinct(F.transform(good, F.lower))


def keyword_labels(text: Column, lower: Column | None = None) -> Column:
    """Labels of a stored text, entities last; an array. lower: the lower-cased text, where it is at hand as a column of its own."""
    lower = F.lower(text) if lower is None else lower
    found = []
    for label, words in R.TEXT_LABELS:
        hit = _any(lower, words)
        if label == "temporal:future":
            hit = hit | (has_date(lower) & _any(lower, R.FUTURE_WITH_DATE))
        found.append(F.when(hit, F.lit(label)))
    return F.array_distinct(F.concat(F.array_compact(F.array(*found)), F.transform(entities(text), lambda e: F.concat(F.lit("entity:"), e))))


def query_labels(text: Column) -> Column:
    """Labels of a query by its words."""
    lower = F.lower(text)
    language, natural, programming = _any(lower, R.LANGUAGE_WORDS), _any(lower, R.NATURAL_LANGUAGE), _any(lower, R.PROGRAMMING_LANGUAGE)
    found = [
        F.when(language & (natural | ~programming), F.lit("topic:language:natural")),
        F.when(language & (programming | ~natural), F.lit("topic:language:programming")),
        F.when(language, F.lit("topic:language")),
    ]
    found += [F.when(_any(lower, words), F.lit(label)) for label, words in R.QUERY_LABELS]
    return F.array_compact(F.array(*found))


def long_words(text: Column) -> Column:
    """Words of three bytes or more in lower case."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.octet_length(w) >= 3)


def fingerprints(text: Column) -> Column:
    """The long words of a text, and pairs of those that follow each other."""
    return word_fingerprints(long_words(text))


def word_fingerprints(words: Column) -> Column:
    """The same of an array of long words: as a column of its own the array is made once, not for each place it stands at."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws("_", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


# ---------------------------------------------------------------- facts


def relationship(fact: Column) -> Column:
    """struct<kind, value> of the first relationship that a fact states, or null."""
    out = []
    for kind, pattern in R.RELATIONSHIPS:
        value = F.trim(F.regexp_replace(F.trim(F.regexp_extract(fact, f"(?i){pattern}", 1)), r"[.,;!?]+$", ""))
        out.append(F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("value"))))
    return F.coalesce(*out)


def subject(fact: Column) -> Column:
    first = F.get(F.split(F.regexp_replace(F.trim(fact), r"^(?:The|the|A|a) ", ""), r"\s+"), 0)
    return F.regexp_replace(first, r"[^\p{L}\p{N}]+$", "")


def triple(fact: Column) -> Column:
    rel, who = relationship(fact), subject(fact)
    return F.when(rel.isNotNull() & (who != ""), F.struct(who.alias("subject"), rel["kind"].alias("predicate"), rel["value"].alias("object")))


def subjects_overlap(a: Column, b: Column) -> Column:
    return (subject(a) != "") & (subject(b) != "") & (F.lower(subject(a)) == F.lower(subject(b)))


def fact_rejected(fact: Column) -> Column:
    """Why a fact is not worth keeping, or null."""
    verb = F.rlike(fact, F.lit(r" (?:" + "|".join(R.FACT_VERBS) + r") |ing$|'s |'m "))
    noise = reduce(lambda a, b: a | b, [F.startswith(F.lower(fact), F.lit(p)) for p in R.FACT_NOISE])
    return F.when(F.octet_length(fact) < 15, "too short").when(~verb, "no verb").when(noise, "noise")


def max_facts(text: Column) -> Column:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    few = F.least(F.greatest(F.floor(n / 10), F.lit(1)), F.lit(3))
    many = F.least(F.greatest(F.floor(n / 20), F.lit(3)), F.lit(12))
    return F.when(n < 30, few).otherwise(many).cast("int")


def co_occurrence(text: Column) -> Column:
    """0.05 where two databases or two programming languages are named."""
    lower = F.lower(text)
    many = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w))) >= 2
    return F.when(many(R.DATABASE_WORDS) | many(R.PROGRAMMING_WORDS), 0.05).otherwise(0.0)


def entity_id(name: Column, namespace_hex: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5) of the lower-cased, trimmed name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(F.lower(F.trim(name)), "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
