"""Quality rules as a bitmask ledger (operator 9).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule, so that policies (versioned masks) and ablations are bit arithmetic over the written ledger and
never read a text again.

Defined cases: a null text has no words; null ids pass through; repeated rows are judged one by one;
an empty table gives an empty ledger; other columns of the input are ignored by ledger(), whatever their
names, and kept by keep_good().
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_add, arrow_map, saved, unused

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
_ONLY_SYMBOLS = str.maketrans("", "", SYMBOLS)
_NO_SPACE = str.maketrans("", "", " \t\n\v\f\r")
_WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A named predicate over the measurements; true where the document fails."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: Bits are never reused: a rule that is given up keeps its bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_density", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document goes if it fails any of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {r.name: r.mask for r in RULES}
        return sum(known[n] for n in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
DEFAULT = Policy("default-1", tuple(r.name for r in RULES))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at exactly the six ASCII white space bytes
    n = len(words)
    lines = [x for x in text.split("\n") if x.translate(_NO_SPACE)]
    repeated = 0
    if n > _WINDOW:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        windows = list(zip(*(ids[i:] for i in range(_WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + _WINDOW - max(i, upto)
                    upto = i + _WINDOW
    return (n, len(text.translate(_NO_SPACE)), len(text) - len(text.translate(_ONLY_SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated)


def _bits(rules: tuple[Rule, ...]) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = F.lit(0).cast("long")
    for b in bits:
        total = total.bitwiseOR(b)
    return total


def _columns(texts: list[str | None]) -> list[list]:
    return [list(c) for c in zip(*map(measure, texts), strict=True)] or [[] for _ in MEASURES]


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    run = lambda rows: {"doc_id": rows["doc_id"], **dict(zip(MEASURES, _columns(rows["text"]), strict=True))}
    return arrow_map(docs.select("doc_id", "text"), schema, run).withColumn("fail_bits", _bits(rules))


def row_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the rows it belongs to: row (a struct of all columns of docs), the measurements and fail_bits.

    Once written, a policy or an ablation reads its few columns only, and the rows a policy keeps need no join.
    """
    names = {m: unused(m, docs.columns) for m in MEASURES}
    told = arrow_add(docs, "text", ", ".join(f"{n} long" for n in names.values()), _columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return told.select(row, *[F.col(n).alias(m) for m, n in names.items()]).withColumn("fail_bits", _bits(rules))


def failed(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def verdicts(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with kept and policy_version under one policy; no text is read."""
    return led.withColumns({"kept": ~failed(policy), "policy_version": F.lit(policy.version)})


def ablation(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: failing rows, and rows that only this rule removes. One pass over the ledger."""
    used = [r for r in RULES if r.name in policy.rules]
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count(F.when(hit.bitwiseAND(F.lit(r.mask).cast("long")) != 0, 1)).alias(f"f{r.bit}") for r in used]
    sums += [F.count(F.when(hit == r.mask, 1)).alias(f"o{r.bit}") for r in used]
    one = led.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit != 0, 1)).alias("gone"), *sums)
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in used]
    each = one.select("n", "gone", F.explode(F.array(*rows)).alias("r"))
    return each.select(F.lit(policy.version).alias("policy_version"), "r.rule", "r.n_failed", "r.n_only", F.col("gone").alias("n_removed"), (F.col("gone") - F.col("r.n_only")).alias("n_removed_without"), F.col("n").alias("n_rows"))


def union_of_failures(led: DataFrame, *keys: str) -> DataFrame:
    """Which rules fail at least once, and which fail in every row, by key: bitwise OR and AND of the bits."""
    return led.groupBy(*keys).agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"), F.count(F.lit(1)).alias("n_rows"))


def keep_good(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of docs that the policy keeps, all columns as they were, by the bits of the written ledger."""
    return saved(row_ledger(docs), "quality-ledger").where(~failed(policy)).select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger is written once; two versions of the policy are read from its bits."""
    from .common import documents

    led = verdicts(saved(ledger(documents(spark, sf_dir)), "quality-ledger"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed(BASE).alias("base_failed"), "kept", "fail_bits")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {
    "op9_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), r AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), m AS (
  SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid
), x AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(m.c, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN m USING (rid)
), y AS (
  SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM x
), z AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
           + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
           + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM y
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM z
"""
}
