"""Secret scan (operator 5): keyword automaton, anchored patterns near its hits, checksum validation.

An Aho-Corasick automaton over the ASCII-lower-cased text finds the keywords; a pattern is tried only
at the place of a hit. Bare hexadecimal runs have no keyword: any run of 24 or more must cover one of
every 24 positions, so those positions are its hits and the run is grown from there. Token kinds that
carry a checksum (six base-62 digits of the CRC-32 of the thirty characters before) count only where
the checksum holds.

Defined cases: a null text is empty; null ids pass through; repeated rows are scanned one by one;
positions are code points, ends exclusive; a failing match (too short, wrong checksum) still consumes
its characters; other columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_add, arrow_map, documents, unused

#: In the order that breaks ties of equal starts. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
_HEX_RUN = 24
_NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ANCHORED = {
    "assign": re.compile(_NAME + _TAIL),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "github": re.compile("gh[pousr]_[A-Za-z0-9]+"),
    "npm": re.compile("npm_[A-Za-z0-9]+"),
}
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_LOWER = {c: c + 32 for c in range(65, 91)}
_HEX = frozenset("0123456789abcdef")
_HEX_DIGIT = re.compile("[0-9a-f]")
_HEX_REST = re.compile("[0-9a-f]+")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = None


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def valid(kind: str, m: re.Match) -> bool:
    s = m[0]
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return len(s) >= 20
    body = s[s.index("_") + 1 :]
    return len(body) == 36 and base62_crc(body[:30]) == body[30:]


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 24 or more hexadecimal digits, grown from every 24th position."""
    out, after = [], 0
    for m in _HEX_DIGIT.finditer(text[_HEX_RUN - 1 :: _HEX_RUN]):
        p = m.start() * _HEX_RUN + _HEX_RUN - 1
        if p < after:
            continue
        start = p
        while start > after and text[start - 1] in _HEX:
            start -= 1
        after = _HEX_REST.match(text, p).end()
        if after - start >= _HEX_RUN:
            out.append((start, after))
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    text = text or ""
    found, after = [("hex", s, e) for s, e in hex_runs(text)], dict.fromkeys(_ANCHORED, 0)
    starts = sorted({(end - size + 1, kind) for end, (kind, size) in _AUTOMATON.iter(text.translate(_LOWER) if not text.isascii() else text.lower())})
    for start, kind in starts:
        if start >= after[kind] and (m := _ANCHORED[kind].match(text, start)):
            after[kind] = m.end()
            if valid(kind, m):
                found.append((kind, start, m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every row of docs(doc_id, text)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "spans": spans}

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind: string, start: long, end: long>>", run)


def masked(text: str | None) -> str | None:
    """The text with each secret (overlapping ones as one) replaced by [kind] of its first span."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and, where there is such a column, n_chars counted again. No row goes."""
    name = unused("masked", docs.columns)
    out = arrow_add(docs, "text", f"{name} string", lambda texts: [[masked(t) for t in texts]])
    new = F.col(name)
    cols = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": new}
    if "n_chars" in cols:
        kind = dict(docs.dtypes)["n_chars"]
        cols["n_chars"] = F.when(new == F.col("text"), F.col("n_chars")).otherwise(F.length(new).cast(kind))
    return out.select(*[v.alias(c) for c, v in cols.items()])


def _told(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def _spans_sql(kind: str, order: int, pattern: str, group: int, test: str) -> str:
    """Spans of a pattern in DuckDB: the pieces between matches and the matches give the positions by their lengths."""
    return f"""SELECT rid, '{kind}' AS kind, {order} AS o, s, s + length(x) AS e FROM (
  SELECT rid, m[k] AS x, v[k] AS v, (coalesce(list_sum(list_transform(p[1:k], lambda y: length(y))), 0)
         + coalesce(list_sum(list_transform(m[1:k-1], lambda y: length(y))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p FROM d))) WHERE {test}"""


def _oracle() -> str:
    quoted = lambda p: p.replace("'", "''")
    # CRC-32, bit by bit, of the thirty characters, and its six base-62 digits
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = "list_transform([list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 31), lambda i: ascii(substr(split_part(x, '_', 2), i, 1))::BIGINT)), lambda c0, b: list_reduce(list_prepend(xor(c0, b), range(8)::BIGINT[]), lambda c, j: " + step + "))], lambda z: xor(z, 4294967295::BIGINT))[1]"
    digits = f"array_to_string(list_transform(range(0, 6), lambda i: substr('{_DIGITS}', (({crc}) // (62 ** (5 - i))::BIGINT) % 62 + 1, 1)), '')"
    sums = f"CASE WHEN length(split_part(x, '_', 2)) = 36 AND length(x) = 36 + position('_' IN x) THEN substr(split_part(x, '_', 2), 31) = {digits} ELSE false END"
    parts = [
        _spans_sql("assign", 0, quoted(_NAME + _TAIL), 1, "length(v) >= 6"),
        _spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, "length(x) >= 20"),
        _spans_sql("hex", 2, "[0-9a-f]+", 0, "length(x) >= 24"),
        _spans_sql("github", 3, "gh[pousr]_[A-Za-z0-9]+", 0, sums),
        _spans_sql("npm", 4, "npm_[A-Za-z0-9]+", 0, sums),
    ]
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS (\n"
        + "\nUNION ALL\n".join(parts)
        + """
), a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM s GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES = {"op5_secret_scan": _oracle()}
