"""Reading what extractors return, and repairing it. These scan strings and run as Arrow UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def repaired_subject(subject: str | None, fact: str | None) -> str | None:
    """The subject, or, where it names no one, the last capitalised phrase after a preposition, else the first capitalised
    word that does not begin the fact."""
    if subject is None or fact is None:
        return subject
    low = subject.strip().lower()
    if not any(low == d or (" " in d and low.startswith(d)) for d in R.DEGENERATE_SUBJECTS):
        return subject
    lower, best = fact.lower(), (-1, "")
    for word in R.SUBJECT_PREPOSITIONS:
        at = lower.rfind(word)
        while at > 0 and lower[at - 1] != " ":
            at = lower.rfind(word, 0, at)
        if at < 0:
            continue
        phrase = []
        for w in fact[at + len(word) :].split()[:3]:
            if not w[0].isupper():
                break
            phrase.append(w)
        name = " ".join(phrase).rstrip(_MARKS)
        if len(name.encode()) > 2 and at > best[0]:
            best = (at, name)
    if best[1]:
        return best[1]
    for w in fact.split()[1:]:
        clean = w.strip("".join(c for c in w if not c.isalnum()))
        if w[0].isupper() and w not in R.SUBJECT_SKIP and len(clean.encode()) > 1:
            return clean
    return subject


def repaired_json(text: str | None) -> str | None:
    """JSON that ends in the middle, closed after its last whole value; null if that does not help."""
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    stack, quoted, escaped, whole = [], False, False, []
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (not escaped and c == "\\")
            continue
        if c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
        if c in "]},":
            whole.append((i + (c != ","), "".join(reversed(stack))))
    for end, closing in reversed(whole):
        try:
            json.loads(text[:end] + closing)
            return text[:end] + closing
        except ValueError:
            continue
    return None


def parsed_facts(text: str | None, most: int = 12) -> list[dict]:
    """Facts of an extractor's answer: objects with text and subject, plain strings, or lines; half as many after a repair."""
    whole = None
    opened = [k for k in ((text or "").find("["), (text or "").find("{")) if k >= 0]
    start = min(opened, default=-1)
    if start >= 0:
        body = text[start:]
        try:
            whole = json.loads(body)
        except ValueError:
            fixed = repaired_json(body)
            whole, most = (json.loads(fixed) if fixed else None), max(1, most // 2)
    if isinstance(whole, dict):
        whole = whole.get("facts")
    if isinstance(whole, list):
        rows = [{"text": x.get("text") or x.get("fact"), "subject": x.get("subject")} if isinstance(x, dict) else {"text": str(x), "subject": None} for x in whole]
    else:
        rows = [{"text": x.strip().lstrip("-*• ").strip(), "subject": None} for x in (text or "").split("\n")]
    return [r for r in rows if r["text"] and len(r["text"].encode()) > 5][:most]


def repair_subject(subject: Column, fact: Column) -> Column:
    @F.pandas_udf("string")
    def run(subject: pd.Series, fact: pd.Series) -> pd.Series:
        return pd.Series([repaired_subject(s, f) for s, f in zip(subject, fact, strict=True)], dtype=object)

    return run(subject, fact)


def repair_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([repaired_json(t) for t in text], dtype=object)

    return run(text)


def parse_facts(text: Column) -> Column:
    @F.pandas_udf("array<struct<text:string,subject:string>>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([parsed_facts(t) for t in text], dtype=object)

    return run(text)


def model_names(body: Column) -> Column:
    """Names in a provider's list of models, in either of the two shapes in use."""
    data = F.from_json(body, "data array<struct<id:string>>")["data"]
    models = F.from_json(body, "models array<struct<name:string>>")["models"]
    return F.coalesce(F.transform(data, lambda m: m["id"]), F.transform(models, lambda m: m["name"]), F.array().cast("array<string>"))
