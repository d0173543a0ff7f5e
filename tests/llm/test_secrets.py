import hashlib
import random
import re
from collections import Counter

from anamnesis.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
TOKENS = (("github", re.compile("gh[pousr]_[A-Za-z0-9]+")), ("npm", re.compile("npm_[A-Za-z0-9]+")))


def signed(prefix: str, body: str) -> str:
    return prefix + body + S.base62_crc(body)


GOOD = signed("ghp_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
NPM = signed("npm_", "Zz0Yy1Xx2Ww3Vv4Uu5Tt6Ss7Rr8Qq9")
TEXTS = [
    None, "", "nothing here", "PassWord = 'hunter22x' and token:abcdef", "token = abc", "api_key=api_key=longenough", "secret\": \"s3cr3t-value\"", "passwd==abcdefgh",
    "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "xAKIAKIA" + "Z" * 20, "0123456789abcdef01234567", "0123456789abcdef0123456", "g" + "a" * 100 + "g" + "f" * 24, f"use {GOOD} now", f"use {GOOD[:-1]}{'0' if GOOD[-1] != '0' else '1'} now",
    f"token={GOOD}", f"{NPM} {NPM}", NPM + "x", "é token: ünicode ſecret=abcdefgh toKen=abcdefg", "tokentoken=abcdefghi", "password:\nabcdefgh", "x" * 200_000 + " secret=abcdefgh " + "0" * 30 + " y" * 50_000, "token = " + "A" * 100_000,
]


def plain(text):
    """All spans by whole-text regular expressions."""
    t = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    for kind, p in TOKENS:
        for m in p.finditer(t):
            body = m[0].split("_", 1)[1]
            if len(body) == 36 and S.base62_crc(body[:30]) == body[30:]:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], S.KINDS.index(x[0])))


def test_spans_equal_whole_text_patterns():
    r = random.Random(2)
    bits = ["password", "PASSWD", "token", "api", "_", "key", "=", ":", " ", "'", '"', "abcdef", "AKIA", "A0B1", "0a1b2c3d", "x", "\n", "é", "ghp_", GOOD, "K", "ı"]
    texts = TEXTS + ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert S.find_spans(t) == plain(t), t


def test_base62_crc_is_of_six_digits():
    assert len(GOOD) == 40 and S.base62_crc("") == "000000" and all(len(S.base62_crc(str(i))) == 6 for i in range(999))


def test_query_columns_and_defined_cases(spark, tmp_path):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n_hex").write.parquet(f"{tmp_path}/documents.parquet")
    told = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    want = Counter()
    for i, t in rows:
        spans = plain(t)
        base = [x for x in spans if x[0] in S.BASE_KINDS]
        n = Counter(k for k, _, _ in base)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(told(base).encode()).hexdigest(), told(spans)] += 1
    got = S.op5_secret_scan(spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert Counter(map(tuple, got)) == want


def test_masked_texts(spark):
    assert S.masked("a token=abcdefgh, b") == "a [assign], b" and S.masked(None) is None and S.masked("") == ""
    assert S.masked(f"token={GOOD} end") == "[assign] end"
    docs = spark.createDataFrame([(1, "secret=abcdefgh", 15, "a"), (None, None, None, "b"), (2, "", 0, "c"), (2, "", 0, "c")], "doc_id long, text string, n_chars long, masked string")
    for d in (docs, docs.limit(0), docs.drop("n_chars")):
        out = S.redact(d)
        assert out.columns == d.columns and out.count() == d.count()
    got = S.redact(docs).where("doc_id = 1").first()
    assert (got.text, got.n_chars, got.masked) == ("[assign]", 8, "a")
    assert all(not plain(S.masked(t)) for t in TEXTS if t and len(t) < 1000 and "=api_key=" not in t)
