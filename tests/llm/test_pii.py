"""Pseudonyms beside a plain Python twin, and texts that patterns find hard."""

import datetime
import hashlib
import time

import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import pii, queries

from .fixtures import documents, empty, prose

KEY = "k1"
ANY = regex.compile("(?:" + "|".join(pii.FORMATS.values()) + ")")


def hashed(*parts):
    return int(hashlib.sha256(":".join(map(str, (KEY, *parts))).encode()).hexdigest()[:15], 16)


def feistel(x, a, b, tweak):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + hashed(tweak, i, right)) % a
        else:
            right = (right + hashed(tweak, i, left)) % b
    return left * b + right


def digits(d, kind):
    n = len(d)
    return str(feistel(int(d), 10 ** (n - n // 2), 10 ** (n // 2), f"{kind}{n}")).zfill(n)


def fill(shape, d):
    d = iter(d)
    return "".join(next(d) if c in "0123456789" else c for c in shape)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def user(u, domain):
    left, right = u[: len(u) // 2], u[len(u) // 2 :]

    def shifted(text, seed):
        out = ""
        for i, c in enumerate(text):
            for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + hashed(seed, i)) % len(alphabet)]
                    break
            out += c
        return out

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = shifted(left, f"user:{domain}:{i}:{right}")
        else:
            right = shifted(right, f"user:{domain}:{i}:{left}")
    return left + right


def twin(hit):
    """Kind and pseudonym of a hit, or None."""
    d = "".join(c for c in hit if c in "0123456789")
    full = lambda kind: regex.fullmatch(pii.FORMATS[kind], hit)
    if "@" in hit:
        u, domain = hit.split("@")
        return ("email", f"{user(u, domain.lower())}@{domain}") if len(u) <= 64 and len(domain) <= 255 else None
    if full("ip"):
        p = [int(x) for x in hit.split(".")]
        if max(p) > 255 or any(len(x) > 1 and x[0] == "0" for x in hit.split(".")):
            return None
        x = feistel(((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3], 65536, 65536, "ip")
        return "ip", ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if full("date"):
        try:
            day = datetime.date(int(d[:4]), int(d[4:6]), int(d[6:]))
        except ValueError:
            return None
        for first, a, b in reversed(pii.DATES):
            start = datetime.date.fromisoformat(first)
            if day >= start:
                out = start + datetime.timedelta(feistel((day - start).days, a, b, first))
                return "date", fill(hit, f"{out.year:04}{out.month:02}{out.day:02}")
    if full("ssn"):
        a, g, s = (int(x) for x in hit.split("-"))
        if a in (0, 666) or a >= 900 or not g or not s:
            return None
        x = feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        a += 1
        return "ssn", f"{a + (a >= 666):03}-{g + 1:02}-{s + 1:04}"
    if full("phone"):
        country = regex.match(r"\+[0-9]{1,3}", hit)
        n = country.end() if country else 0
        own = "".join(c for c in hit[n:] if c in "0123456789")
        return "phone", hit[:n] + fill(hit[n:], digits(own, "phone"))
    body = digits(d[:-1], "card")
    return ("card", fill(hit, body + luhn(body))) if luhn(d[:-1]) == d[-1] else None


def brute(text):
    found, out, end = [], "", 0
    for m in ANY.finditer(text or ""):
        new = twin(m.group())
        if new:
            found.append((m.group(), *new))
        out += text[end : m.start()] + (new[1] if new else m.group())
        end = m.end()
    return found, None if text is None else out + text[end:]


PRIVATE = [
    "call +1 (499) 555-6503, card 4111 1111 1111 1111 on 2024-02-29, ssn 123-45-6789, ip 10.0.0.255 or 999.1.1.1, a.b7@x.com, 2023-02-30, 1234567890123456",
    "1899-12-31 0001-01-01 9999/12/31 2105.12.31 2106-01-01 0000-01-01 03/04/1990 phone +44 20 7946 0958, 555-123-4567.",
    "a@b.c_d@e.f @x y@z q@r.s. Jo.Doe+Tag_9@Mail.Example.ORG; x@y.z,u@v.w 1.2.3.4.5 1.2.3.1234 01.002.3.4",
    "4111111111111111 é 10.0.0.255 666-12-3456 900-12-3456 899-99-9999 001-01-0001 34343434343434-1",
]


def test_pseudonyms_are_those_of_the_twin(spark):
    rows = [(i, t) for i, t in enumerate([*PRIVATE, None, "", prose(1, 30)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(f) for f in r["found"]], r["text"]) for r in pii.find_pii(docs, KEY).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert {k for found, _ in got.values() for _, k, _ in found} == set(pii.FORMATS)
    back = pii.find_pii(pii.find_pii(docs, KEY).select("doc_id", "text"), KEY, inverse=True).select("doc_id", "text")
    assert sorted(map(tuple, back.collect())) == rows
    assert pii.find_pii(documents(spark), KEY).count() == documents(spark).count() and pii.find_pii(empty(spark), KEY).count() == 0


def test_the_query_is_that_of_the_twin(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "PUBLIC_KEY", KEY)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op5_pii(spark, sf_dir).collect():
        found, changed = brute(text[r["doc_id"]])
        assert [tuple(f) for f in r["found"]] == found and r["text"] == changed and r["n_found"] == len(found)
        assert all(r[f"n_{k}"] == sum(f[1] == k for f in found) for k in pii.FORMATS)


def test_feistel_is_a_permutation(spark):
    n = F.lit(7).cast("long"), F.lit(9).cast("long")
    got = spark.range(63).select("id", pii.feistel(F.col("id"), *n, "k", F.lit("t")).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == list(range(63))
    assert got.where(pii.feistel(F.col("p"), *n, "k", F.lit("t"), True) != F.col("id")).count() == 0


@pytest.mark.parametrize("text", ["1 " + "x" * 1_000_000, "mail x@" + "a." * 100_000 + "com", "1" * 1_000_000, "a@" * 300_000, "1." * 300_000, "12-" * 300_000, "+1 22" * 200_000, "x" * 1_000_000 + "@a.com"])
def test_time_follows_length_whatever_a_text_holds(spark, text):
    began = time.time()
    [r] = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).collect()
    assert time.time() - began < 30
    assert r["text"] == brute(text)[1]
