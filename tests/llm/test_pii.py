import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii
from tests.llm import data

KEY = "test-key"


def prf(kind, turn, other, i):
    return int(hashlib.sha256(f"{KEY}|{kind}|{turn}|{','.join(map(str, other))}|{i}".encode()).hexdigest()[:12], 16)


def brute(kind, v, m):
    """The network in plain Python."""
    h = len(v) // 2
    left, right = list(v[:h]), list(v[h:])
    for t in range(4):
        if t % 2 == 0:
            left = [(x + prf(kind, t, right, i)) % m[i] for i, x in enumerate(left)]
        else:
            right = [(x + prf(kind, t, left, i)) % m[h + i] for i, x in enumerate(right)]
    return left + right


def luhn(d):
    s = 0
    for i, x in enumerate(reversed(d)):
        x = x * 2 if i % 2 else x
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute_value(m):
    digits = [int(c) for c in m if c.isdigit()]

    def fill(new):
        it = iter(new)
        return "".join(str(next(it)) if c.isdigit() else c for c in m)

    if "@" in m:
        loc, dom = m.rsplit("@", 1)
        base = [48 if c.isdigit() else 97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else ord(c) for c in loc]
        mod = [10 if b == 48 else 26 if b in (97, 65) else 1 for b in base]
        return "".join(chr(x + b) for x, b in zip(brute("email", [ord(c) - b for c, b in zip(loc, base)], mod), base)) + "@" + dom
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        v = list(map(int, m.split(".")))
        return m if max(v) > 255 else ".".join(map(str, brute("ipv4", v, [256] * 4)))
    for rx, order, fmt in ((r"(\d{4})-(\d\d)-(\d\d)", (1, 2, 3), "%Y-%m-%d"), (r"(\d\d)\.(\d\d)\.(\d{4})", (3, 2, 1), "%d.%m.%Y"), (r"(\d\d)/(\d\d)/(\d{4})", (3, 1, 2), "%m/%d/%Y")):
        if x := re.fullmatch(rx, m):
            try:
                n = (date(*(int(x[k]) for k in order)) - date(1900, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= n < 17 * 4297:
                return m
            a, b = brute("date", [n // 4297, n % 4297], [17, 4297])
            return (date(1900, 1, 1) + timedelta(a * 4297 + b)).strftime(fmt)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        return fill(brute("ssn", digits, [10] * 9))
    if m[0] in "+(" or re.fullmatch(r"\d{3}[-.]\d{3}[-.]\d{4}", m):
        k = max(len(digits) - 10, 0)
        return fill(digits[:k] + brute("phone", digits[k:], [10] * len(digits[k:])))
    if re.fullmatch(r"[0-9 -]{13,19}", m):
        if not luhn(digits):
            return m
        body = brute("card", digits[:-1], [10] * (len(digits) - 1))
        return fill(body + [next(c for c in range(10) if luhn(body + [c]))])
    return "".join("%x" % x for x in brute("secret", [int(c, 16) for c in m], [16] * len(m)))


VALUES = [
    "ann.smith-7@mail.example.com", "A@b.co", "10.20.30.40", "999.1.1.1", "2024-02-29", "2023-02-29", "31.12.1999", "02/29/2000", "13/13/2000", "1850-01-01", "123-45-6789",
    "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "+49 30 1234567", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "378282246310005", "cb1a9fee807a05366fcb8b6c95c7c565ede51a72",
]


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, KEY, **how).orderBy("doc_id").collect()]


def test_values_by_brute_force(spark):
    texts = [f"a {v} b" for v in VALUES]
    got = run(spark, texts)
    assert got == [f"a {brute_value(v)} b" for v in VALUES]
    assert run(spark, got, reverse=True) == texts
    for v, g in zip(VALUES, got):
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", v))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "9", g[2:-2]))) or len(v) == 40


def test_links_and_distinct(spark):
    got = run(spark, ["call +1 (555) 123-4567 or (555) 123-4567, 4111111111111111 and 4111 1111 1111 1111", "x 4111111111111111."])
    tail = re.findall(r"\d{3}\) \d{3}-\d{4}", got[0])
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[0])
    assert tail[0] == tail[1] and cards[0] == cards[1].replace(" ", "") and cards[0] in got[1] and cards[0] != "4111111111111111"
    rng = random.Random(1)
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)]
    out = run(spark, ips)
    assert len(set(out)) == len(set(ips)) and all(max(map(int, x.split("."))) < 256 for x in out)


def test_left_alone(spark):
    clean = ["", None, "no values, 12 apples; 3.14 and v1.2.3.4.5", "1234567", "user@ host", "@", "abcdef0123", "x" * 200_000, "1" * 5000, "a@" * 3000, "word " * 30_000, "12.34.5678.90", "4111111111111111x"]
    assert run(spark, clean) == clean


def test_neighbours_and_edges(spark):
    a, b = "4111111111111111", "5500005555555559"
    got = run(spark, [f"{a} {b}", f"{a}\n{a}", f"({a})", f"{a}*** x@y.zz### 10.0.0.1%%%", a, f"é {a} é"])
    assert got == [f"{brute_value(a)} {brute_value(b)}", f"{brute_value(a)}\n{brute_value(a)}", f"({brute_value(a)})", f"{brute_value(a)}*** {brute_value('x@y.zz')}### {brute_value('10.0.0.1')}%%%", brute_value(a), f"é {brute_value(a)} é"]


def test_columns_and_rows(spark):
    df = data.frame(spark).withColumn("_pii0", F.lit("mine"))
    out = pii.pseudonymise(df, KEY, found_col="found")
    assert out.columns == [*df.columns, "found"] and out.count() == df.count()
    assert out.where("_pii0 <> 'mine'").count() == 0
    assert pii.pseudonymise(data.empty(spark), KEY).collect() == []
    with pytest.raises(ValueError):
        pii.pseudonymise(df.withColumn("Found", F.lit(1)), KEY, found_col="found")


def test_feistel_any_radix(spark):
    rng = random.Random(2)
    rows = []
    for n in (0, 1, 2, 3, 7, 12):
        m = [rng.randrange(1, 30) for _ in range(n)]
        rows.append(([rng.randrange(x) for x in m], m))
    df = spark.createDataFrame(rows, "v array<int>, m array<int>")
    out = df.select("v", "m", pii.feistel(F.col("v"), F.col("m"), KEY + "|k").alias("e"))
    for r in out.select("v", "m", "e", pii.feistel(F.col("e"), F.col("m"), KEY + "|k", reverse=True).alias("d")).collect():
        assert r.e == brute("k", r.v, r.m) and r.d == r.v


def test_values_without_two_digits_in_a_row(spark):
    secret = "a1b2c3d4e5f6a7b8" * 2
    letters = "abcdefabcdefabcd" * 2
    texts = ["ask 8.8.8.8 now", "1.2.3.4", "8.8.8.8 in 2024", f"key {secret}", letters, "version 1.2.3 of a thing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k", found_col="found").collect()}
    assert [(f.kind, f.value) for i in range(5) for f in got[i].found] == [("ipv4", "8.8.8.8"), ("ipv4", "1.2.3.4"), ("ipv4", "8.8.8.8"), ("secret", secret), ("secret", letters)]
    assert all(f.value not in got[i].text for i in range(5) for f in got[i].found)
    assert got[0].found[0].pseudonym == got[2].found[0].pseudonym and got[5].text == texts[5]
