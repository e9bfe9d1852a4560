"""Pseudonyms against a plain Python version of the same definition, on whole tables and on texts made to break patterns."""

import datetime
import hashlib
import ipaddress
import math
import re

import pytest
from pyspark.sql import functions as F

from repolith.llm import pseudonyms as N

KEY = "k"


def feistel(v, a, b, tweak):
    left, right = divmod(v, b)
    for i in range(N.ROUNDS):
        half, m = (right, a) if i % 2 == 0 else (left, b)
        d = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16) % m
        left, right = ((left + d) % a, right) if i % 2 == 0 else (left, (right + d) % b)
    return left * b + right


def walk(v, n, tweak):
    side = math.ceil(math.sqrt(float(n)) + 1e-3)
    v = feistel(v, side, side, tweak)
    while v >= n:
        v = feistel(v, side, side, tweak)
    return v


def chars(text, kind, alphabet=None):
    of = lambda c: alphabet or ("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz")
    last, out = hashlib.sha256(text[N.PIECE :].encode()).hexdigest(), ""
    for i in range(0, len(text), N.PIECE):
        piece, value, size, new = text[i : i + N.PIECE], 0, 1, ""
        for c in piece:
            value, size = value * len(of(c)) + of(c).index(c), size * len(of(c))
        value = walk(value, size, f"{kind}|{len(piece)}|{last}")
        for c in reversed(piece):
            value, d = divmod(value, len(of(c)))
            new = of(c)[d] + new
        out, last = out + new, new
    return out


def fill(shape, new, where="[0-9]"):
    it = iter(new)
    return "".join((x := next(it)).upper() if re.match(where, c) and c.isupper() else next(it) if re.match(where, c) else c for c in shape) if new else shape


def digits(text, kind):
    n = len(text)
    return str(feistel(int(text), 10 ** (n // 2), 10 ** (n - n // 2), f"{kind}{n}")).zfill(n)


def luhn(text, follow):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if (len(text) - i) % 2 == (1 if follow else 0) else int(c) for i, c in enumerate(text)) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def day_of(text):
    p = re.split("[-/.]", text)
    if "-" in text:
        order = [(0, 1, 2)]
    else:
        order = [(2, 1, 0), (2, 0, 1)]
    for k, (y, m, d) in enumerate(order):
        try:
            return datetime.date(int(p[y]), int(p[m]), int(p[d])), "-" in text, k == 0 and "-" not in text
        except ValueError:
            pass
    return None, False, False


def new_of(m):
    t = m[0]
    all_ = re.sub("[^0-9]", "", t)
    if "@" in t:
        if not re.search(r"@[A-Za-z0-9-]+\.(?:.*\.)?[A-Za-z]{2}", t):
            return None, t
        local, domain = t.split("@")
        return "email", fill(local, chars(re.sub("[^A-Za-z0-9]", "", local).lower(), "mail"), "[A-Za-z0-9]") + "@" + domain
    if re.fullmatch(r"[A-Z]{2}\d\d[ A-Z0-9]+", t):
        x = t.replace(" ", "")
        if mod97(x[4:] + x[:4]) != 1:
            return None, t
        account = chars(x[4:].lower(), "iban").upper()
        return "iban", fill(t, f"{x[:2]}{98 - mod97(account + x[:2] + '00'):02d}{account}", "[A-Z0-9]")
    if ":" in t:
        try:
            full = ipaddress.IPv6Address(t).exploded.replace(":", "")
        except ValueError:
            return None, t
        if len([g for g in t.split(":") if g]) < 2 or not re.search("[0-9]", t):
            return None, t
        return "ipv6", ":".join(re.findall("....", chars(full, "ipv6", "0123456789abcdef")))
    if re.fullmatch(r"\d{3}([- ])\d\d\1\d{4}", t):
        area, group, serial = int(t[:3]), int(t[4:6]), int(t[7:])
        v = feistel(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
        area = v // 9999 // 99 + 1
        return "ssn", f"{area + (area >= 666):03d}{t[3]}{v // 9999 % 99 + 1:02d}{t[3]}{v % 9999 + 1:04d}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d{1,2}[/.]\d{1,2}[/.]\d{4}", t):
        day, iso, first = day_of(t)
        if day is None:
            return None, t
        epoch = datetime.date(1900, 1, 1)
        move = lambda d: epoch + datetime.timedelta(feistel((d - epoch).days, 229, 319, "date"))
        new = move(day)
        while not iso and not first and new.day <= 12:
            new = move(new)
        if iso:
            return "date", new.isoformat()
        w, sep = (1 if re.match(r"\d/|\d\d/\d/", t) else 2), t[-5]
        d, mth = str(new.day).zfill(w), str(new.month).zfill(w)
        return "date", sep.join([d, mth, str(new.year)] if first else [mth, d, str(new.year)])
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", t):
        a, b, c, d = map(int, t.split("."))
        v = feistel(((a * 256 + b) * 256 + c) * 256 + d, 65536, 65536, "ip")
        return "ip", ".".join(str(v >> n & 255) for n in (24, 16, 8, 0))
    if re.fullmatch(r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d+", t):
        if luhn(all_, False):
            return None, t
        body = all_[0] + digits(all_[1:-1], "card")
        return "card", fill(t, body + str(-luhn(body, True) % 10))
    if re.fullmatch(N.PATTERNS["phone"], t, re.A):
        v = int(all_[-10:])
        real = lambda v: v // 10**7 >= 200 and v // 10**4 % 1000 >= 200
        if real(v):
            v = feistel((v // 10**7 - 200) * 8_000_000 + (v // 10**4 % 1000 - 200) * 10**4 + v % 10**4, 800, 8_000_000, "phone")
            v = (v // 8_000_000 + 200) * 10**7 + v % 8_000_000 + 2_000_000
        else:
            v = feistel(v, 10**5, 10**5, "other phone")
            while real(v):
                v = feistel(v, 10**5, 10**5, "other phone")
        return "phone", fill(t, all_[:-10] + f"{v:010d}")
    if not 8 <= len(all_) <= 15:
        return None, t
    code = re.match(r"\+(\d{1,3}(?=\D)|\d\d)", t)[1]
    rest = t[1 + len(code) :]
    return "phone_abroad", "+" + code + fill(rest, chars(re.sub("[^0-9]", "", rest), "abroad"))


def brute(text):
    if text is None:
        return None, []
    kinds = []

    def put(m):
        kind, new = new_of(m)
        kinds.extend([kind] if kind else [])
        return new

    return re.sub(N.ANY, put, text, flags=re.A), kinds


ROWS = [
    "John@x.com john@x.com JOHN.d@X.com a@b.co b@b.co c@b.co a@b..com a@1.2.3.4 x@y.z very-long.name_with+many%parts2024.and.more@mail.example.org",
    "+44 20 7946 0958, +44 20 7946 0958; +442079460958 +1 316 555 2121 (316) 555-2121 011-555-2121 +7 (495) 123-45-67 +12 3",
    "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432 GB83WEST12345698765432 DE89 3704 0044 0532 0130 00",
    "fe80::1 FE80:0:0:0:0:0:0:1 10:20:30 std::a a::b 2001:db8::ff00:42:8329 ::1 1::2::3 00:1a:2b:3c:4d:5e 1:2:3:4:5:6:7:8:9 :1:2: 1::",
    "123 45 6789 123-45-6789 000-45-6789 667-01-0001 899-99-9999 12 345 6789",
    "1/2/1990 01/02/1990 2024-02-03T10:00 2024-02-03T 13/12/1999 12/31/1999 1/31/1999 31.12.1999 30/02/2001 1999-02-30 2099-12-31 1900-01-01",
    "4429820930819525 4111-1111-1111-1111 4111 1111 1111 1112 192.168.0.1 256.1.1.1 1.2.3.4.5",
    "",
    None,
]


def test_rows(spark):
    got = {r["doc_id"]: r for r in N.pseudonymise(spark.createDataFrame(list(enumerate(ROWS)), "doc_id long, text string"), KEY).collect()}
    for i, text in enumerate(ROWS):
        assert (got[i]["text"], got[i]["pii"]) == brute(text), text
    a, b, c, *_ = got[0]["text"].split()
    assert a.lower() == b and a[0].isupper() and b != "john@x.com"
    assert len({x[0] for x in got[0]["text"].split()[3:6]}) == 3
    ips = got[3]["text"].split()
    assert ips[0] == ips[1] and got[3]["pii"] == ["ipv6"] * 3
    assert got[1]["text"].split(",")[0].split()[0] == "+44" and re.sub(" ", "", got[1]["text"].split(",")[0]) == got[1]["text"].split(";")[1].split()[0]


def test_given_table(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_KEY", KEY)
    sf = "/root/testdata/sf0.01"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = N.op3_pseudonyms(spark, sf).collect()
    assert len(out) == len(docs) and sum(sum(r[2:]) for r in out) > 50
    for r in out:
        text, kinds = brute(docs[r["doc_id"]])
        assert r["text"] == text and all(r[f"n_{k}"] == kinds.count(k) for k in N.PATTERNS)


LONG = 1_000_000
HARD = ["x@" + "a." * (LONG // 2) + "com", "1" * LONG, "1.2." * (LONG // 4), "+1 " * (LONG // 3), "+44 1234 " * (LONG // 9), "AB12 ABCD" + " ABCD" * (LONG // 5), "ab:" * (LONG // 3), "::" * (LONG // 2), "a" * LONG + "@x.com", "a.b@" * (LONG // 4), "1/2/" * (LONG // 4), "1234-" * (LONG // 5), "%" * LONG + "1", "123 45 " * (LONG // 7), "(316) " * (LONG // 6)]


def test_no_text_breaks_a_pattern(spark):
    """A megabyte of each pattern's beginning: nothing overflows, and all but the first stays as it is."""
    rows = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in N.pseudonymise(rows, KEY).collect()}
    for i, text in enumerate(HARD):
        assert got[i]["pii"] == (["email"] if i == 0 else []) and (got[i]["text"] == text) == (i > 0) and len(got[i]["text"]) == len(text)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_strings_are_permuted(spark, size):
    """Every string of a form goes to another of the form, and not by one constant step."""
    import itertools

    words = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=min(size, 2))]
    words = [w + "7" for w in words] if size == 3 else words
    out = spark.createDataFrame([(w,) for w in words], "s string").select("s", N._chars(F.col("s"), N._own, KEY, "t").alias("o")).collect()
    assert sorted(r["o"][:2] for r in out if size < 3) == (sorted(words) if size < 3 else []) and len({r["o"] for r in out}) == len(words)
    assert len({(ord(r["o"][0]) - ord(r["s"][0])) % 26 for r in out}) > 3
