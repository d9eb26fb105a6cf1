import hashlib
import random
import re

from netquarry.llm.pii import pii_report

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    text = text or ""
    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, TEXT string, found string") if texts else spark.createDataFrame([], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_report(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t[:200], joined[:300], got[i].spans[:300])
        for kind in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{kind}"] == sum(k == kind for _, _, k, _ in want)
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    return got


def test_cases(spark):
    got = check(spark, [
        None, "", "a@b.c_d@e.f x@y.zz @q.r a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3 99999999999999999999.1.1.1",
        "4242 4242 4242 4242 and 4242424242424242-1 4111-1111-1111-1111", "+1 (743) 555-3824 +12 +1234567890123456 ++1 743 555 3824-",
        "é😀 a.b@c-d.ef 😀 10.0.0.1 card 4000000000000002", "my bank account DE89 3704 0044 0532 0130 00 is", "DE88 3704 0044 0532 0130 00", "SSN 123-45-6789 but 123-45-6789",
        "1" * 1500, "1 " * 700, "a" * 1500 + "@", "1." * 500, "+1" + "(" * 1000, "a@b" + ".c" * 500, "4242424242424242 " * 30, "+" * 1000,
    ])
    assert "iban:16:43" in got[7].spans and "iban" not in got[8].spans
    assert got[9].spans.startswith("ssn:4:15")


def test_account_numbers_end_where_their_country_says(spark):
    texts = [
        "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 EUR 500", "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32",
        "DE89370400440532013000EUR", "xDE89370400440532013000", "NO93 8601 1117 947, FR14 2004 1010 0505 0001 3M02 606.", "ZZ89370400440532013000",
    ]
    got = check(spark, texts)
    assert [[s for s in got[k].spans.split(",") if "iban" in s] for k in range(len(texts))] == [
        ["iban:0:27"], ["iban:0:22"], ["iban:0:27", "iban:28:55"], [], [], ["iban:0:18", "iban:20:53"], [],
    ]


def test_very_many_matches_in_one_text(spark):
    n = 60_000
    docs = spark.createDataFrame([(1, "a@b.cd " * n), (2, "x " + "10.0.0.1 " * 700)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_report(docs).collect()}
    assert got[1].n_email == n and got[1].spans == ",".join(f"email:{7 * k}:{7 * k + 6}" for k in range(n))
    assert got[2].n_ip == 700 and got[2].spans == ",".join(f"ip:{2 + 9 * k}:{10 + 9 * k}" for k in range(700))


def test_random(spark):
    rng = random.Random(7)
    pieces = ["a", "b9", "@", ".", "-", " ", "1", "23", "+1", "(", ")", "_", "%", "4242424242424242", "192.168.0.1", "x@y.com", "+1 (555) 123-4567", "é", "😀", "\n"]
    check(spark, ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(800)])


def test_very_long(spark):
    texts = {"1" * 200_000: 0, "1 " * 50_000: 0, "a" * 200_000 + "@": 0, "1." * 4000: 1000, "+1" + "(" * 100_000: 0, "a@b" + ".c" * 50_000: 1, "4242424242424242;" * 1000: 1000}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii_report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_empty(spark):
    check(spark, [])
