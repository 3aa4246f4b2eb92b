import random
import re

from pyspark.sql import types as T

from mftlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }
            if checks[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def made(rng):
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "é", "日本", " ", "\n", "_", "-", "012.034.056.078", "123-45-6789", "5", "37", "Dr. Anna Weber", "ann [at] web [dot] com", "DE89 3704 0044 0532 0130 00"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    mail = "p@" + "a." * 20_000 + "b"
    long = {"x" * 200_000: [], "9" * 100_000: [], "a." * 50_000 + "@": [], mail: [("email", 0, len(mail))], "1 " * 60_000: []}
    numbers = " ".join(f"{i % 90 + 10}," for i in range(100_000))
    long[numbers] = []
    many = [" ".join(f"é u{i}@b.de, 10.0.{i % 300}.1" for i in range(n)) for n in (255, 256, 257, 1000)]
    texts = [*many, None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", *long] + [made(rng) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: [(s["kind"], s["a"], s["b"]) for s in r["_base"]] for r in pii.personal_spans(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (long[t] if t in long else plain(t or "")), t


def test_extra_spans_overlap_no_base_span_and_redaction_hides_all(spark):
    rows = [(1, "ssn 123-45-6789 and +1 (555) 010-9999 for Dr. Anna Weber", "a"), (2, None, "b"), (3, "nothing here", "c")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    spans = {r["_id"]: r["_spans"] for r in pii.personal_spans(df).collect()}
    assert spans[3] == [] and spans[2] == []
    assert "phone" in {s["kind"] for s in spans[1]}
    for s in spans[1]:
        assert not any(s is not o and s["kind"] not in pii.BASE and o["kind"] in pii.BASE and o["a"] < s["b"] and s["a"] < o["b"] for o in spans[1])
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert "010-9999" not in hidden[1] and "<phone>" in hidden[1]
    assert hidden[2] is None and hidden[3] == "nothing here"
    assert pii.redact(df).columns == df.columns


def test_empty_table_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "text", "_id", "_found", "t", "digits")])
    assert pii.personal_spans(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("1", "a@b.co", "x", "y", "z", "w")], schema)
    assert [s["kind"] for s in pii.personal_spans(df).first()["_base"]] == ["email"]
    assert pii.redact(df).first()["text"] == "<email>"


def test_em_finds_the_reliable_labelers():
    patterns = [("email", (1, 1, 1, 0), 90), ("email", (1, -1, 1, 0), 60), ("email", (-1, 1, -1, 0), 40), ("email", (-1, -1, -1, 0), 50)]
    model = pii.estimate(patterns)
    assert model.accuracy[0] > 0.9 and model.accuracy[2] > 0.9 and model.accuracy[1] < 0.75


def test_account_numbers_are_told_by_their_checksum(spark):
    from pyspark.sql import functions as F

    def good(text):
        moved = text.replace(" ", "")[4:] + text.replace(" ", "")[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1

    numbers = ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "FR1420041010050500013M02607"]
    df = spark.createDataFrame([(i, f"account {n}.") for i, n in enumerate(numbers)], "doc_id int, _text string")
    found = pii._voted(df).select("doc_id", F.expr("filter(_found, x -> x.kind = 'iban')[0]").alias("x")).collect()
    assert {r["doc_id"]: r["x"]["holds"] for r in found} == {i: good(n) for i, n in enumerate(numbers)}
