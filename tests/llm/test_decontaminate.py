import hashlib
import random
import re

from mftlake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 7)) if w else ():
            grams.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for g, names in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= names
        out.append((d, len(w), len(hit), tuple(sorted(found)), hit))
    return out


def made():
    rng = random.Random(3)
    v = ["Alpha", "beta", "Gämma", "délta", "e1", "z"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 3, 8, 9, 15])))) for i in range(12)] + [(12, None), (13, "!?")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(v) for _ in range(rng.randint(0, 12)))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 1), (rng.choice(items)[1] or "").upper().replace(" ", rng.choice([" ", ", ", "\n"])))
        docs.append((i, rng.choice(["", "  ", "«"]) + " - ".join(parts)))
    docs += [(60, None), (61, ""), (62, "alpha"), (7, docs[7][1]), (7, "other alpha text"), (None, docs[3][1])]
    return docs, items


def test_equals_brute_force(spark, tmp_path):
    docs, items = made()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.op3_benchmark_decontamination(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(((d, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), len(f) >= 2) for d, n, h, f, _ in brute(docs, items)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_large_benchmarks_shuffle_with_the_same_result(spark):
    docs, items = made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda n: sorted(map(str, D.scan(d, b, broadcast_windows=n).collect()))
    assert rows(0) == rows(10**6)


def test_spans_and_documents_go(spark):
    docs, items = made()
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, _key int")
    out = {r["_key"]: r for r in D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, ((d, t), (_, n, h, found, hit)) in enumerate(zip(docs, brute(docs, items))):
        assert (i in out) == (len(found) < 2)
        if i in out and not found:
            assert out[i]["text"] == t
        elif i in out:
            assert WORD.findall(low(out[i]["text"])) == [w for k, w in enumerate(WORD.findall(low(t))) if k not in hit]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.scan(docs, items).first()["_n_words"] == 2
    assert D.scan(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items).collect() == docs.collect()


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    text = " ".join(f"x{i % 977}" for i in range(30_000)) + " " + " ".join([item] * 300)
    found = D.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (found["_n_words"], found["_n_hit"]) == (36_000, 6_000)
