import random

import corpus_pipeline as P
import sentencepiece
from mftlake.llm import sentencepiece_codec as codec
from mftlake.llm import toxicity

from test_decontaminate import WORD, brute, low
from test_simhash import brute_similar


def tables(spark, folder):
    rng = random.Random(11)
    v = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "st", "ra", "l")]
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, text(12)) for i in range(6)]
    docs = [(i, text(rng.randint(40, 120))) for i in range(160)]
    docs = [(i, t + (" vileword scumbag vileword" if i % 5 == 0 else "")) for i, t in docs]
    docs += [(200 + k, docs[k][1]) for k in range(1, 20)]
    docs += [(300 + k, docs[k][1] + " zz") for k in range(21, 30)]
    docs += [(400, text(30) + " " + items[0][1] + ", " + text(9)), (401, f"{items[1][1]} {text(20)} {items[2][1]}"), (402, None), (403, "")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(160)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, items, labels


def test_equals_brute_force(spark, tmp_path):
    docs, items, labels = tables(spark, tmp_path)
    got = {r["doc_id"]: r["token_ids"] for r in P.run(spark, str(tmp_path)).collect()}
    texts, known = dict(docs), {i: y for i, _, y in labels}
    model = toxicity.train([texts[i] for i in sorted(known)], [known[i] for i in sorted(known)])
    left = [(i, t) for i, t in docs if 1 - model.at_most(model.score(t))[0] < model.toxic_from]
    assert {i for i, t in docs if "vileword" not in (t or "")} == {i for i, _ in left}
    last = {}
    for i, t in left:
        last[t or ""] = max(i, last.get(t or "", i))
    left = [(i, t) for i, t in left if last[t or ""] == i]
    left = [left[k] for k in sorted(brute_similar(left))]
    want = {}
    judge = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    for (i, t), (_, n, h, found, hit) in zip(left, brute(left, items)):
        if len(found) < 2:
            want[i] = (t or "", hit)
    assert got.keys() == want.keys() and 401 not in got and 400 in got
    for i, (t, hit) in want.items():
        if not hit:
            assert got[i] == judge.encode(t)
        else:
            assert WORD.findall(low(judge.decode(got[i]))) == [w for k, w in enumerate(WORD.findall(low(t))) if k not in hit]


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(40), str(tmp_path)).columns == docs.columns


def test_encoding_verifies_every_chunk(spark, monkeypatch):
    """What the stage's workers encode with holds each distinct chunk against the sentencepiece library."""
    coder, asked = codec._codec(codec._model_bytes(codec.MODEL)), []
    judge = coder.judge

    class Listening:
        def encode(self, chunks, num_threads):
            asked.extend(chunks)
            return judge.encode(chunks, num_threads=num_threads)

    monkeypatch.setattr(coder, "judge", Listening())
    coder.known.clear()
    coder.encode(codec.pa.array(["one two three", "two four", None]))
    assert sorted(asked) == [" four", " one", " three", " two"]
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert P.encoding_stage(spark, docs, "").first()["n_differing"] == 0
