import math
import os
import zlib

import pytest

from tarnwater.llm import language_id
from tarnwater.llm.language_id import identify, keep_identified, predict, train

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_only_text_decides(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the sea", "en"), ("das haus und die see", "de")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    odd = spark.createDataFrame([(1, "und das", None), (1, "und das", None), (2, None, "en"), (3, "12 %", "en"), (4, "", "en"), (None, "AND THE " * 5000, "de")], "doc_id long, text string, lang string").selectExpr("*", "'q' AS score")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in predict(odd, model).collect())
    assert got == [(0, "en"), (1, "de"), (1, "de"), (2, "und"), (3, "und"), (4, "und")]
    assert [r.lang_pred for r in predict(odd, None).collect()] == ["und"] * 6
    assert predict(odd.limit(0), model).count() == 0 and train(docs.limit(0)) is None
    assert train(odd.where("lang IS NULL")) is None
    kept = keep_identified(docs.union(spark.createDataFrame([(99, "..", "en"), (98, None, "de")], docs.schema)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))


def brute(rows):
    """A function text -> (language or None, posterior), learnt from rows (text, lang) by loops over single n-grams."""

    def grams(text):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        for i in range(len(s) - 2):
            if s[i : i + 2] != "  ":
                for parts in (s[i : i + 2], s[i : i + 3]):
                    h = sum(ord(c) * k for c, k in zip(parts, (2654435761, 2246822519, 3266489917))) % 2**32
                    yield h >> (32 - language_id.BITS)

    langs = sorted({lang for _, lang in rows if lang})
    counts, n = {x: {} for x in langs}, dict.fromkeys(langs, 0)
    for text, lang in rows:
        if lang:
            n[lang] += 1
            for g in grams(text or ""):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {x: sum(counts[x].values()) + 0.05 * 2**language_id.BITS for x in langs}

    def told(text):
        own = list(grams(text or ""))
        if not own:
            return None, 0
        weigh = min(len(own), language_id.EVIDENCE) / len(own)
        logs = [math.log(n[x] / sum(n.values())) + weigh * sum(math.log((counts[x].get(g, 0) + 0.05) / total[x]) for g in own) for x in langs]
        p = [math.exp(v - max(logs)) for v in logs]
        return langs[p.index(max(p))], max(p) / sum(p)

    return told


def test_against_brute_force(spark):
    """Counts, posteriors and labels."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("The cat sat", "en"), ("El gato ñoño, sí", "es"), ("the dog!", "en"), ("", "en"), (None, "es"), ("perro y gato 12", "es"), ("Straße", "de"), ("x", None), ("the the", "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    told, model = brute([r[1:] for r in rows]), language_id.train(docs)
    assert model.languages == ["de", "en", "es"]
    tests = ["the cat", "gato", "Straße ß", "", "12 !", "el dog y the perro " * 30, "the cat sat on " * 40000]
    best, score = language_id.scored(tests, model, language_id.letters())
    for k, text in enumerate(tests):
        label, p = told(text)
        assert (model.languages[best[k]] if best[k] >= 0 else None) == label and abs(score[k] - p) < 1e-4
        alone = language_id.scored([text], model, language_id.letters())  # whatever texts stand beside it
        assert alone[0][0] == best[k] and alone[1][0] == score[k]
