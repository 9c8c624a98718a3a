import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwater.llm import secret_scan as s

# the base patterns as they are stated
STATED = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def stated(text):
    out = []
    for k, (p, least) in enumerate(zip(STATED, (12, 18, 16))):
        out += [(*m.span(), k) for m in p.finditer(text) if len(m[2] if k == 0 else m[0]) >= least]
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "secret", "ſecret", "toKen", "token", "api_key", "APIKEY", "=", ": ", "  ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "0f", "zz", "=x/+", "é", "\n", "token=token=aaaaaaaaaaaa"]), max_size=14).map("".join))
def test_base_spans(text):
    assert s.base_spans(text) == stated(text)


def words(rng, n):
    return " ".join("".join(rng.choices(["tion", "the", "an", "er", "ing", "on", "re", "st"], k=rng.randint(1, 8))) for _ in range(n))


def test_operator(spark):
    rng = random.Random(2)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    rows = [(i, words(rng, 150) + f" token = {rng.randrange(16**24):024x} " + words(rng, 9)) for i in range(40)]
    rows += [(100, words(rng, 20) + " " + key + " end"), (101, None), (102, ""), (103, f'password: "{key}" é ' + words(rng, 4000)), (103, "x"), (103, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS label")
    model = s.train(docs)
    got = s.scan(docs, model).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((i, s.written(stated(t or ""))) for i, t in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == sorted((i, sha(w)) for i, w in want)
    at = rows[40][1].index(key)
    assert [r.spans for r in got if r.doc_id == 100] == [f"random:{at}:{at + 40}"]
    assert all("random" not in r.spans for r in got if r.doc_id != 100)
    clean = s.redact(docs, model)
    assert clean.columns == docs.columns
    out = {r.doc_id: r.text for r in clean.where("doc_id < 103").collect()}
    assert out[100] == rows[40][1].replace(key, "[SECRET]") and out[101] is None and out[102] == ""
    assert all("token" not in out[i] and "[SECRET]" in out[i] for i in range(40))
    assert s.scan(docs.limit(0), model).count() == 0
    s.train(docs.limit(0))


def test_models_tell_random_from_ordinary():
    rng = random.Random(3)
    ordinary = s.transitions([w for _ in range(300) for w in words(rng, 30).split()])
    model = s.Markov.trained(sum(s.transitions([x]) for _, x in s.generated(500)), ordinary)
    fresh = [x for _, x in s.generated(300, seed=99)]
    assert sum(model(x) >= s.LEAST_RATIO for x in fresh) > 290
    assert not any(model(w) >= s.LEAST_RATIO for w in words(rng, 3000).split())


def test_labels_leave_the_name_of_the_key_out():
    assert [x for label, x in s.labelled('password=Xy12Qw98Zr77Lp and secret: "ab.cdefghijklmn"') if label] == ["Xy12Qw98Zr77Lp", "ab.cdefghijklmn"]


def test_short_keys_and_long_texts():
    import time

    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    ordinary = s.transitions([w for _ in range(300) for w in words(rng, 30).split()])
    model = s.Markov.trained(sum(s.transitions([x]) for _, x in s.generated(500)), ordinary)
    for n in range(8, 20):
        keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(200)]
        found = [s.all_spans(f"the {k} on", model) for k in keys]
        assert sum(spans == [(4, 4 + n, 3)] for spans in found) >= 196, n
    assert s.all_spans("x " + "Zq7" * 2 + " y", model) == []  # below the least length
    text = " ".join(f"{words(rng, 6)} token={rng.randrange(16**20):020x} {''.join(rng.choices(alphabet, k=24))}" for _ in range(11000))
    assert len(text) > 10**6
    began = time.process_time()
    spans = s.all_spans(text, model)
    assert time.process_time() - began < 2 and sum(k == 3 for *_, k in spans) > 10900 and sum(k == 0 for *_, k in spans) == 11000
    small = text[:30000]
    tokens = [m for m in s.TOKEN.finditer(small) if m.end() - m.start() >= s.LEAST_LENGTH]
    base = s.base_spans(small)
    plain = base + [(*m.span(), 3) for m in tokens if not any(a < m.end() and m.start() < b for a, b, _ in base) and model(m[0]) >= s.LEAST_RATIO]
    assert s.all_spans(small, model) == sorted(plain, key=lambda x: (x[0], x[2]))
