"""Secret scans: fixed patterns, and character Markov models for what these miss.

Two first-order models over characters, of random strings and of ordinary identifiers, are trained
from labelled samples; a token whose log-likelihood ratio is high enough is a secret of kind
`random`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import batched, keyed, sampled, steps, texts

KINDS = ("assign", "access", "hex", "random")


def either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns, ASCII letters of the names in either case.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(re.sub("[a-z]", lambda m: either(m[0]), n) for n in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")

#: What passes for an ordinary identifier in training: words, joined by signs or case, and short numbers.
WORD = r"(?:(?:[A-Z]?[a-z]{2,})+|[A-Z]+|[a-z])"
ORDINARY = re.compile(rf"{WORD}(?:[_/=-]{WORD})*[0-9]{{0,4}}|[0-9]{{1,9}}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET) + 1
CODE = np.full(128, 0, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)

#: Training reads the documents of at most so many ids and so many generated random strings.
SAMPLE_ROWS, SAMPLE_STRINGS = 4000, 3000
#: A token of kind `random` has at least so many characters and so high a ratio (in nats).
LEAST_LENGTH, LEAST_RATIO = 8, 12.0
#: Observations that a character's overall frequency counts for in each context.
BACKED = 20


def base_spans(text):
    """[(start, end, index of the kind)] of the patterns, leftmost and non-overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def labelled(text):
    """(label, string) samples in a text: its base matches are secrets (1), identifiers elsewhere ordinary (0)."""
    spans = base_spans(text)
    a = 0
    for start, end, kind in sorted(spans) + [(len(text), len(text), 0)]:
        for m in TOKEN.finditer(text, a, max(a, start)):
            if ORDINARY.fullmatch(m[0]):
                yield 0, m[0]
        if end > start:
            yield 1, ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]  # without the name of the key
        a = max(a, end)


def generated(n=SAMPLE_STRINGS, seed=11):
    """Labelled random strings over the alphabets that keys are written in."""
    rng = np.random.default_rng(seed)
    kinds = (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    return [(1, "".join(rng.choice(list(kinds[i % len(kinds)]), 32))) for i in range(n)]


def transitions(strings):
    """Counts of (character before, character), the beginning as 0."""
    out = np.zeros((SIZE, SIZE), np.int64)
    joined = np.frombuffer(("~" + "~".join(strings) + "~").encode("ascii", "replace"), np.uint8)
    codes = CODE[np.minimum(joined, 127)]
    np.add.at(out, (codes[:-1], codes[1:]), 1)
    out[:, 0] = 0
    return out


@dataclass
class Markov:
    """log P(next | character) of random less that of ordinary strings, after training."""

    ratio: np.ndarray

    @classmethod
    def trained(cls, random, ordinary):
        logs = []
        for counts in (random, ordinary):
            alone = counts.sum(0) + 0.5  # rare contexts lean on how common the next character is
            smooth = counts + BACKED * alone / alone.sum()
            logs.append(np.log(smooth / smooth.sum(1, keepdims=True)))
        return cls(logs[0] - logs[1])

    def __call__(self, token):
        codes = CODE[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[0, codes[0]] + self.ratio[codes[:-1], codes[1:]].sum())


def train(docs, id_col="doc_id", text_col="text", sample_rows=SAMPLE_ROWS, extra=None):
    """Markov models from labelled strings: those of sampled documents and `extra` ones (generated
    random strings by default). The driver receives counts of pairs of characters only."""
    rows = sampled(keyed(docs, id_col, text_col), sample_rows)

    def run(batches):
        for batch in batches:
            strings = texts(batch)
            for a, b in steps(map(len, strings)):
                found = [x for t in strings[a:b] for x in labelled(t)]
                for label in (0, 1):
                    counts = transitions([s for k, s in found if k == label])
                    some = np.argwhere(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.int32()), pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(counts[some[:, 0], some[:, 1]])], ["label", "a", "b", "n"])

    found = rows.mapInArrow(run, "label int, a long, b long, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, SIZE, SIZE), np.int64)
    counts[found.label.to_numpy(int), found.a.to_numpy(int), found.b.to_numpy(int)] = found.n.to_numpy(int)
    for label, s in generated() if extra is None else extra:
        counts[label] += transitions([s])
    return Markov.trained(counts[1], counts[0])


def all_spans(text, model):
    """Base spans and those of kind `random`, which overlap none of them."""
    base = base_spans(text)
    spans, k, reach = list(base), 0, 0
    for m in TOKEN.finditer(text):
        while k < len(base) and base[k][0] < m.end():  # both are in the order of their starts
            k, reach = k + 1, max(reach, base[k][1])
        if m.end() - m.start() >= LEAST_LENGTH and reach <= m.start() and model(m[0]) >= LEAST_RATIO:
            spans.append((*m.span(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs, model, id_col="doc_id", text_col="text"):
    """One row per row of docs: counts of each base kind, a digest of the base spans, all spans as
    text (kind:start:end, in code points).

    Null counts as empty, an empty text has no spans. Repeated rows each get their own row; an
    empty table gives an empty result; other columns are not read. A text of any length is scanned whole, in
    time that grows with its length; memory follows the longest text. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            columns = [[] for _ in range(5)]
            for t in texts(batch):
                spans = all_spans(t, model)
                base = [s for s in spans if s[2] < 3]
                for c, v in zip(columns, (*(sum(s[2] == k for s in base) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("doc_id", id_col)


def redacted(text, model, mark="[SECRET]"):
    out, a = [], 0
    for start, end, _ in all_spans(text, model):
        if end > a:
            out += [text[a : max(a, start)], mark] if start >= a else []
            a = end
    return "".join(out) + text[a:] if out else text


def redact(docs, model, text_col="text"):
    """docs with every secret replaced by [SECRET]; overlapping spans become one. Other columns,
    null texts and repeated rows stay as they are; texts are read whole, whatever their length."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.fieldNames().index(text_col)

    def run(batches):
        for batch in batches:
            changed = [None if t is None else redacted(t, sent.value) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(changed, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return batched(docs).mapInArrow(run, docs.schema)
