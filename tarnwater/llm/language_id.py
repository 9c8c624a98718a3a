"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, all else counts as a space; every 2- and 3-gram is hashed into one of
2**15 buckets. The model is a matrix of log-probabilities, buckets by languages, that is broadcast;
a batch of texts is scored by gathering its rows and summing them text by text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import batched, keyed, sampled, steps, texts

BITS = 15
#: At most so many labelled rows are learnt from: those with the least hashes of their id.
SAMPLE_ROWS = 6000
#: n-grams beyond which a longer text makes the posterior no surer.
EVIDENCE = 60
UNDETERMINED = "und"


@dataclass
class Model:
    """Languages in order and log-probabilities; its size is 2**15 * languages * 4 bytes."""

    languages: list
    prior: np.ndarray
    weights: np.ndarray


def letters():
    """For each code point: itself if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    every = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint32)
    out[every] = every
    return out


def buckets(strings, fold):
    """(bucket of each n-gram, where each text's begin, its letters) over the texts in one array."""
    # a space before and after each text, so that none of its n-grams reaches into the next text
    lower = [s.lower() for s in strings]
    whole = "".join(f" {s} " for s in lower) + " "
    points = fold[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(s) + 2 for s in lower])
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.add.reduceat((points != 32).astype(np.int64), starts) if strings else np.zeros(0, np.int64)
    mix = lambda *parts: (sum(p * np.uint32(k) for p, k in zip(parts, (2654435761, 2246822519, 3266489917))) >> np.uint32(32 - BITS)).astype(np.intp)
    a, b = points[:-1], points[1:]
    pairs = mix(a, b)
    triples = np.append(mix(a[:-1], b[:-1], points[2:]), 0)  # the last has no third character
    blank = (a == 32) & (b == 32)
    return pairs, triples, blank, starts, counts


def train(docs, label_col="lang", id_col="doc_id", text_col="text", sample_rows=SAMPLE_ROWS):
    """A model from the labelled rows of docs (label not null), at most about `sample_rows` of
    them (rows that share an id come or go together). Null texts count as empty. None if there is no such row.

    Counts are summed in Spark; what reaches the driver is one row per language and bucket.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("label IS NOT NULL")
    rows = sampled(rows, sample_rows)

    def run(batches):
        fold = letters()
        for batch in batches:
            strings, labels = texts(batch, 0), np.array(batch.column(1).to_pylist(), object)
            for label in sorted(set(labels)):
                own = [strings[i] for i in np.flatnonzero(labels == label)]
                total = np.zeros(1 << BITS, np.int64)
                for a, b in steps(map(len, own)):
                    pairs, triples, blank, _, _ = buckets(own[a:b], fold)
                    total += np.bincount(pairs[~blank], minlength=1 << BITS) + np.bincount(triples[~blank], minlength=1 << BITS)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([label] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(total[some], len(own)))], ["label", "bucket", "n"])

    found = rows.select("text", "label").mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    languages = sorted(found.label.unique())
    counts = np.zeros((1 << BITS, len(languages)))
    rows_of = np.zeros(len(languages))
    at = found.label.map({x: k for k, x in enumerate(languages)}).to_numpy()
    gram = found.bucket.to_numpy() >= 0
    counts[found.bucket.to_numpy()[gram], at[gram]] = found.n.to_numpy()[gram]
    rows_of[at[~gram]] = found.n.to_numpy()[~gram]
    smooth = counts + 0.05
    return Model(languages, np.log(rows_of / rows_of.sum()), np.log(smooth / smooth.sum(0)).astype(np.float32))


def scored(strings, model, fold):
    """(index of the language or -1, posterior) of each string."""
    best, score = np.full(len(strings), -1), np.zeros(len(strings))
    for a, b in steps(map(len, strings), 1 << 18):
        pairs, triples, blank, starts, n_letters = buckets(strings[a:b], fold)
        sums = model.weights[pairs] + model.weights[triples]
        sums[blank] = 0
        sums = np.add.reduceat(sums, starts, axis=0, dtype=np.float64)
        grams = np.maximum(1, 2 * np.add.reduceat((~blank).astype(np.int64), starts))
        sums = sums * (np.minimum(grams, EVIDENCE) / grams)[:, None] + model.prior
        sums -= sums.max(1, keepdims=True)
        posterior = np.exp(sums) / np.exp(sums).sum(1, keepdims=True)
        top = posterior.argmax(1)
        some = n_letters > 0
        best[a:b][some] = top[some]
        score[a:b][some] = posterior.max(1)[some]
    return best, score


def predict(docs, model, id_col="doc_id", text_col="text"):
    """One row per row of docs: lang_pred and score, from its text alone.

    `und` with score 0 for a null text or one without a letter, and for all texts if there is no
    model. score is the posterior, with the evidence of longer texts scaled down to EVIDENCE
    n-grams. Repeated rows each get their own row; an empty table gives an empty result;
    other columns are not read. A text of any length is scored whole, at some tens of bytes a character.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fold, model = letters(), sent.value
        for batch in batches:
            strings = texts(batch)
            best, score = scored(strings, model, fold) if model else (np.full(len(strings), -1), np.zeros(len(strings)))
            named = [model.languages[k] if k >= 0 else UNDETERMINED for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def held_out(id_col="doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1 (not for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs):
    """Predictions for all rows by a model of those that aren't held out."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs, least=0.5):
    """docs (with doc_id, text and lang, which the model learns from) without the rows whose language is
    undetermined or less likely than `least`; all columns stay, whatever else there is.

    Null and empty texts, and those without letters, are undetermined. The prediction is made beside each row,
    so nothing is joined and repeated rows stay repeated. A text of any length is scored whole.
    """
    model = train(docs.where(~held_out()))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        fold, model = letters(), sent.value
        for batch in batches:
            strings = texts(batch, at)
            best, score = scored(strings, model, fold) if model else (np.full(len(strings), -1), np.zeros(len(strings)))
            yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return batched(docs).mapInArrow(run, docs.schema)
