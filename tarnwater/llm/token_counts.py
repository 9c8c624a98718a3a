"""Token counts by a finite-state transducer.

The split of a text into pretokens (letters, digits, other signs, each with at most one space
before; contractions; runs of white space) is a deterministic transducer over 12 classes of
characters and 12 states. A transition emits where tokens begin; the end of a pretoken emits its
number of tokens, from a table of pretokens that is compiled as they first occur. Many texts go
through it at once: they are cut into chunks of equal length, each chunk yields a map from the
state it is entered in to the state it is left in, and a parallel prefix scan composes these maps.
"""

from __future__ import annotations

import re
from functools import lru_cache
from json import loads

import numpy as np
import pyarrow as pa
import regex

from .bpe_codec import byte_chars
from .common import STEP, keyed, prefix_hashes, span_hashes, steps, texts

# The vocabulary's pretoken pattern, whose contractions the table below follows.
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, STMD, R, V, EL, EE, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, END = range(12)
START, IN_L, IN_N, IN_O, SP, WS, SPS, WSS, AP, AP_RV, AP_L, DONE = range(12)
HERE, BEFORE = 1, 2  # a token begins at this character, at the one before
CHUNK = 256
SURE = regex.compile(r"(?<=\S)(?=\s)")
#: Separates texts; where a text holds it itself, it is an ordinary character.
SEPARATOR = "\U0010ffff"


def compile_table():
    """(next state, what is emitted) for each state and class."""
    fresh = {LETTER: IN_L, STMD: IN_L, R: IN_L, V: IN_L, EL: IN_L, EE: IN_L, NUMBER: IN_N, SPACE: SP, WHITE: WS, APOSTROPHE: AP, OTHER: IN_O, END: START}
    letters, spaces = {LETTER, STMD, R, V, EL, EE}, {SPACE, WHITE}
    run = lambda c: IN_L if c in letters else IN_N if c == NUMBER else IN_O
    to, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    for s in range(12):
        for c in range(12):
            to[s, c], out[s, c] = fresh[c], HERE
            if s == IN_L and c in letters or s == IN_N and c == NUMBER or s == IN_O and c in (OTHER, APOSTROPHE):
                to[s, c], out[s, c] = s, 0
            elif s in (SP, WS, SPS, WSS) and c in spaces:
                to[s, c], out[s, c] = (SPS if c == SPACE else WSS), 0
            elif s in (SP, SPS) and c != END:
                to[s, c], out[s, c] = run(c), BEFORE if s == SPS else 0
            elif s == WSS and c != END:
                out[s, c] = HERE | BEFORE
            elif s == AP and c in (STMD, R, V, EL, OTHER, APOSTROPHE):
                to[s, c], out[s, c] = {STMD: DONE, R: AP_RV, V: AP_RV, EL: AP_L}.get(c, IN_O), 0
            elif s == AP_RV and c == EE or s == AP_L and c == EL:
                to[s, c], out[s, c] = DONE, 0
            elif s in (AP_RV, AP_L):
                to[s, c], out[s, c] = (IN_L, BEFORE) if c in letters else (fresh[c], HERE | BEFORE)
    return to.ravel(), out.ravel()


def character_classes():
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        for m in regex.finditer(f"{pattern}+", every):
            a, b = (i + 0x800 * (i >= 0xD800) for i in (m.start(), m.end() - 1))
            out[a : b + 1] = c  # no run spans the surrogates: their neighbours are neither
    for chars, c in (("stmd", STMD), ("r", R), ("v", V), ("l", EL), ("e", EE), (" ", SPACE), ("'", APOSTROPHE)):
        out[[ord(x) for x in chars]] = c
    return out


def at_spaces(text, most=STEP):
    """text, cut about every `most` characters, where white space follows another character: a
    token begins there whatever stands before, so the counts of the pieces add up."""
    a = 0
    while len(text) - a > most and (m := SURE.search(text, a + most)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


def understood(spec):
    """Whether a tokenizer is of the sort that Transducer handles: byte-level BPE with the pattern
    above, no normalizer, nothing that depends on more than the pretoken."""
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    return (
        spec["normalizer"] is None and spec["post_processor"] is None
        and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    )


def ragged(start, length):
    """The places start, start + 1, ... of each of many spans, one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def equal_spans(x, a, y, b, length):
    """Whether x[a:a + length] and y[b:b + length] agree, for arrays of places a, b and lengths."""
    differ = np.zeros(len(length) + 1, bool)
    differ[np.repeat(np.arange(len(length)), length)[x[ragged(a, length)] != y[ragged(b, length)]]] = True
    return ~differ[:-1]


class Transducer:
    """Counts tokens as the tokenizer given as JSON does; ValueError for one of another sort."""

    #: Pretokens whose counts are kept, with their characters; beyond that the table starts anew.
    KEPT = 1 << 20
    #: Longer ones are counted each time.
    LONGEST = 64

    def __init__(self, json):
        from tokenizers import Tokenizer

        if not understood(loads(json)):
            raise ValueError("not a byte-level BPE tokenizer of the known split")
        self.tokenizer = Tokenizer.from_str(json)
        self.chars = byte_chars()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.to, self.out = compile_table()
        self.classes = character_classes()
        self.forget()

    def forget(self):
        # sorted hashes of known pretokens, their counts, and where their characters are
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kept, self.used = np.zeros(1 << 16, np.uint32), 0

    def starts(self, classes):
        """Where tokens begin, over the classes of consecutive texts, each ended by END."""
        n = len(classes)
        rows = -(-n // CHUNK)
        columns = np.full(rows * CHUNK, END, np.intp)
        columns[:n] = classes
        columns = np.ascontiguousarray(columns.reshape(rows, CHUNK).T)
        maps = np.tile(np.arange(12, dtype=np.intp) * 12, (rows, 1))
        to = self.to.astype(np.intp) * 12
        for c in columns:
            maps = to[maps + c[:, None]]
        maps //= 12
        shift = 1
        while shift < rows:  # after this, maps[i] leads through all chunks up to i
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].copy(), 1)
            shift *= 2
        state = np.concatenate([[START], maps[:-1, START]]) * 12
        emitted = np.empty(columns.shape, np.uint8)
        for i, c in enumerate(columns):
            at = state + c
            emitted[i] = self.out[at]
            state = to[at]
        emitted = emitted.T.ravel()[:n]
        begin = emitted & HERE > 0
        begin[:-1] |= emitted[1:] & BEFORE > 0
        return begin

    def by_model(self, piece):
        """Tokens of one pretoken, by merging its bytes."""
        return len(self.tokenizer.model.tokenize("".join([self.chars[b] for b in piece.encode("utf-8", "surrogatepass")])))

    def learn(self, points, start, length, hashes, counts):
        """Keep the counts of pretokens points[start:start + length], sorted by hash, not known yet."""
        if len(self.known) + len(hashes) > self.KEPT:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        own = points[ragged(start, length)]
        while self.used + len(own) > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros(len(self.kept), np.uint32)])
        self.kept[self.used : self.used + len(own)] = own
        place = self.used + np.cumsum(length) - length
        self.used += len(own)
        for name, new in (("known", hashes), ("counts", counts), ("place", place), ("size", length)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def counted(self, whole, points, a, b):
        """Tokens of each pretoken points[a:b]. Hashes find those that were met before; that they
        are the same is settled by comparing their characters."""
        keys, first, inverse = np.unique(span_hashes(prefix_hashes(points), a, b), return_index=True, return_inverse=True)
        start, length = a[first], (b - a)[first]
        same = (b - a) == length[inverse]
        same[same] = equal_spans(points, a[same], points, start[inverse[same]], (b - a)[same])
        out = np.full(len(keys), -1, np.int64)
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            taken = self.known[i] == keys
            hit = np.flatnonzero(taken & (self.size[i] == length))
            hit = hit[equal_spans(points, start[hit], self.kept, self.place[i[hit]], length[hit])]
            out[hit] = self.counts[i[hit]]
        else:
            taken = np.zeros(len(keys), bool)
        new = np.flatnonzero(out < 0)
        out[new] = [self.by_model(whole[x : x + n]) for x, n in zip(start[new].tolist(), length[new].tolist())]
        new = new[~taken[new] & (length[new] <= self.LONGEST)]
        self.learn(points, start[new], length[new], keys[new], out[new])
        total = out[inverse]
        for i in np.flatnonzero(~same).tolist():  # another pretoken of the same hash
            total[i] = self.by_model(whole[a[i] : b[i]])
        return total

    def count(self, parts):
        """Tokens of each part; parts hold no special tokens."""
        whole = SEPARATOR.join(parts) + SEPARATOR
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.classes[points]
        classes[ends] = END
        begin = self.starts(classes)
        begin[ends] = True
        at = np.flatnonzero(begin)
        last = np.append(at[1:], len(points))
        word = classes[at] != END
        total = np.zeros(len(at), np.int64)
        total[word] = self.counted(whole, points, at[word], last[word])
        # each part ends at a separator, which is itself a beginning that counts nothing
        sums = np.concatenate([[0], np.cumsum(total)])
        upto = sums[np.searchsorted(at, ends)]
        return np.diff(np.concatenate([[0], upto]))

    def __call__(self, strings):
        """Tokens of each string; a special token's string counts as one token and parts the text."""
        parts, owner, out = [], [], np.zeros(len(strings), np.int64)
        for i, s in enumerate(strings):
            cut = self.special.split(s) if self.special else [s]
            out[i] += len(cut) - 1
            cut = [piece for part in cut for piece in at_spaces(part)]
            parts += cut
            owner += [i] * len(cut)
        owner = np.array(owner, np.int64)
        for a, b in steps([len(p) for p in parts]):
            np.add.at(out, owner[a:b], self.count(parts[a:b]))
        return out


@lru_cache(maxsize=1)
def transducer_of(json):
    """One transducer for all tasks of a worker: its memory is not given back between them."""
    return Transducer(json)


def count_tokens(docs, tokenizer_path, id_col="doc_id", text_col="text", limit=1024):
    """One row per row of docs: its bytes, its tokens, whether these exceed `limit`.

    Null and empty texts have no bytes and no tokens. Repeated rows each get their own row; an
    empty table gives an empty result; other columns of docs, whatever their names, are not read.
    A text of any length is counted whole, in pieces cut where white space begins. The vocabulary,
    whose size is fixed, is broadcast; nothing is shuffled. ValueError for a tokenizer of another
    sort (see `understood`).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        json = spark.sparkContext.broadcast(f.read())

    def run(batches):
        transducer = transducer_of(json.value)
        for batch in batches:
            strings = texts(batch)
            counts = transducer(strings)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s.encode()) for s in strings], pa.int64()), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_col)
