"""BPE encoding and decoding by tree concatenation.

A text falls into words between white space, and these into pretokens, whose encodings do not
depend on each other; each distinct one is encoded once. A pretoken that stays long (text without
spaces) is halved again and again; the leaves are encoded in one parallel batch, and each join is
mended by encoding a window around it anew, grown until the window's outer tokens are those that
either side has at the same place. From there on, merges on either side have run exactly as they
would in the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from tokenizers import Tokenizer, models

from .common import keyed, steps, texts

#: Characters of byte-level text that are encoded in one piece, and tokens a window starts with.
LEAF, WINDOW = 512, 8
#: Distinct words, and pretokens, whose encodings are kept; beyond that the table starts anew.
KEPT = 1 << 19
#: White space as the vocabulary's patterns know it; str.split() takes four controls for it as well.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROL = re.compile("[\x1c-\x1f]")
#: Below this, lower case is the same for a character alone as in its context (but for İ).
PLAIN = re.compile("[^\u0000-įı-ɏ]")


def byte_chars():
    """The character that stands for each byte: itself if it prints, else the next free one from 256."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


def understood(spec):
    """Whether a tokenizer is of the sort that Codec handles: NFC, white space as one space, lower
    case; a split whose pretokens hold no white space, then bytes; plain BPE; tokens joined by a space."""
    parts = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    model = spec["model"]
    return (
        parts == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
        and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and spec["decoder"] is None and spec["post_processor"] is None
        and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


class Codec:
    """Encodes as the tokenizer given as JSON; `leaf` and `window` change speed only. ValueError
    for a tokenizer of another sort than `understood` describes."""

    def __init__(self, text, leaf=LEAF, window=WINDOW):
        spec = json.loads(text)
        if not understood(spec):
            raise ValueError("not a lower-casing word-level BPE tokenizer without decoder")
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.inner = Tokenizer(models.BPE(model["vocab"], merges))  # a piece that does not end its word
        self.final = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None))
        self.token = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.chars = byte_chars()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretoken = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, special))})")
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.leaf, self.window = leaf, window
        self.memo, self.words = {}, {}  # (ids, decoded) of pretokens and of words

    # -- one long pretoken ---------------------------------------------------------------------

    def raw(self, pieces, final):
        """Ids of byte-level pieces; final says of each whether its end is the end of the word."""
        out = [None] * len(pieces)
        for kind, tokenizer in ((False, self.inner), (True, self.final)):
            at = [i for i, f in enumerate(final) if f == kind]
            for i, e in zip(at, tokenizer.encode_batch([pieces[i] for i in at], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def size(self, i, last=False):
        return len(self.token[i]) - (len(self.suffix) if last else 0)

    def long(self, word):
        """Ids of a long pretoken: leaves in one batch, then the joins of each level in batches."""
        mapped = "".join(self.chars[b] for b in word.encode())
        pieces = [mapped[a : a + self.leaf] for a in range(0, len(mapped), self.leaf)]
        nodes = list(zip(pieces, self.raw(pieces, [i == len(pieces) - 1 for i in range(len(pieces))])))
        while len(nodes) > 1:
            last = len(nodes) // 2 - (len(nodes) % 2 == 0)
            pairs = list(zip(nodes[::2], nodes[1::2]))
            joined = self.join(pairs, last if len(nodes) % 2 == 0 else -1)
            nodes = joined + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][1]

    def join(self, pairs, ends):
        """Concatenations of pairs of (text, ids); the pair numbered `ends` holds the word's end."""
        out, width = [None] * len(pairs), [self.window] * len(pairs)
        open_ = list(range(len(pairs)))
        while open_:
            windows = []
            for k in open_:
                (left, a), (right, b) = pairs[k]
                i, j = max(0, len(a) - width[k]), min(len(b), width[k])
                to_end = j == len(b)
                tail = sum(self.size(t) for t in a[i:])
                head = len(right) if to_end else sum(self.size(t) for t in b[:j])
                windows.append((i, j, to_end, left[len(left) - tail :] + right[:head]))
            again = []
            for k, (i, j, to_end, _), ids in zip(open_, windows, self.raw([w[3] for w in windows], [w[2] and k == ends for k, w in zip(open_, windows)])):
                (left, a), (right, b) = pairs[k]
                agree = (i == 0 or ids[:2] == a[i : i + 2] and len(a) - i > 2) and (to_end or ids[-2:] == b[j - 2 : j] and j > 2)
                if agree:
                    out[k] = (left + right, a[:i] + ids + b[j:])
                else:
                    width[k] *= 2
                    again.append(k)
            open_ = again
        return out

    # -- whole texts ---------------------------------------------------------------------------

    def both(self, ids):
        return " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def coded(self, pretoken):
        """(ids, decoded) of a pretoken."""
        if len(pretoken) > self.leaf:  # rarely met again, and of any size: not kept
            return self.both(self.long(pretoken))
        found = self.memo.get(pretoken)
        if found is None:  # by the model alone: all that stands before it in the tokenizer is done already
            tokens = self.final.model.tokenize("".join([self.chars[b] for b in pretoken.encode()]))
            found = self.memo[pretoken] = " ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens])
        return found

    def word(self, word):
        """(ids, decoded) of what stands between white space."""
        if word.isalpha() and not PLAIN.search(word):
            return self.coded(word.lower())
        out = []
        for k, part in enumerate(self.special.split(word) if "<|" in word else [word]):
            if k % 2:
                out.append((str(self.special_id[part]), part))
            else:  # what isn't plain may be lower-cased or composed in its context
                part = self.library.normalizer.normalize_str(part) if PLAIN.search(part) else part.lower()
                out += map(self.coded, self.pretoken.findall(part))
        return " ".join([f[0] for f in out]), " ".join([f[1] for f in out])

    def __call__(self, strings):
        """For each string: number of tokens, their ids and the decoded text, as the library gives them."""
        cut = [s.split() if not CONTROL.search(s) else [w for w in WHITE.split(s) if w] for s in strings]
        if len(self.words) > KEPT:
            self.words = {}
        if len(self.memo) > KEPT:
            self.memo = {}
        new = set().union(*cut).difference(self.words)
        self.words.update((w, self.word(w)) for w in new)
        for words in cut:
            ids, decoded = zip(*map(self.words.__getitem__, words)) if words else ((), ())
            ids = " ".join(filter(None, ids))
            yield ids.count(" ") + 1 if ids else 0, ids, " ".join(filter(None, decoded))
        for w in new:
            if len(w) > self.leaf:
                del self.words[w]


@lru_cache(maxsize=1)
def codec_of(text):
    """One codec for all tasks of a worker: its memory is not given back between them."""
    return Codec(text)


def encode_decode(docs, tokenizer_path, id_col="doc_id", text_col="text", keep_texts=True):
    """One row per row of docs: n_tokens, ids (decimal, joined by a space) and decoded text, with
    their SHA-256 (the strings themselves only with keep_texts).

    Null and empty texts have no tokens and decode to nothing. Repeated rows each get their own
    row; an empty table gives an empty result; other columns of docs are not read. A text of any
    length is encoded whole; memory follows the longest text. The vocabulary, whose size is fixed,
    is broadcast; nothing is shuffled. ValueError for a tokenizer of another sort (see `understood`).
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = codec_of(text.value)
        for batch in batches:
            strings = texts(batch)
            rows = [r for a, b in steps(map(len, strings)) for r in coded(codec, strings[a:b], keep_texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows))] if rows else [batch.column(0), *[pa.array([], pa.int64())], *[pa.array([], pa.string())] * (2 + 2 * keep_texts)], names)

    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids string", "decoded string"] * keep_texts
    names = ["doc_id", *(f.split()[0] for f in fields)]
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(fields)).withColumnRenamed("doc_id", id_col)


def coded(codec, strings, keep_texts):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n, ids, decoded in codec(strings):
        yield (n, sha(ids), sha(decoded), *((ids, decoded) if keep_texts else ()))
