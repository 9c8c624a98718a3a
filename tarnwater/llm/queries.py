"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe_codec import encode_decode
from .common import table
from .conversation_repair import damaged, repair
from .conversation_repair import oracle as repair_oracle
from .embedding_dedup import link
from .fingerprints import compare_with_edits
from .language_id import identify
from .lexical_search import search
from .line_dedup import drop_repeated_lines
from .line_dedup import oracle as line_oracle
from .online_packing import pack_online
from .packing import pack
from .secret_scan import scan
from .secret_scan import train as train_secrets
from .shingle_join import link as link_shingles
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark, sf_dir):
    """Bytes of every document that no 400-byte string found elsewhere covers, as a digest, and the words under runs of
    over 50 words that another document has, of whatever length in bytes; no SQL: every byte starts a window."""
    docs = remove_repeats(table(spark, sf_dir, "documents"), keep="none", words=51)
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), "n_repeated_words")


@query
def op2_secret_scan(spark, sf_dir):
    """Secrets in every document; no SQL: the added spans come from a trained model."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train_secrets(docs))


@query
def op3_packing(spark, sf_dir):
    """All documents packed into sequences by their words; no SQL: each place depends on those before."""
    return pack(table(spark, sf_dir, "documents"))


@query
def op4_bpe_codec(spark, sf_dir):
    """Ids and decoded text of every document, as digests; no SQL: merges need a loop per word."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_texts=False)


@query
def op5_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text; no SQL: hashes of all spans."""
    return compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op6_shingle_join(spark, sf_dir):
    """Components of documents whose sets of 4-word shingles are alike to 0.85."""
    return link_shingles(table(spark, sf_dir, "documents"))


ORACLE_SQL["op6_shingle_join"] = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct([ws[i:i + 3] FOR i IN range(1, len(ws) - 2)]) WHEN len(ws) > 0 THEN [ws] ELSE [] END AS ss FROM w),
    e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
    f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
    p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM (SELECT * FROM e SEMI JOIN f USING (x)) a JOIN (SELECT * FROM e SEMI JOIN f USING (x)) b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    r AS (SELECT doc_id AS i, doc_id AS root FROM documents UNION SELECT p.j, r.root FROM r JOIN p ON p.i = r.i)
    SELECT s.doc_id, coalesce(len(ss), 0) AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.i = s.doc_id GROUP BY ALL
    """


@query
def op7_line_dedup(spark, sf_dir):
    """Lines of every document, those of later repeated runs, and a digest of the text that is left."""
    docs = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op7_line_dedup"] = line_oracle()


@query
def op8_language_id(spark, sf_dir):
    """Language of every document, learnt from those that aren't held out; no SQL: a trained model."""
    return identify(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark, sf_dir):
    """Bytes and tokens of every document; no SQL: merges need a loop per word."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_embedding_dedup(spark, sf_dir):
    """Links and components of all vectors; no SQL: it would have to compare all pairs."""
    return link(table(spark, sf_dir, "embeddings"))


@query
def op11_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation, after a damage that its ids decide."""
    return repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")


ORACLE_SQL["op11_conversation_repair"] = repair_oracle()


@query
def op12_online_packing(spark, sf_dir):
    """Token ids of all documents in sequences of 4096, a row per piece; no SQL: merges need a loop per word."""
    return pack_online(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_lexical_search(spark, sf_dir):
    """The twenty documents that match each benchmark item best."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op13_lexical_search"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    k AS (SELECT item_id, t, count(*) AS c FROM q GROUP BY ALL),
    s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
    o AS (SELECT x.doc_id, x.n, x.t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) x SEMI JOIN k ON x.t = k.t GROUP BY ALL),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, s GROUP BY t),
    r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM o JOIN w USING (t) JOIN k USING (t), s GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """
