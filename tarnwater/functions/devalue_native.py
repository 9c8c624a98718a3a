"""The resolver of flat reference arrays as one recursive query, without Python in the tasks.

Slots become nodes, the references of a container its edges. The recursion walks from slot 0's data along the
edges; a place in the output is known by its path, the positions on the way to it. What is found at each place
yields tokens, which sorted by path and put together are the document. Numbers are written as Spark writes variants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.store import folder
from .devalue import WRAPPERS

#: Deepest nesting that is followed (of wrappers, too); a token's position behind all children of its place.
DEPTH, LAST = 1000, 2147483647

_NODES = """
    SELECT d.id, CAST(n.pos AS BIGINT) AS slot, n.value AS v, schema_of_variant(n.value) AS kind
    FROM (SELECT id, try_parse_json(raw) AS doc FROM {docs}) d, LATERAL variant_explode(CASE WHEN schema_of_variant(d.doc) LIKE 'ARRAY%' THEN d.doc END) n"""

_TAGGED = """
    SELECT *, CASE WHEN kind LIKE 'ARRAY%' AND size(items) = 2 AND schema_of_variant(items[0]) = 'STRING' THEN variant_get(items[0], '$', 'string') END AS tag
    FROM (SELECT *, CASE WHEN kind LIKE 'ARRAY%' THEN try_variant_get(v, '$', 'array<variant>') END AS items FROM {nodes})"""

#: (id, slot, i, lead, x): what a slot leads to. i is null for a wrapper, whose place is that of its target.
_EDGES = """
    SELECT id, slot, CAST(NULL AS INT) AS i, '' AS lead, items[1] AS x FROM {tagged} WHERE tag IN ({wrappers})
    UNION ALL
    SELECT id, slot, e.pos, CASE WHEN e.pos > 0 THEN ',' ELSE '' END, e.x FROM {tagged}, LATERAL posexplode(items) AS e(pos, x) WHERE kind LIKE 'ARRAY%' AND (tag IS NULL OR tag NOT IN ({wrappers}, 'Date'))
    UNION ALL
    SELECT id, slot, e.pos, (CASE WHEN e.pos > 0 THEN ',' ELSE '' END) || substring(to_json(array(e.x.key)), 2, length(to_json(array(e.x.key))) - 2) || ':', e.x.value
    FROM {tagged}, LATERAL posexplode(array_sort(map_entries(try_variant_get(v, '$', 'map<string, variant>')), (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)) AS e(pos, x) WHERE kind LIKE 'OBJECT%'"""

_REF = "CASE WHEN schema_of_variant({x}) = 'BIGINT' THEN variant_get({x}, '$', 'long') END"

_WALK = """
    WITH RECURSIVE walk(id, path, lead, ref, text, open, chain) MAX RECURSION LEVEL {depth} AS (
        SELECT id, array(0), '', {first}, CASE WHEN {first} IS NULL THEN to_json(x) END, CAST(array() AS ARRAY<BIGINT>), CAST(array() AS ARRAY<BIGINT>) FROM {roots}
        UNION ALL
        SELECT w.id, CASE WHEN e.i IS NULL THEN w.path ELSE concat(w.path, array(e.i)) END, CASE WHEN e.i IS NULL THEN w.lead ELSE e.lead END, e.ref, e.text,
               CASE WHEN e.i IS NULL THEN w.open ELSE array_append(w.open, w.ref) END, CASE WHEN e.i IS NULL THEN array_append(w.chain, w.ref) ELSE CAST(array() AS ARRAY<BIGINT>) END
        FROM walk w JOIN {edges} e ON e.id = w.id AND e.slot = w.ref
        WHERE w.ref IS NOT NULL AND NOT array_contains(w.open, w.ref) AND NOT array_contains(w.chain, w.ref))
    SELECT * FROM walk LIMIT ALL"""

#: What there is at each place: a literal, a scalar, a bracket before and one behind the children, or null.
_TOKENS = """
    SELECT id, t.path, t.token FROM (
        SELECT id, CASE
            WHEN ref IS NULL THEN array(struct(path, lead || text AS token))
            WHEN tag IN ({wrappers}) AND NOT closed THEN array()
            WHEN slot IS NULL OR closed THEN array(struct(path, lead || 'null' AS token))
            WHEN tag = 'Date' THEN array(struct(path, lead || to_json(try_variant_get(v, '$', 'array<variant>')[1]) AS token))
            WHEN brackets IS NULL THEN array(struct(path, lead || to_json(v) AS token))
            WHEN again THEN array(struct(path, lead || 'null' AS token))
            ELSE array(struct(path, lead || brackets[0] AS token), struct(concat(path, array({last})) AS path, brackets[1] AS token)) END AS found
        FROM (
            SELECT w.id, w.path, w.lead, w.ref, w.text, n.slot, n.v, n.tag, array_contains(w.chain, w.ref) AS closed, array_contains(w.open, w.ref) AS again,
                   CASE WHEN n.kind LIKE 'ARRAY%' THEN array('[', ']') WHEN n.kind LIKE 'OBJECT%' THEN array('{{', '}}') END AS brackets
            FROM {walk} w LEFT JOIN {tagged} n ON n.id = w.id AND n.slot = w.ref)), LATERAL explode(found) AS e(t)"""


def resolved(docs, depth=DEPTH, at=None):
    """(id, resolved) of docs (id, raw), ids unique: the canonical JSON of the graph behind each array, as `devalue.resolve` gives it.

    A reference back into a container that is open is null, so is one to no slot; shared entries are written
    at each place. A document that is no such array is null. A document's tokens are gathered in one row, as its text is. Beyond
    `depth` levels the query fails. Integers, strings, true, false and null are written alike in both forms.
    Every level of the walk joins the edges, so they are made once, in the folder `at` (a new one by default), as is the
    walk. It has no limit of rows: it ends, as no path enters an open container again.
    """
    spark, at = docs.sparkSession, at or folder(docs.sparkSession)

    def stored(df, name):
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    wrappers = ", ".join(f"'{w}'" for w in sorted(WRAPPERS))
    nodes = stored(spark.sql(_NODES, docs=docs.repartition("id")), "nodes")
    tagged = spark.sql(_TAGGED, nodes=nodes)
    edges = spark.sql(_EDGES.replace("{wrappers}", wrappers), tagged=tagged)
    ref = _REF.format(x="x")
    edges = edges.withColumn("ref", F.expr(ref)).withColumn("text", F.when(F.col("ref").isNull(), F.to_json("x"))).drop("x")
    edges = stored(edges, "edges")
    top = tagged.where("slot = 0 AND kind LIKE 'OBJECT%'").select("id", F.expr("try_variant_get(v, '$', 'map<string, variant>')").alias("m")).where("map_contains_key(m, 'data')").select("id", F.expr("m['data']").alias("x"))
    walk = spark.sql(_WALK.replace("{depth}", str(depth)).replace("{first}", ref), roots=top, edges=edges)
    walk = stored(walk, "walk")
    tokens = spark.sql(_TOKENS.replace("{wrappers}", wrappers).replace("{last}", str(LAST)), walk=walk, tagged=tagged)
    text = tokens.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "token"))), lambda t: t["token"]), "").alias("t"))
    # an object with a single key stands for its value: what is behind {"key": and before }
    keys = "map_keys(CAST(try_parse_json(t) AS MAP<STRING, VARIANT>))"
    single = F.expr(f"CASE WHEN t LIKE '{{%' AND size({keys}) = 1 THEN {keys}[0] END")
    lead = "length(to_json(array(key)))"
    whole = F.expr(f"CASE WHEN key IS NULL THEN t ELSE substring(t, {lead} + 1, length(t) - {lead} - 1) END")
    found = text.withColumn("key", single).select("id", whole.alias("resolved"))
    return docs.select("id").join(found, "id", "left")
