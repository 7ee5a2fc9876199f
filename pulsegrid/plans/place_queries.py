"""Queries that join texts and points with gazetteers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demographics, places
from ..session import table
from .registry import query

_WORDS = "regexp_extract_all(lower(replace(coalesce(text, ''), '.', '')), '[\\p{L}\\p{N}]+')"
_GAZETTEER = f"""names AS (SELECT DISTINCT array_to_string(w[1 : k], ' ') AS name FROM (SELECT {_WORDS} AS w FROM benchmark), (VALUES (2), (3)) v(k) WHERE len(w) >= k)"""


@query("names_in_documents", f"""WITH RECURSIVE {_GAZETTEER}, doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 runs AS (SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS key FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM doc, (VALUES (2), (3)) v(k))),
 hits AS MATERIALIZED (SELECT doc_id, i AS s, max(k) AS n FROM runs JOIN names ON key = name GROUP BY doc_id, i),
 taken AS (SELECT doc_id, min(s) AS s, arg_min(n, s) AS n FROM hits GROUP BY doc_id UNION ALL SELECT t.doc_id, min(h.s), arg_min(h.n, h.s) FROM taken t JOIN hits h ON h.doc_id = t.doc_id AND h.s >= t.s + t.n GROUP BY t.doc_id)
 SELECT t.doc_id, key AS name, CAST(s AS INT) AS start, CAST(n AS INT) AS words FROM taken t JOIN runs r ON r.doc_id = t.doc_id AND r.i = s AND r.k = n""")
def _(s, d):
    """The first two and three words of each benchmark item as names, wherever documents have them."""
    w = places.words(F.col("text"))
    begin = table(s, d, "benchmark").select(F.explode(F.transform(F.filter(F.array(F.lit(2), F.lit(3)), lambda k: F.size(w) >= k), lambda k: F.array_join(F.slice(w, F.lit(1), k), " "))).alias("name"))
    out = places.names_in_texts(table(s, d, "documents"), begin.distinct(), id_col="doc_id")
    return out.select(F.col("id").alias("doc_id"), "name", "start", "words")


_CITIES = ", ".join(f"('{k}', '{c}', '{n}')" for k, c, _, n, *_rest in demographics.CITIES)


@query("cities_in_documents", f"""WITH RECURSIVE c AS (SELECT *, string_split(k, ' ') AS kw FROM (VALUES {_CITIES}) v(k, city, country)), sizes AS (SELECT DISTINCT len(kw) AS n FROM c),
 doc AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "coalesce(text, '') || ' ' || coalesce(source, '')")} AS w FROM documents),
 runs AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM doc, sizes)),
 hits AS MATERIALIZED (SELECT doc_id, i AS s, max(n) AS n FROM runs JOIN c ON key = array_to_string(kw, ' ') GROUP BY doc_id, i),
 taken AS (SELECT doc_id, min(s) AS s, arg_min(n, s) AS n FROM hits GROUP BY doc_id UNION ALL SELECT t.doc_id, min(h.s), arg_min(h.n, h.s) FROM taken t JOIN hits h ON h.doc_id = t.doc_id AND h.s >= t.s + t.n GROUP BY t.doc_id)
 SELECT DISTINCT t.doc_id, city, country FROM taken t JOIN runs r ON r.doc_id = t.doc_id AND r.i = s AND r.n = t.n JOIN c ON key = k""")
def _(s, d):
    """The fixed cities in whole texts and the names of their sources."""
    rows = table(s, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).alias("text"))
    return demographics.mentioned_cities(rows, id_col="doc_id")


@query("nearest_supplier", """WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 18000) / 100.0 - 90 AS la, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lo FROM customer),
 q AS (SELECT s_suppkey AS i, (s_suppkey * 6151 % 18000) / 100.0 - 90 AS lat, (s_suppkey * 12289 % 36000) / 100.0 - 180 AS lon FROM supplier),
 x AS (SELECT c_custkey, i, sqrt((la - lat) * (la - lat) + (lo - lon) * (lo - lon)) AS far FROM p, q)
 SELECT p.c_custkey, arg_min(i, (far, i)) AS supplier, round(min(far), 6) AS far FROM p LEFT JOIN x ON x.c_custkey = p.c_custkey AND far <= 20 GROUP BY ALL""")
def _(s, d):
    """Customers and suppliers dealt over the globe by their keys; the nearest supplier within 20 degrees."""
    at = lambda k, m, n, o: (k * m % n) / 100.0 - o
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    p = table(s, d, "customer").select("c_custkey", at(c, 7919, 18000, 90).alias("la"), at(c, 104729, 36000, 180).alias("lo"))
    q = table(s, d, "supplier").select(k.alias("i"), at(k, 6151, 18000, 90).alias("lat"), at(k, 12289, 36000, 180).alias("lon"))
    out = places.with_nearest(p, q, F.col("la"), F.col("lo"), 20.0)
    return out.select("c_custkey", F.col("near.i").alias("supplier"), F.round("near.far", 6).alias("far"))
