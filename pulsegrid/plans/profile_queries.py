"""Queries over users and vectors: places, ages, personas, audiences, collections, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import demographics, vectors
from ..session import table
from ..sources.views import load
from .registry import query

_TIER = "CASE WHEN {0} <= 5 THEN 'casual' WHEN {0} <= 25 THEN 'active' WHEN {0} <= 100 THEN 'power_user' ELSE 'broadcaster' END".format

# --- ids and collections -------------------------------------------------------------------------------------------

_NAMES = "CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '18446744073709551616' WHEN 2 THEN 'user ' || c_custkey WHEN 3 THEN upper('6ba7b810-9dad-11d1-80b4-00c04fd430c8') WHEN 4 THEN '{6ba7b8109dad11d180b400c04fd4' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '}' ELSE 'é' || c_custkey END"
_MADE = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(n))"
_HYPHENS = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)".format
_UUID5 = "substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(h, 18, 15)"
_POINT = f"CASE WHEN regexp_full_match(n, '[0-9]+') AND length(n) < 20 THEN n WHEN regexp_full_match(b, '[0-9a-f]{{32}}') THEN {_HYPHENS('b')} ELSE {_HYPHENS('u')} END"


def _names():
    k = F.col("c_custkey")
    c = k.cast("string")
    shapes = (
        c, F.lit("18446744073709551616"), F.concat(F.lit("user "), c), F.upper(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8")),
        F.concat(F.lit("{6ba7b8109dad11d180b400c04fd4"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("}")), F.concat(F.lit("é"), c),
    )
    return F.element_at(F.array(*shapes), (k % 6 + 1).cast("int"))


@query("point_ids", f"SELECT c_custkey, {_POINT} AS point_id FROM (SELECT *, {_UUID5} AS u FROM (SELECT c_custkey, n, {_MADE} AS h, replace(replace(replace(lower(n), '-', ''), '{{', ''), '}}', '') AS b FROM (SELECT c_custkey, {_NAMES} AS n FROM customer)))")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", vectors.point_id(_names()).alias("point_id"))


_QUERY = [round(((i * 37) % 64 - 32) / 32, 4) for i in range(64)]


def _cos(v: str, e: str = "embedding") -> str:
    dot = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])".format
    return f"({dot(e, v)} / (sqrt({dot(e, e)}) * sqrt({dot(v, v)})))"


@query("collection_search", f"WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN [-x FOR x IN embedding::DOUBLE[]] ELSE embedding::DOUBLE[] END AS e FROM embeddings) SELECT CAST(vec_id AS VARCHAR) AS original_id, round({_cos(str(_QUERY), 'e')}, 6) AS score, CAST(label AS VARCHAR) AS label FROM v WHERE {_cos(str(_QUERY), 'e')} >= 0.1 ORDER BY {_cos(str(_QUERY), 'e')} DESC, vec_id LIMIT 25")
def _(s, d):
    e = table(s, d, "embeddings")
    store = vectors.Collections()
    store.create("v")
    store.upsert("v", vectors.points(e, "vec_id", payload=("label",)))
    turned = e.filter("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    store.upsert("v", vectors.points(turned, "vec_id", payload=("label",)))
    out = store.search("v", _QUERY, 25, 0.1)
    return out.select("original_id", F.round("score", 6).alias("score"), F.get_json_object("payload", "$.label").alias("label"))


@query("collection_counts", "SELECT 'made' AS step, 1::BIGINT AS n UNION ALL SELECT 'again', 0 UNION ALL SELECT 'points', count(*) FROM embeddings UNION ALL SELECT 'deleted', 0")
def _(s, d):
    store = vectors.Collections()
    steps = [("made", int(store.create("v"))), ("again", int(store.create("v")))]
    store.upsert("v", vectors.points(table(s, d, "embeddings"), "vec_id"))
    store.upsert("v", vectors.points(table(s, d, "embeddings").limit(50), "vec_id"))
    steps.append(("points", store.count("v")))
    store.delete("v")
    steps.append(("deleted", store.count("v")))
    return s.createDataFrame(steps, "step string, n bigint")


_CLASSES = {f"class_{k}": [1.0 if i % 8 == k else 0.0 for i in range(64)] for k in range(8)}
_INTERESTS = {name: [f"{name} a", f"{name} b", "shared"] for name in _CLASSES}
_C = "c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{k}' AS c, {v} AS v, {_INTERESTS[k]} AS t" for i, (k, v) in enumerate(_CLASSES.items())) + ")"


@query("taxonomy_rows", f"WITH {_C} SELECT c AS id, CAST(list_sum(v) AS DOUBLE) AS weight, array_to_string(t, '|') AS interests FROM c")
def _(s, d):
    rows = vectors.taxonomy(s, _CLASSES, _INTERESTS)
    return rows.select("id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("weight"), F.array_join("interests", "|").alias("interests"))


# --- personas and ages by vectors ----------------------------------------------------------------------------------

_SIM = f"{_C}, sim AS (SELECT vec_id, i, c, t, {_cos('v')} AS s FROM embeddings, c), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS r FROM sim)"


@query("persona_profiles", f"WITH {_SIM} SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN 'General & Everyday Lifestyle' ELSE a.c END AS persona, CASE WHEN a.vec_id % 7 = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, a.s)), 3) END::DOUBLE AS confidence, array_to_string(CASE WHEN b.s > 0.1 THEN list_distinct_in(a.t, b.t) ELSE a.t END, '|') AS interests FROM best a JOIN best b USING (vec_id) WHERE a.r = 1 AND b.r = 2".replace("list_distinct_in(a.t, b.t)", "list_concat(a.t, [x FOR x IN b.t[1:2] IF NOT list_contains(a.t, x)])[1:5]"))
def _(s, d):
    text = F.when(F.col("vec_id") % 7 == 0, "abc").otherwise("a longer bio")
    e = table(s, d, "embeddings").withColumn("who", vectors.persona(text, F.col("embedding"), _CLASSES))
    similar = F.array(*[vectors.cosine(F.col("embedding"), F.array(*map(F.lit, v))) for v in _CLASSES.values()])
    return e.select("vec_id", "who.persona", "who.confidence", F.array_join(vectors.interests(similar, _INTERESTS, 0.1), "|").alias("interests"))


_B = demographics.BRACKETS
_ANCHORS = {b: [1.0 if i % 6 == k else 0.0 for i in range(64)] for k, b in enumerate(_B)}
_AGE = "[" + ", ".join(_cos(str(v)) for v in _ANCHORS.values()) + "]"


@query("age_ensemble", f"""WITH a AS (SELECT vec_id, {_AGE} AS s FROM embeddings), e AS (SELECT *, [exp((x - list_max(s)) / 0.15) FOR x IN s] AS p FROM a), n AS (SELECT vec_id, [x / list_sum(p) FOR x IN p] AS p FROM e),
 m AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN [1 / 6.0::DOUBLE, 1 / 6.0, 1 / 6.0, 1 / 6.0, 1 / 6.0, 1 / 6.0] ELSE p END AS p FROM n),
 x AS (SELECT vec_id, [round(CASE WHEN vec_id % 3 = 0 THEN 0.6 * p[i] + 0.4 * (CASE WHEN i = vec_id % 6 + 1 THEN 0.5 ELSE 0.1 END) ELSE p[i] END, 4) FOR i IN range(1, 7)] AS q FROM m),
 t AS (SELECT vec_id, q, q[1] + q[2] + q[3] + q[4] + q[5] + q[6] AS total FROM x), u AS (SELECT vec_id, [round(v / total, 4) FOR v IN q] AS q FROM t),
 w AS (SELECT vec_id, q, round(1 - (q[1] + q[2] + q[3] + q[4] + q[5] + q[6]), 4) AS drift, list_position(q, list_max(q)) AS top FROM u),
 y AS (SELECT vec_id, [CASE WHEN i = top THEN round(q[i] + drift, 4) ELSE q[i] END FOR i IN range(1, 7)] AS q FROM w)
 SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '65+' ELSE list_extract({list(_B)}, list_position(q, list_max(q))) END AS bracket, CASE WHEN vec_id % 11 = 0 THEN 0.9 ELSE round(list_max(q), 3) END::DOUBLE AS confidence,
 CASE WHEN vec_id % 11 = 0 THEN 'regex' WHEN vec_id % 3 = 0 THEN 'ensemble' ELSE 'bio_vector' END AS source FROM y""")
def _(s, d):
    k = F.col("vec_id")
    similar = F.array(*[vectors.cosine(F.col("embedding"), F.array(*map(F.lit, v))) for v in _ANCHORS.values()])
    other = F.when(k % 3 == 0, F.array(*[F.when(k % 6 == i, 0.5).otherwise(0.1) for i in range(6)]))
    stated = F.when(k % 11 == 0, "65+")
    rows = table(s, d, "embeddings").withColumn("similar", similar).withColumn("other", other)
    out = vectors.age_shares(F.when(k % 5 == 0, "ab").otherwise("a longer bio"), F.col("similar"), stated, F.col("other"), _B)
    return rows.select("vec_id", out.alias("age")).select("vec_id", "age.bracket", F.round("age.confidence", 3).alias("confidence"), "age.source")


# --- profiles and audiences ----------------------------------------------------------------------------------------

#: Some users' bios state an age and places that the resolver knows; the rest keep their own.
_BIOS = ("I am 21", "retired teacher", "born in 1990", "father of two", "nothing said")
_SPOTS = ("Austin, TX", "Berlin, DE", "UT: 40.7,-74.0", "nowhere at all")
_AGED = ("18-24", "65+", "35-49", "35-49", "unknown")
_SPOTTED = (("United States", "Austin"), ("Germany", "Berlin"), ("United States", "New York"), (None, None))


def _people(s, d) -> DataFrame:
    k = F.substring("id", 2, 20).cast("bigint")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return load(s, d, "users").select("id", "screen_name", pick(_SPOTS).alias("location_raw"), pick(_BIOS).alias("bio"))


def _sql_pick(names) -> str:
    return f"CASE CAST(substr(id, 2) AS BIGINT) % {len(names)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if n is None else f"'{n}'") for i, n in enumerate(names)) + " END"


_PROFILES = f"""c AS (SELECT author_id AS id, count(*) AS n FROM posts GROUP BY 1), prof AS (SELECT id, {_sql_pick([c for c, _ in _SPOTTED])} AS country, {_sql_pick([c for _, c in _SPOTTED])} AS city, {_sql_pick(_AGED)} AS age_bracket, coalesce(n, 0) AS posts, {_TIER('coalesce(n, 0)')} AS tier FROM users LEFT JOIN c USING (id))"""


@query("profiles_full", f"WITH {_PROFILES} SELECT * FROM prof", ("users", "posts"))
def _(s, d):
    return demographics.profiles(_people(s, d), load(s, d, "posts"), 2026).select("id", "country", "city", "age_bracket", "posts", "tier")


@query("audience_full", f"""WITH {_PROFILES}, f AS (SELECT DISTINCT source_id AS id FROM graph_edges WHERE target_id = 'u3'), own AS (SELECT prof.* FROM prof JOIN f USING (id)),
 g AS (SELECT 'age_bracket' AS dimension, age_bracket AS key, count(*) AS users FROM own GROUP BY ALL UNION ALL SELECT 'country', coalesce(country, 'Unknown'), count(*) FROM own GROUP BY ALL UNION ALL SELECT 'city', city, count(*) FROM own WHERE city IS NOT NULL GROUP BY ALL UNION ALL SELECT 'tier', tier, count(*) FROM own GROUP BY ALL)
 SELECT dimension, CASE WHEN users < 5 THEN 'Other / Low Count' ELSE key END AS key, CAST(sum(users) AS BIGINT) AS users FROM g GROUP BY ALL""", ("users", "posts", "graph_edges"))
def _(s, d):
    return demographics.audience(load(s, d, "graph_edges"), _people(s, d), load(s, d, "posts"), "u3", 2026)


@query("audience_without_follows", "SELECT DISTINCT source_id AS id FROM graph_edges WHERE target_id = 'u4'", ("graph_edges",))
def _(s, d):
    return demographics.followers_of(load(s, d, "graph_edges").withColumn("relation_type", F.lit("MENTIONS")), "u4")


@query("breakdown_all", f"""WITH {_PROFILES}, g AS (SELECT 'country' AS dimension, country AS key, count(*) AS users FROM prof WHERE country IS NOT NULL GROUP BY ALL UNION ALL SELECT 'city', city, count(*) FROM prof WHERE city IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'age_bracket', age_bracket, count(*) FROM prof GROUP BY ALL UNION ALL SELECT 'tier', tier, count(*) FROM prof GROUP BY ALL UNION ALL SELECT 'persona', 'p' || CAST(substr(id, 2) AS BIGINT) % 3, count(*) FROM prof GROUP BY ALL UNION ALL SELECT 'language', CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'en' ELSE 'fr' END, count(*) FROM prof GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY users DESC, key) AS k FROM g) SELECT dimension, key, users FROM r WHERE dimension <> 'city' OR k <= 2""", ("users", "posts"))
def _(s, d):
    k = F.substring("id", 2, 20).cast("bigint")
    full = demographics.profiles(_people(s, d), load(s, d, "posts"), 2026)
    full = full.withColumns({"persona": F.concat(F.lit("p"), (k % 3).cast("string")), "language": F.when(k % 2 == 0, "en").otherwise("fr")})
    return demographics.breakdown(full, {c: None for c in ("country", "city", "age_bracket", "tier", "persona", "language")}, {"city": 2})


@query("quiet_users", "SELECT id AS user_id, 0::BIGINT AS posts, 0 AS peak_hour, 'casual' AS tier FROM users WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 0", ("users",))
def _(s, d):
    even = F.substring("id", 2, 20).cast("bigint") % 2 == 0
    out = demographics.behaviour(load(s, d, "posts").limit(0), load(s, d, "users").filter(even))
    return out.select("user_id", "posts", "peak_hour", "tier")


@query("cities_in_texts", """SELECT DISTINCT doc_id, city, country FROM (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [{'city': 'Austin', 'country': 'United States'}, {'city': 'Berlin', 'country': 'Germany'}] WHEN 1 THEN [{'city': 'New York', 'country': 'United States'}] ELSE [] END, recursive := true) FROM documents)""")
def _(s, d):
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, "From Austin to BERLIN, back to austin.").when(k % 4 == 1, "nyc, New York; nycity").otherwise("no place here")
    rows = table(s, d, "documents").select(k.cast("string").alias("id"), text.alias("text"))
    return demographics.mentioned_cities(rows).select(F.col("id").cast("bigint").alias("doc_id"), "city", "country")


# --- languages -----------------------------------------------------------------------------------------------------

_WORDS = "string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+|[@#]\\S+', ' ', 'g'), '[^\\p{L}\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '\\s+', ' ', 'g'))), ' ')"
_SHARES = ", ".join(f"{{'c': len([x FOR x IN w IF list_contains({words}, x)]) * 1.0 / greatest(1, len(w)), 'l': '{lang}'}}" for lang, words in T.COMMON.items())


@query("language_counts", f"SELECT lang, count(*) AS documents FROM (SELECT CASE WHEN b.c > 0 THEN b.l ELSE 'en' END AS lang FROM (SELECT list_max([{_SHARES}]) AS b FROM (SELECT {_WORDS} AS w FROM documents))) GROUP BY lang")
def _(s, d):
    lang = T.language_guess(F.col("text"))["lang"].alias("lang")
    return table(s, d, "documents").select(lang).groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "lang")
