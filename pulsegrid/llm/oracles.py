"""DuckDB SQL for the rows of the queries that SQL can express: op3, op5, op8, op9 and op13."""

from __future__ import annotations

from . import chat_format, sharding, url_filter
from .decontaminate import WIDTH


# --- op3: crc32 over bytes by the usual table of 256 entries, draws by md5 ---------------------------------------

_CRC_TABLE = """SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _draw(path: str, weight: float) -> str:
    bits = f"('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{path}'), 1, 13))::BIGINT"
    return f"-ln(({bits} + 0.5) / {float(1 << 52)}) / {weight}"


def _descend(node: dict, path: str = "") -> str:
    children = list(node.items())
    below = [_descend(c, f"{path}/{k}") if isinstance(c, dict) else str(k) for k, c in children]
    if len(below) == 1:
        return below[0]
    draws = ", ".join(_draw(f"{path}/{k}", sharding._weight(c)) for k, c in children)
    chosen = " ".join(f"WHEN {i + 1} THEN {b}" for i, b in enumerate(below))
    return f"CASE list_position([{draws}], list_min([{draws}])) {chosen} END"


SHARDS = f"""WITH tab AS ({_CRC_TABLE}),
 rows AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {_CRC} AS text_crc32,
  CAST({_descend(sharding.tree_for(8))} AS INT) AS shard, CAST({_descend(sharding.tree_for(9))} AS INT) AS grown_shard
  FROM documents, tab),
 placed AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT
  % greatest(1024, (SELECT count(*) FROM documents) // {sharding.BUCKET_ROWS}) AS bucket FROM rows)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
 row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""


# --- op5 ---------------------------------------------------------------------------------------------------------

EXACT = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


# --- op8: all windows of all documents against all windows of all items ------------------------------------------


def _words(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


def _windows(k: str) -> str:
    return f"unnest(range(1, len(w) - {k} + 2)) AS i"


WINDOWS = f"""WITH item AS ({_words("benchmark", "CAST(item_id AS VARCHAR) AS item")}),
 sized AS (SELECT item, w, least(len(w), {WIDTH}) AS k FROM item WHERE len(w) > 0),
 placed AS (SELECT item, w, k, {_windows("k")} FROM sized),
 known AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS words FROM placed),
 sizes AS (SELECT DISTINCT k FROM known),
 doc AS (SELECT row_number() OVER () AS r, doc_id, w FROM ({_words("documents", "doc_id")})),
 spread AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes),
 hits AS (SELECT r, i, s.k, item FROM spread s JOIN known n ON n.k = s.k AND n.words = array_to_string(w[i : i + s.k - 1], ' ')),
 hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
 items AS (SELECT r, list_sort(list(DISTINCT item)) AS a FROM hits WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(a), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(a, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


# --- op9: the rules, and all rounds of both ranks unrolled -------------------------------------------------------


def _host(url: str) -> str:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {host} ELSE '' END"


def _path(url: str) -> str:
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    return f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def _rank(name: str, seeds: str, src: str, dst: str) -> str:
    d = url_filter.DAMPING
    out = [
        f"{name}_s AS (SELECT host, n / sum(n) OVER () AS seed FROM (SELECT host, count(*)::DOUBLE AS n FROM judged WHERE host <> '' AND v = '{seeds}' GROUP BY host))",
        f"{name}_o AS (SELECT {src} AS host, sum(links)::DOUBLE AS k FROM links GROUP BY 1)",
        f"{name}_0 AS (SELECT host, seed AS rank FROM {name}_s)",
    ]
    for i in range(url_filter.ROUNDS):
        moved = f"SELECT {dst} AS host, {d} * rank * links / k AS rank FROM {name}_{i} JOIN {name}_o USING (host) JOIN links ON {src} = host"
        stuck = f"(SELECT coalesce(sum(rank), 0) FROM {name}_{i} WHERE host NOT IN (SELECT host FROM {name}_o))"
        back = f"SELECT host, seed * ({1 - d} + {d} * {stuck}) AS rank FROM {name}_s"
        out.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM ({moved} UNION ALL {back}) GROUP BY host)")
    return ",\n ".join(out)


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
_HREF = r"""(?i)\bhref\s*=\s*["'']?\s*(https?://[^"''\s<>]+)"""
_LAST = url_filter.ROUNDS
URLS = f"""WITH rules AS (SELECT * FROM (VALUES {_RULES}) r(v, h, p)),
 page AS (SELECT row_number() OVER () AS r, page_id, html, {_host("coalesce(url, '')")} AS host, {_path("coalesce(url, '')")} AS path FROM pages),
 fits AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, h || p) AS k
  FROM page JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
 judged AS (SELECT page.*, rule, v FROM page LEFT JOIN fits ON fits.r = page.r AND k = 1),
 links AS (SELECT src, dst, count(*) AS links FROM (SELECT host AS src, {_host("u")} AS dst FROM
  (SELECT host, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS u FROM page)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
 {_rank("t", "allow", "src", "dst")},
 {_rank("d", "block", "dst", "src")}
SELECT page_id, j.host, path, rule, round(coalesce(t.rank, 0), 9) AS trust, round(coalesce(d.rank, 0), 9) AS distrust,
 coalesce(v, CASE WHEN coalesce(d.rank, 0) > {url_filter.FLOOR} AND coalesce(d.rank, 0) > {url_filter.RATIO} * coalesce(t.rank, 0)
  THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN t_{_LAST} t ON t.host = j.host LEFT JOIN d_{_LAST} d ON d.host = j.host"""


# --- op13: turns as the source has them, and the length of each as the template writes it -------------------------

_TRAP = r"\### Assistant: </turn> ok"
_NAME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in chat_format.ROLES.items())
CHATS = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '{_TRAP}' FROM range(2) t(i)),
 written AS (SELECT *, regexp_replace(text, '(\\\\*{chat_format.CONTROL})', '\\\\\\1', 'g') AS body, CASE role {_NAME} ELSE '=' || hex(encode(role)) END AS name FROM said)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
 CAST(sum({len(chat_format.OPEN) + 2 + len(chat_format.END)} + length(name) + length(body)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""

ALL = {"op3_hash_tree": SHARDS, "op5_progressive_dedup": EXACT, "op8_window_decontamination": WINDOWS, "op9_link_propagation": URLS, "op13_grammar_round_trip": CHATS}
