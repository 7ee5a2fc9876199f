"""Secrets in texts: three fixed patterns, and runs of characters that a random-string model explains better.

The method: two first-order character Markov models, one of random strings and one of ordinary identifiers and words,
are trained from labelled samples. A candidate run of characters is a secret if the log-likelihood ratio of the two
passes a threshold. Candidates are all runs of LEAST_CHARS characters of ALPHABET or more, of whatever kind, in what
the fixed rules leave of a text; the ratio alone decides. Both models end as one table of log ratios per character pair, at most 65 x 65 whole numbers
(thousandths), which is a constant of the scan: scoring is a sum of array look-ups inside the row.

Spans are those of whole matches, in code points, end exclusive. Defined cases: a null text is an empty one; empty
texts have no spans; long texts are scanned whole; repeated rows are scanned each; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import array_sum, let, prefix_sums, text_of

# The patterns of the base rules and the least lengths of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "markov")

#: Characters that a candidate is made of; any other counts as one more symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST_CHARS = 16
BACKOFF = 8.0
#: Thousandths of a nat that the ratio must reach: a prior of about one secret in 160,000 candidates.
THRESHOLD = 12_000
#: Most documents whose words are samples of ordinary text, and how many random strings are made; both are defaults
#: of parameters of labelled_samples.
SAMPLE_DOCUMENTS, SAMPLE_STRINGS = 500, 4_000

# Identifiers as they stand in code and configuration.
IDENTIFIERS = """
access_log account_id add_listener api_version app_settings application_name array_length async_handler auth_method base_url
batch_size buffer_size build_number cache_dir callback_function character_encoding checkpoint_interval client_name column_names
config_file connection_pool content_type continue_on_error count_distinct created_at current_user data_source database_name
default_value delete_account device_type display_name document_root download_link email_address enable_logging end_offset
environment_variable error_message event_handler execution_time expected_result export_format file_extension first_name
foreign_key format_string function_name get_or_create global_state group_members hash_table header_value hostname http_request
image_width include_path index_column initial_state input_stream instance_type integer_overflow is_enabled iteration_count
java_home job_scheduler json_parser kernel_version key_value_store language_code last_modified library_path line_number
load_balancer local_storage log_level main_thread max_connections memory_limit message_queue method_name middle_name
module_exports network_interface next_page node_modules number_of_items object_mapper on_click_event operating_system
order_status output_directory package_manager page_number parent_directory parse_arguments partition_count password_reset
performance_test plugin_registry port_number primary_key process_identifier project_root property_name public_interface
query_string queue_depth random_seed read_timeout record_type redirect_url release_notes remote_host render_template
request_body resource_group response_code retry_policy return_value root_directory sample_rate schema_version search_results
security_group select_statement sequence_number server_address service_account session_timeout shared_memory show_warnings
sort_order source_code start_position status_message storage_class string_builder submit_button support_ticket system_properties
table_prefix target_platform task_manager temporary_file test_coverage thread_count time_zone token_expired total_amount
tracking_number transaction_log tree_node update_interval upload_folder user_preferences utility_class validate_input
variable_name vertical_align virtual_machine web_application window_height worker_process write_permission xml_document
""".split()


def _ordinary() -> list[str]:
    """IDENTIFIERS, three of them as a path, a dotted, hyphenated or joined name, and rules of one character."""
    n, out = len(IDENTIFIERS), list(IDENTIFIERS)
    for i, name in enumerate(IDENTIFIERS):
        parts = [name, IDENTIFIERS[(7 * i + 3) % n], IDENTIFIERS[(11 * i + 5) % n]]
        words = [w for p in parts for w in p.split("_")]
        out += ["/.-_"[i % 4].join(parts), "".join(map(str.title, words)), f"{parts[0]}{i % 10}"]
    return out + [c * 60 for c in "-=_.+/ax0"]


def labelled_samples(
    spark: SparkSession, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    documents: int = SAMPLE_DOCUMENTS, strings: int = SAMPLE_STRINGS,
) -> DataFrame:
    """(sample, is_random): made random strings; ordinary ones, which are IDENTIFIERS alone and in paths and names, rules,
    numbers and dates, and the words of documents of so many ids at most, as they stand, in capitals and as titles.

    Random strings are hex, base64 and capitals with digits, from hashes of counters, so they are the same everywhere.
    """
    h = F.sha2(F.col("id").cast("string"), 256)
    shapes = F.array(h, F.substring(h, 1, 40), F.regexp_replace(F.base64(F.unhex(h)), "=", ""), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(h, 512))), "[^A-Za-z0-9]", "")), 1, 32))
    out = spark.range(strings // 4, numPartitions=1).select(F.explode(shapes).alias("sample"), F.lit(True).alias("is_random"))
    out = out.union(spark.range(1).select(F.explode(F.array(*map(F.lit, _ordinary()))).alias("sample"), F.lit(False)))
    digits = F.regexp_replace(F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 512), "[a-f]", "")
    dates = F.date_format(F.timestamp_seconds(F.col("id") * 1_234_567), "yyyy-MM-dd/HH.mm.ss")
    numbers = F.array(F.substring(digits, 1, 19), F.concat_ws(".", *[F.substring(digits, 1 + 3 * i, 3) for i in range(5)]), dates)
    out = out.union(spark.range(strings // 8, numPartitions=1).select(F.explode(numbers).alias("sample"), F.lit(False)))
    if docs is not None:
        rows = docs.select(text_of(text_col).alias("t"), F.xxhash64(F.col(id_col)).alias("h"))
        some = rows.select("h").orderBy("h").limit(documents)  # no text is gathered to choose
        words = rows.join(F.broadcast(some), "h", "left_semi").select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z][a-z]+"), 0)).alias("sample")).distinct()
        shapes = F.array(F.col("sample"), F.upper("sample"), F.initcap("sample"))  # prose is shouted and titled, too
        out = out.union(words.select(F.explode(F.array_distinct(shapes)).alias("sample"), F.lit(False)))
    return out


def _codes(c: Column) -> Column:
    """Positions in ALPHABET from 1, 0 for any other character."""
    return F.transform(F.split(c, ""), lambda x: F.call_function("locate", x, F.lit(ALPHABET)))


def train_markov(samples: DataFrame) -> list[int]:
    """Log ratio of random to ordinary for each pair of codes, in thousandths; row-major.

    A character's followers are smoothed by BACKOFF sightings of what all characters are followed by.
    """
    n = len(ALPHABET) + 1
    codes = samples.filter("length(sample) > 1").select("is_random", _codes(F.col("sample")).alias("c"))
    pairs = codes.select("is_random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * n + b)).alias("p"))
    counts = {(r["is_random"], r["p"]): r["k"] for r in pairs.groupBy("is_random", "p").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most 2 * n * n rows
    from math import log

    def logs(label: bool) -> list[float]:
        rows = [[counts.get((label, a * n + b), 0) for b in range(n)] for a in range(n)]
        totals = [sum(row[b] for row in rows) for b in range(n)]
        alone = [(t + 0.5) / (sum(totals) + 0.5 * n) for t in totals]
        return [log((x + BACKOFF * p) / (sum(row) + BACKOFF)) for row in rows for x, p in zip(row, alone, strict=True)]

    return [round(1000 * (r - o)) for r, o in zip(logs(True), logs(False), strict=True)]


def _found(text: Column, pattern: str, kind: int, keep=None, group: int | None = None) -> Column:
    """array<struct<start, kind, end, match>> of all matches, in linear time: starts are sums of the lengths of what lies between."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    ends = prefix_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: g + F.length(m)))
    parts = [ends, matches] + ([F.regexp_extract_all(text, F.lit(pattern), F.lit(group))] if group else [])
    names = ("e", "m", "g")[: len(parts)]
    rows = F.arrays_zip(*[p.alias(k) for p, k in zip(parts, names, strict=True)])
    if keep is not None:
        rows = F.filter(rows, lambda x: keep(x["g"] if group else x["m"]))
    return F.transform(rows, lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["m"].alias("match")))


def _masked(text: Column, pattern: str, found: Column, least: int | None = None, group: int = 0) -> Column:
    """text with blanks in place of the matches that count, in linear time; places stay."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    decides = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    blank = lambda m, g: F.when(F.length(g) >= (least or 0), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    put = F.concat(F.zip_with(matches, decides, blank), F.array(F.lit("")))
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(F.split(text, pattern, -1), put, lambda g, m: F.concat(g, m)), "")).otherwise(text)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans and n_markov. A map over rows: no shuffle."""
    t, none = F.col("_t"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,match:string>>")
    low = F.lower(t)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).select(
        "_id", "_t",
        F.when(named, _found(t, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_LEAST, 2)).otherwise(none).alias("_assign"),
        F.when(F.contains(t, F.lit("AKIA")), _found(t, ACCESS, 1, lambda v: F.length(v) >= ACCESS_LEAST)).otherwise(none).alias("_access"),
        F.when(t.rlike("[0-9a-f]{32}"), _found(t, HEX, 2)).otherwise(none).alias("_hex"),
    )
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    if model:
        n, weights = len(ALPHABET) + 1, F.lit(model)
        pair = lambda a, b: F.get(weights, (a * n + b).cast("int")).cast("bigint")
        ratio = lambda c: array_sum(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), pair))
        likely = lambda v: let(_codes(v), ratio) >= threshold
        rows = rows.withColumn("_left", _masked(F.col("_t"), ASSIGN, F.col("_assign"), ASSIGN_LEAST, 2))
        rows = rows.withColumn("_left", _masked(F.col("_left"), ACCESS, F.col("_access"), ACCESS_LEAST))
        rows = rows.withColumn("_left", _masked(F.col("_left"), HEX, F.col("_hex")))
        run = "[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CHARS
        some = F.col("_left").rlike(run.replace(",", ""))
        rows = rows.withColumn("_new", F.when(some, _found(F.col("_left"), run, 3, likely)).otherwise(none))
    else:
        rows = rows.withColumn("_new", none)
    count = lambda c: F.size(c).cast("bigint")
    return rows.select(
        F.col("_id").alias(id_col), count("_assign").alias("n_assign"), count("_access").alias("n_access"), count("_hex").alias("n_hex"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("_base", "_new"))).alias("spans"), count("_new").alias("n_markov"),
    )
