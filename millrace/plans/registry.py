"""Queries of the core engine by name, and the DuckDB SQL that gives the same rows.

Most run over the entities that ``readers.derived_entities`` makes of every page: whole titles, in several forms and
scripts.  All seven channels have SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import addresses, indic, phonetic
from millrace.functions import names as N
from millrace.operators import candidates as C
from millrace.operators import channels as H
from millrace.operators import pairing, quality, sampling
from millrace.operators.normalize import COLUMNS, normalize, split_by_country
from millrace.plans import oracle as O
from millrace.sources import readers, sinks
from millrace.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.derived_entities(spark, sf_dir)


_records: dict[tuple[str, str], DataFrame] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records of all derived entities: a stored stage, written by the first query of a session that needs it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _records:
        _records[key] = staged(normalized(spark, sf_dir))
    return _records[key]


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(entities(spark, sf_dir).withColumn("split", F.lit("train")))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(S1 records, target records), normalised once behind a stage boundary."""
    all_records = records(spark, sf_dir)
    return all_records.where("src = 's1'"), all_records.where("src <> 's1'")


def name(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return entities(spark, sf_dir).select("entity_id", *[c.alias(k) for k, c in columns.items()])


RAW = F.col


@query(O.with_(O.NAMES, f"SELECT entity_id, {O.dotted('business_name')} AS name FROM names"))
def dotted_legal(spark, sf_dir):
    """N1."""
    return name(spark, sf_dir, name=N.dotted_legal(RAW("business_name")))


@query(O.with_(O.NAMES, "SELECT entity_id, regexp_replace(business_name || ' | ' || business_address, '[\\pP\\pS]', ' ', 'g') AS name FROM names"))
def punctuation_to_spaces(spark, sf_dir):
    """N2."""
    return name(spark, sf_dir, name=N.punctuation_to_spaces(F.concat_ws(" | ", "business_name", "business_address")))


@query(O.with_(O.NAMES, "SELECT entity_id, cleaned FROM names"))
def base_clean(spark, sf_dir):
    """N3, N4, N16."""
    return name(spark, sf_dir, cleaned=N.base_clean(RAW("business_name")))


@query(O.with_(O.NAMES, "SELECT entity_id, array_to_string(w1, ' ') AS consecutive, len(list_distinct(w0)) AS n_distinct FROM names"))
def dedup_tokens(spark, sf_dir):
    """N5, N6."""
    rows, words = name(spark, sf_dir, w=N.tokens(N.base_clean(RAW("business_name")))), F.col("w")
    return rows.select("entity_id", F.array_join(N.dedup_consecutive(words), " ").alias("consecutive"), F.size(N.dedup_all(words)).cast("long").alias("n_distinct"))


@query(O.with_(O.NAMES, "SELECT entity_id, array_to_string(list_transform(string_split(lower(business_address), ' '), lambda t: CASE WHEN regexp_matches(t, '\\pL') AND regexp_matches(t, '[0-9]') THEN translate(t, '6051', 'gosl') ELSE t END), ' ') AS fixed FROM (SELECT entity_id, replace(business_address, ' ', 'x ') AS business_address FROM names)"))
def ocr_fix(spark, sf_dir):
    """N7, switched on, over address tokens that end in a letter."""
    words = F.split(F.lower(F.replace(F.col("business_address"), F.lit(" "), F.lit("x "))), " ")
    return name(spark, sf_dir, fixed=F.array_join(N.fix_ocr(words), " "))


@query(O.with_(O.NAMES, "SELECT entity_id, array_to_string(w2, ' ') AS canonical, array_to_string(w3, ' ') AS stripped FROM names"))
def suffix_strip(spark, sf_dir):
    """N8, N9."""
    words, keys = F.col("w"), F.col("f")
    rows = name(spark, sf_dir, w=N.tokens(N.base_clean(RAW("business_name")))).withColumn("w", N.dedup_consecutive(words))
    rows = rows.withColumn("f", N.folded_tokens(words, False)).withColumn("w", N.canonical_suffixes(words, keys)).withColumn("f", N.folded_tokens(words, False))
    return rows.select("entity_id", F.array_join("w", " ").alias("canonical"), F.array_join(N.strip_suffixes(words, keys), " ").alias("stripped"))


@query(O.with_(O.NAMES, f"""SELECT entity_id, name_full, {O.joined('v')} AS name_no_suffix, {O.joined(O.consecutive('list_sort(v)'))} AS name_sorted, {O.joined('v[1:2]')} AS name_first2
FROM (SELECT entity_id, clean AS name_full, {O.stripped(O.words('clean'))} AS v FROM names)"""))
def name_variants(spark, sf_dir):
    """N10, N11."""
    base = staged(N.with_latin_name(entities(spark, sf_dir), "business_name", "n").select("entity_id", "n"))
    return base.select("entity_id", *[c.alias(k) for k, c in N.name_variants(F.col("n")).items()])


@query(O.with_(O.NAMES, f"""SELECT entity_id AS id, script_type AS script FROM names
UNION ALL SELECT 'a' || entity_id, CASE WHEN regexp_matches(business_address, '{O.INDIC}') THEN {O.script_of('business_address')} ELSE 'latin' END FROM names
UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), CASE WHEN regexp_matches(text, '{O.INDIC}') THEN {O.script_of('text')} ELSE 'latin' END FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"""))
def script_detect(spark, sf_dir):
    """N12 over names, addresses and whole texts of documents."""
    rows = entities(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and doc_id is not null")
    every = rows.selectExpr("entity_id as id", "business_name as t").unionByName(rows.selectExpr("concat('a', entity_id) as id", "business_address as t"))
    every = every.unionByName(docs.selectExpr("concat('d', doc_id) as id", "text as t"))
    return every.select("id", N.script_type(F.col("t")).alias("script"))


@query("SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS ascii_md5 FROM documents WHERE text IS NOT NULL")
def nfkd_ascii(spark, sf_dir):
    """N13 over whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.select("doc_id", F.md5(N.to_ascii(F.col("text"))).alias("ascii_md5"))


@query(O.with_(O.ADDRESSES, """SELECT DISTINCT business_name AS native, script_type AS script, array_to_string(addresses.roman, ' ') AS roman FROM addresses WHERE script_type NOT IN ('latin', 'mixed')
UNION SELECT DISTINCT business_address, 'address', address_transliterated FROM addresses WHERE address_transliterated <> lower(business_address)"""))
def transliterate(spark, sf_dir):
    """N14, A1 over the distinct names in native scripts and addresses with other characters than ASCII."""
    rows = entities(spark, sf_dir).withColumn("script", N.script_type(F.col("business_name")))
    native = rows.where("script not in ('latin', 'mixed')").select(F.col("business_name").alias("native"), "script").distinct()
    spoken = rows.select(F.col("business_address").alias("native"), F.lit("address").alias("script")).distinct()
    spoken = staged(spoken.withColumn("roman", indic.transliterate_address(F.col("native")))).where("roman <> lower(native)")
    return native.withColumn("roman", indic.transliterate_name(F.col("native"), F.col("script"))).unionByName(spoken)


@query(f"SELECT page_id, regexp_matches(url, '{N.K.DOMAIN_NAME}', 'i') AS is_domain_name FROM pages WHERE url IS NOT NULL")
def domain_flag(spark, sf_dir):
    """PF6."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select("page_id", N.is_domain_name(F.col("url")).alias("is_domain_name"))


@query(f"SELECT doc_id, CASE WHEN v IS NULL OR v IN ({O.quoted(N.K.NA_VALUES)}) THEN '' ELSE v END AS folded, lower(trim(coalesce(v, ''))) IN ({O.quoted(N.K.NULL_STRINGS)}) AS is_null FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'NA' WHEN 1 THEN ' -- ' WHEN 2 THEN NULL WHEN 3 THEN 'None' ELSE source END AS v FROM documents)")
def null_fold(spark, sf_dir):
    """PF5 and the folding of missing values at read."""
    v = F.expr("case doc_id % 6 when 0 then 'NA' when 1 then ' -- ' when 2 then null when 3 then 'None' else source end")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", v.alias("v"))
    return docs.select("doc_id", N.null_fold(F.col("v")).alias("folded"), N.is_null_text(F.col("v")).alias("is_null"))


@query("SELECT n_name, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT n_name, lower(trim(regexp_replace(n_name, '[^\\pL\\pN_]', '_', 'g'), '_')) AS s FROM nation)")
def country_slug(spark, sf_dir):
    """SK3."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", N.slug(F.col("n_name")).alias("slug"))


@query(O.with_(O.ADDRESSES, "SELECT entity_id, array_to_string(tokens, '|') AS tokens FROM addresses WHERE has_address"))
def tokenize_address(spark, sf_dir):
    """A2."""
    rows = entities(spark, sf_dir).where(~N.is_null_text(F.col("business_address"))).select("entity_id", addresses.tokenize(F.col("business_address")).alias("t"))
    return rows.where(F.size("t") > 0).select("entity_id", F.array_join("t", "|").alias("tokens"))


def _fields(*columns: str):
    return O.with_(O.ADDRESSES, f"SELECT entity_id, {', '.join(columns)} FROM addresses"), lambda spark, sf_dir: records(spark, sf_dir).select("entity_id", *columns)


for _name, _columns in {
    "state_token": ["state_token"],
    "postal_code": ["pin_code", "zip_code"],
    "street_num": ["street_num"],
    "locality_tokens": ["locality_tokens"],
    "address_fields": ["has_address", "pin_code", "zip_code", "street_num", "state_token", "locality_tokens", "address_transliterated"],
}.items():
    ORACLE_SQL[_name], QUERIES[_name] = _fields(*_columns)

_RECORD = """SELECT entity_id, country, business_name AS raw_name, business_address AS raw_address, name_full, name_no_suffix, name_sorted, name_first2, name_ascii,
name_transliterated, name_transliterated_no_suffix, script_type, is_domain_name, has_address,
pin_code, zip_code, street_num, locality_tokens, state_token, address_transliterated, country_key, src FROM addresses"""


@query(O.with_(O.ADDRESSES, _RECORD))
def normalized_records(spark, sf_dir):
    """PF1, PF2: the 20 columns, not from the stored stage."""
    return normalized(spark, sf_dir).select(*COLUMNS, "country_key", "src")


@query(O.with_(O.NAMES, "SELECT 'train' AS split, country, count_if(src = 's1') AS s1, count_if(src = 's2') AS s2, count_if(src = 's3') AS s3 FROM names GROUP BY country"))
def country_partition_summary(spark, sf_dir):
    """AG12, SK5."""
    return sinks.partition_summary(records(spark, sf_dir))


@query(O.with_(O.NAMES, "SELECT country, src, count(*) AS n FROM names GROUP BY ALL"))
def country_partitions(spark, sf_dir):
    """E9."""
    return split_by_country(records(spark, sf_dir))


@query(O.with_(O.ADDRESSES, "SELECT entity_id, country, script_type, is_domain_name, has_address, 'train_' || src AS source_file FROM addresses"))
def subgroup_flags(spark, sf_dir):
    """SK2's flags, ST7."""
    return sinks.subgroup_flags(records(spark, sf_dir))


@query(O.with_(O.ADDRESSES, "SELECT count(*) AS n, count_if(script_type <> 'latin') AS n_non_latin, count_if(NOT has_address) AS n_missing_address, count_if(is_domain_name) AS n_domain FROM addresses"))
def subgroup_counts(spark, sf_dir):
    """AG13."""
    return sinks.subgroup_counts(sinks.subgroup_flags(records(spark, sf_dir)))


@query(O.with_(O.NAMES, "SELECT script_type, count(*) AS n FROM names GROUP BY ALL"))
def script_counts(spark, sf_dir):
    """AG13's value counts."""
    return sinks.script_counts(sinks.subgroup_flags(records(spark, sf_dir)))


@query(O.with_(O.NAMES, "SELECT DISTINCT country_key FROM names"))
def discover_countries(spark, sf_dir):
    """SC6."""
    return readers.discover_countries(records(spark, sf_dir))


@query(O.with_(O.NAMES, "SELECT entity_id, src, country FROM names QUALIFY row_number() OVER (PARTITION BY country, src ORDER BY entity_id) <= 20"))
def explorer_head(spark, sf_dir):
    """SC10, PF4: the first 20 rows of each file."""
    return readers.head_of_each(entities(spark, sf_dir), 20, ["country", "src"], ["entity_id"]).select("entity_id", "src", "country")


@query(O.with_(f"{O.ADDRESSES}, {O.A_STRONG}", f"SELECT {O.PAIR} FROM a_strong"))
def chan_a_strong(spark, sf_dir):
    """J-A1 to J-A3, J-A5."""
    return H.channel_a_strong(*parts(spark, sf_dir))


@query(O.with_(f"{O.ADDRESSES}, {O.A_STRONG}, {O.A_FALLBACK}", f"SELECT {O.PAIR} FROM a_fallback"))
def chan_a_fallback(spark, sf_dir):
    """J-A4."""
    s1, targets = parts(spark, sf_dir)
    return H.channel_a_fallback(s1, targets, H.channel_a_strong(s1, targets))


@query(O.with_(f"{O.ADDRESSES}, {O.B_DF}", "SELECT country_key, src, token, df, round(idf, 9) AS idf FROM bd"))
def chan_b_df(spark, sf_dir):
    """AG1, AG2."""
    return H.token_weights(parts(spark, sf_dir)[1]).withColumn("idf", F.round("idf", 9))


@query(O.with_(f"{O.ADDRESSES}, {O.B_DF}, {O.B_HITS}", f"SELECT {O.PAIR} FROM b_hits"))
def chan_b_idf(spark, sf_dir):
    """J-B, AG3."""
    return H.channel_b(*parts(spark, sf_dir))


@query(O.with_(f"{O.ADDRESSES}, {O.C_SHINGLES}", "SELECT name, array_to_string(list_sort(g), '|') AS shingles FROM cn"))
def chan_c_shingles(spark, sf_dir):
    """J-C'."""
    rows = records(spark, sf_dir).select(F.explode(F.array("name_no_suffix", "name_sorted")).alias("name")).where("name <> ''").distinct()
    return rows.select("name", F.array_join(F.array_sort(H.shingles(F.col("name"), 3)), "|").alias("shingles"))


@query(O.with_(f"{O.ADDRESSES}, {O.C_SHINGLES}, {O.C_HITS}", f"SELECT {O.PAIR} FROM c_hits"))
def chan_c_lsh(spark, sf_dir):
    """J-C."""
    return H.channel_c(*parts(spark, sf_dir))


@query(O.with_(f"{O.ADDRESSES}, {O.D_CODES}", "SELECT token, code FROM dmc"))
def phonetic_codes(spark, sf_dir):
    """J-D's keys: the codes of every distinct name token."""
    words = N.tokens(F.concat_ws(" ", "name_no_suffix", "name_transliterated_no_suffix"))
    return phonetic.coded(records(spark, sf_dir).select(F.explode(words).alias("token")).distinct())


@query(O.with_(f"{O.ADDRESSES}, {O.D_CODES}, {O.D_HITS}", f"SELECT {O.PAIR} FROM d_hits"))
def chan_d_phonetic(spark, sf_dir):
    """J-D."""
    return H.channel_d(*parts(spark, sf_dir))


@query(O.with_(f"{O.ADDRESSES}, {O.E_HITS}", f"SELECT {O.PAIR} FROM e_hits"))
def chan_e_tfidf_topk(spark, sf_dir):
    """J-E, AG14, AG15, W1."""
    return H.channel_e(*parts(spark, sf_dir))


@query(O.with_(f"{O.ADDRESSES}, {O.F_HITS}", f"SELECT {O.PAIR} FROM f_hits"))
def chan_f_tfidf_addr(spark, sf_dir):
    """J-F."""
    return H.channel_f(*parts(spark, sf_dir))


@query(O.with_(f"{O.ADDRESSES}, {O.G_HITS}", f"SELECT {O.PAIR} FROM g_hits"))
def chan_g_sorted(spark, sf_dir):
    """J-G."""
    return H.channel_g(*parts(spark, sf_dir))


@query(O.with_(O.UNION, "SELECT country_key, s1_id, target_id, agreement, priority FROM u"))
def channel_union(spark, sf_dir):
    """AG4 to AG6, ST1, over all seven channels."""
    return pairing.all_pairs(*parts(spark, sf_dir)).select("country_key", "s1_id", "target_id", F.col("agreement").cast("long").alias("agreement"), "priority")


def capped_report(s1, targets):
    return C.report(s1, pairing.best_pairs(s1, targets))


@query(O.with_(O.CAPPED, "SELECT * FROM report"))
def cap_candidates(spark, sf_dir):
    """W2, AG7, J-L, SK4's table: the candidate report."""
    return capped_report(*parts(spark, sf_dir))


@query(O.with_(O.CAPPED, "SELECT * FROM report"))
def run_blocking(spark, sf_dir):
    """E3, E4: the report from records in one call."""
    return C.run_blocking(records(spark, sf_dir))


@query(O.with_(O.CAPPED, "SELECT count(*) AS n_total, count_if(n_candidates = 0) AS n_empty, round(avg(n_candidates), 6) AS avg_candidates, max(n_candidates) AS max_candidates FROM report"))
def blocking_stats(spark, sf_dir):
    """AG8."""
    return C.blocking_stats(capped_report(*parts(spark, sf_dir)))


def truth(s1, targets):
    """Ground truth: the targets of the entity's own page."""
    page = F.expr("cast(entity_id as long) div 3").alias("page")
    a, b = s1.select(page, F.col("entity_id").alias("source1_entity_id")), targets.select(page, F.col("entity_id").alias("t"))
    return a.join(b, "page").groupBy("source1_entity_id").agg(F.array_join(F.collect_list("t"), ",").alias("matched_entity_ids"))


@query(O.with_(f"{O.CAPPED}, {O.TRUTH}, {O.PAIRS}", """SELECT round(c / t, 9) AS pairs_completeness, round(1 - f / greatest(n * m, 1), 9) AS reduction_ratio, t AS true_pairs, c AS covered_pairs, t - c AS missed_pairs
FROM (SELECT (SELECT count(*) FROM tp) AS t, (SELECT count(*) FROM tp JOIN cp USING (s1_id, target_id)) AS c, (SELECT count(*) FROM cp) AS f, (SELECT count(*) FROM s1) AS n, (SELECT count(*) FROM tg) AS m)"""))
def pairs_completeness(spark, sf_dir):
    """E1, AG9, AG10, ST3."""
    s1, targets = parts(spark, sf_dir)
    return C.completeness(staged(capped_report(s1, targets)), truth(s1, targets), targets.agg(F.count("*").alias("n")))


@query(O.with_(f"{O.CAPPED}, {O.TRUTH}, {O.PAIRS}", "SELECT s1_id, target_id FROM tp EXCEPT SELECT s1_id, target_id FROM cp"))
def missed_pairs(spark, sf_dir):
    """ST4."""
    s1, targets = parts(spark, sf_dir)
    return C.missed_pairs(capped_report(s1, targets), truth(s1, targets))


@query(O.with_(f"{O.CAPPED}, {O.TRUTH}, {O.PAIRS}", """SELECT (SELECT count(*) FROM truth) AS n_entities, (SELECT count(DISTINCT s1_id) FROM tp) AS n_matched_entities, (SELECT count(*) FROM tp) AS true_pairs,
(SELECT count(*) FROM tp JOIN cp USING (s1_id, target_id)) AS found_pairs, round((SELECT count(*) FROM tp JOIN cp USING (s1_id, target_id)) / (SELECT count(*) FROM tp), 9) AS recall"""))
def recall_report(spark, sf_dir):
    """E2."""
    number = F.monotonically_increasing_id()
    s1, targets = parts(spark, sf_dir)
    return C.recall_report(capped_report(s1, targets).withColumn("row", number), truth(s1, targets).withColumn("row", number), "row")


def _countries(spark, sf_dir):
    c = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("source")).alias("country")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", c)


_COUNTRIES = "d AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS country FROM documents), cc AS (SELECT coalesce(country, '__MISSING__') AS country, count(*) AS n FROM d GROUP BY ALL)"
_TARGETS = f"""{_COUNTRIES}, r AS (SELECT country, n / (sum(n) OVER ()) * least(150, sum(n) OVER ()) AS raw, least(150, sum(n) OVER ()) AS size FROM cc),
st AS (SELECT * FROM (SELECT country, CAST(floor(raw) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, country) <= size - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS target FROM r) WHERE target > 0)"""


@query(O.with_(_COUNTRIES, "SELECT * FROM cc"))
def country_counts(spark, sf_dir):
    """SA1, AG11."""
    return sampling.country_counts(_countries(spark, sf_dir))


@query(O.with_(_TARGETS, "SELECT country, CAST(target AS BIGINT) AS target FROM st"))
def sample_targets(spark, sf_dir):
    """SA2, W5."""
    return sampling.sample_targets(sampling.country_counts(_countries(spark, sf_dir)), 150)


@query(O.with_(_TARGETS, """SELECT doc_id, country FROM (SELECT d.doc_id, d.country, st.target, row_number() OVER (PARTITION BY coalesce(d.country, '__MISSING__') ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS k
FROM d JOIN st ON st.country = coalesce(d.country, '__MISSING__')) WHERE k <= target"""))
def stratified_sample(spark, sf_dir):
    """SA3, W6: 150 rows in all."""
    return sampling.stratified_sample(_countries(spark, sf_dir), 150, "doc_id")


_LEGAL = O.quoted(N.K.SUFFIX_REMOVE)
_WORDS = "string_split(name_no_suffix, ' ')"
_ODD = "regexp_matches({0}, '[^\\x00-\\x7F]')"
_BAD = {
    "q01_missing_columns": ("fail", "0"),
    "q02_no_rows": ("warn", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END"),
    "q03_duplicate_ids": ("fail", "count(entity_id) - count(DISTINCT entity_id)"),
    "q04_name_sorted_order": ("fail", "count_if(list_sort(string_split(name_sorted, ' ')) <> string_split(name_sorted, ' '))"),
    "q05_first2_length": ("fail", "count_if(len(string_split(name_first2, ' ')) > 2)"),
    "q06_suffix_survivors": ("fail", f"count_if(script_type = 'latin' AND list_has_any({_WORDS}, [{_LEGAL}]) AND NOT list_has_all([{_LEGAL}], {_WORDS}))"),
    "q06_suffix_only_names": ("warn", f"count_if(script_type = 'latin' AND list_has_any({_WORDS}, [{_LEGAL}]) AND list_has_all([{_LEGAL}], {_WORDS}))"),
    "q07_ascii_transliterated": ("fail", f"count_if({_ODD.format('name_transliterated')})"),
    "q08_ascii_transliterated_no_suffix": ("fail", f"count_if({_ODD.format('name_transliterated_no_suffix')})"),
    "q09_indic_sorted_empty": ("fail", "count_if(script_type <> 'latin' AND name_sorted = '')"),
    "q10_locality_ascii_tokens": ("fail", f"coalesce(sum(len(list_filter(string_split(locality_tokens, ' '), lambda t: {_ODD.format('t')}))), 0)"),
    "q11_has_address_domain": ("fail", "count_if(has_address IS NULL)"),
    "q12_pin_format": ("fail", "count_if(lower(country) = 'india' AND pin_code <> '' AND NOT regexp_full_match(pin_code, '[1-9][0-9]{5}'))"),
    "q13_zip_format": ("fail", "count_if(lower(country) = 'us' AND zip_code <> '' AND NOT regexp_full_match(zip_code, '[0-9]{5}(?:-[0-9]{4})?'))"),
    "q14_script_enum": ("fail", f"count_if(script_type NOT IN ({O.quoted(quality.SCRIPT_TYPES)}))"),
    "q15_name_full_separators": ("fail", "count_if(regexp_matches(name_full, '[|,]'))"),
    "q16_ascii_address": ("fail", f"count_if({_ODD.format('address_transliterated')})"),
}
#: Faults planted in the records of some ids, so that every rule but that of missing columns has offenders.
FAULTS = {
    "entity_id": (17, "'3'"), "name_sorted": (19, "CASE WHEN script_type = 'latin' THEN 'b a' ELSE '' END"), "name_first2": (23, "'a b c'"), "name_no_suffix": (29, "CASE WHEN n % 2 = 0 THEN 'acme ltd' ELSE 'ltd' END"),
    "name_transliterated": (31, "'ärger'"), "name_transliterated_no_suffix": (37, "'ärger'"), "locality_tokens": (41, "'ök öl a'"), "pin_code": (10, "'012345'"), "zip_code": (10, "'1234'"),
    "script_type": (43, "'runic'"), "name_full": (47, "'a|b'"), "address_transliterated": (53, "'é'"),
}
_FAULTY = "faulty AS MATERIALIZED (SELECT * REPLACE ({}) FROM (SELECT *, CAST(entity_id AS BIGINT) AS n FROM addresses))".format(", ".join(f"CASE WHEN n % {m} = 1 THEN {v} ELSE {c} END AS {c}" for c, (m, v) in FAULTS.items()))
_REPORT = " UNION ALL ".join(
    f"SELECT src, '{k}' AS \"check\", CAST({v} AS BIGINT) AS n_bad, CASE WHEN {v} > 0 THEN '{s}' ELSE 'pass' END AS severity FROM faulty GROUP BY src" for k, (s, v) in _BAD.items()
)


@query(O.with_(f"{O.ADDRESSES}, {_FAULTY}", _REPORT))
def dq_report(spark, sf_dir):
    """Q1 to Q16, Q18, Q20, by source, over records with planted faults."""
    rows = records(spark, sf_dir).withColumn("n", F.col("entity_id").cast("long"))
    rows = rows.select(*[F.expr(f"CASE WHEN n % {FAULTS[c][0]} = 1 THEN {FAULTS[c][1]} ELSE {c} END").alias(c) if c in FAULTS else F.col(c) for c in rows.columns])
    return quality.quality_report(rows, ("src",)).drop("sample")


@query(O.with_(O.NAMES, "SELECT (SELECT count(*) FROM (SELECT entity_id FROM names WHERE src <> 's3' EXCEPT SELECT entity_id FROM names WHERE src <> 's1')) AS n_missing, (SELECT count(*) FROM (SELECT entity_id FROM names WHERE src <> 's1' EXCEPT SELECT entity_id FROM names WHERE src <> 's3')) AS n_extra"))
def coverage_missing_extra(spark, sf_dir):
    """ST6, Q17."""
    rows = entities(spark, sf_dir)
    return quality.coverage(rows.where("src <> 's3'"), rows.where("src <> 's1'"))
