"""DuckDB SQL for the core queries, composed from the same fixed values.

Accents are folded by ``strip_accents``.  The Devanagari words of the derived entities are romanised by a table that is
written out here, word by word; the phonetic codes come from the rule table by a recursive query.
"""

from __future__ import annotations

from millrace import constants as K
from millrace.functions import phonetic
from millrace.functions.addresses import ABBREVIATIONS, FULL, WORDS
from millrace.operators.channels import LABELS, PRIME, lsh_parameters, multipliers
from millrace.sources.readers import DERIVED_SQL


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def replace(e: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({e}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', '{flags}')"


def collapse(e: str) -> str:
    return f"trim({replace(e, r'\s+', ' ')})"


def dotted(e: str) -> str:
    for pattern, short in K.DOTTED_LEGAL:
        e = replace(e, pattern, short, "gi")
    return e


def base_clean(c: str) -> str:
    e = replace(replace(f"lower({c})", r"\bm/s\b", ""), r"\bm\.s\.\b", "")
    e = replace(dotted(e), r"\s*&\s*", " and ")
    e = replace(replace(e, "['‘’`]", ""), K.DOMAIN_ENDING, "", "gi")
    return f"CASE WHEN lower(trim({c})) IN ({quoted(K.NULL_STRINGS)}) THEN '' ELSE {collapse(replace(e, r'[\pP\pS]', ' '))} END"


def words(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda t: t <> '')"


def consecutive(w: str) -> str:
    return f"list_filter({w}, lambda t, i: i = 1 OR ({w})[i - 1] <> t)"


def canon(w: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.SUFFIX_CANON.items())
    return f"list_transform({w}, lambda t: CASE strip_accents(t) {cases} ELSE t END)"


def stripped(w: str) -> str:
    left = f"list_filter({w}, lambda t: strip_accents(t) NOT IN ({quoted(K.SUFFIX_REMOVE)}) AND NOT regexp_full_match(t, '[0-9]+'))"
    return f"CASE WHEN len({left}) = 0 THEN {w} ELSE {left} END"


def case_map(e: str, table: dict[str, str]) -> str:
    return f"CASE {e} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def joined(w: str) -> str:
    return f"coalesce(array_to_string({w}, ' '), '')"


def ascii_only(e: str) -> str:
    return f"regexp_replace(strip_accents({e}), '[^\\x00-\\x7F]', '', 'g')"


#: How the Devanagari words of the derived entities are romanised.
ROMAN = {
    "श्री": "shri", "राम": "rama", "गणेश": "ganesha", "भारत": "bharata", "नगर": "nagara", "ट्रेडर्स": "tredarsa", "स्टील": "stila", "लिमिटेड": "limiteda",
    "मुंबई": "mumbai", "महाराष्ट्र": "maharashtra", "उत्तर": "uttara", "प्रदेश": "pradesha",
}
INDIC = r"[\x{0900}-\x{0D7F}]"


def in_block(low: int, high: int) -> str:
    return f"len(list_filter(letters, lambda c: unicode(c) BETWEEN {low} AND {high}))"


def script_of(e: str) -> str:
    """Script of a text; e names a column."""
    letters = f"regexp_extract_all({e}, '\\pL')"
    counts = {n: in_block(a, b).replace("letters", letters) for n, (a, b) in K.SCRIPTS.items()}
    every = f"len(list_filter({letters}, lambda c: unicode(c) BETWEEN {0x0900} AND {0x0D7F}))"
    top = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {every} = 0 THEN 'latin' WHEN {every} < len({letters}) THEN 'mixed' {' '.join(f"WHEN {c} = {top} THEN '{n}'" for n, c in counts.items())} END"


NAMES = f"""{DERIVED_SQL},
n0 AS (SELECT *, CASE WHEN regexp_matches(business_name, '{INDIC}') THEN {script_of('business_name')} ELSE 'latin' END AS script_type FROM entities),
n1 AS (SELECT *, {base_clean('business_name')} AS cleaned, CASE WHEN script_type IN ('latin', 'mixed') THEN [] ELSE list_transform(string_split(business_name, ' '), lambda w: {case_map('w', ROMAN)}) END AS roman FROM n0),
n2 AS (SELECT *, {words('cleaned')} AS w0 FROM n1),
n3 AS (SELECT *, {consecutive('w0')} AS w1 FROM n2),
n4 AS (SELECT *, {canon('w1')} AS w2 FROM n3),
n5 AS (SELECT *, {stripped('w2')} AS w3 FROM n4),
n6 AS (SELECT *, {collapse(ascii_only(joined('w3')))} AS clean FROM n5),
n7 AS (SELECT *, CASE WHEN len(roman) > 0 THEN roman ELSE {words('clean')} END AS w4 FROM n6),
n8 AS (SELECT *, {stripped('w4')} AS w5 FROM n7),
n9 AS (SELECT *, list_sort(w5) AS w6 FROM n8),
names AS MATERIALIZED (SELECT entity_id, src, country, lower(trim(regexp_replace(country, '[^\\pL\\pN_]', '_', 'g'), '_')) AS country_key, business_name, business_address, script_type, cleaned, w0, w1, w2, w3, clean, roman,
  CASE WHEN script_type = 'latin' THEN clean ELSE business_name END AS name_full, CASE WHEN script_type = 'latin' THEN clean ELSE '' END AS name_ascii,
  CASE WHEN script_type = 'latin' THEN clean ELSE {joined('roman')} END AS name_transliterated,
  {joined('w5')} AS name_no_suffix, {joined(consecutive('w6'))} AS name_sorted, {joined('w5[1:2]')} AS name_first2, {joined('w5')} AS name_transliterated_no_suffix,
  regexp_matches(business_name, '{K.DOMAIN_NAME}', 'i') AS is_domain_name FROM n9)"""


def by_country(make) -> str:
    return f"CASE kind WHEN 'us' THEN {make('us')} WHEN 'india' THEN {make('india')} ELSE {make('other')} END"


def first_where(t: str, condition: str) -> str:
    """The first index i of list t (from 1) that passes; null if none."""
    return f"list_min(list_filter(range(1, len({t}) + 1), lambda i: {condition}))"


def last_where(t: str, condition: str) -> str:
    return first_where(t, condition).replace("list_min", "list_max", 1)


def _pair(t: str, kind: str) -> str:
    return last_where(t, f"i < len({t}) AND ({t}[i] || ' ' || {t}[i + 1]) IN ({quoted(FULL[kind])})")


def _one(t: str, kind: str) -> str:
    return last_where(t, f"{t}[i] IN ({quoted(FULL[kind])})")


def _short(t: str, kind: str) -> str:
    if not ABBREVIATIONS[kind]:
        return "NULL"
    return last_where(t, f"(i = 1 OR i - 1 >= len({t}) - 3) AND {t}[i] IN ({quoted(ABBREVIATIONS[kind])})")


def state_at(t: str) -> str:
    """Place of the state in list t; 0 if there is none."""
    return by_country(lambda kind: f"coalesce({_pair(t, kind)}, {_one(t, kind)}, {_short(t, kind)}, 0)")


def state_name(t: str, p: str) -> str:
    def of(kind: str) -> str:
        short = case_map(f"{t}[{p}]", ABBREVIATIONS[kind]) if ABBREVIATIONS[kind] else "''"
        return f"CASE WHEN {p} = 0 THEN '' WHEN {_pair(t, kind)} IS NOT NULL THEN {t}[{p}] || ' ' || {t}[{p} + 1] WHEN {_one(t, kind)} IS NOT NULL THEN {t}[{p}] ELSE {short} END"

    return f"coalesce({by_country(of)}, '')"


def native_place(t: str) -> str:
    """[place, width, name] of the first native state, the longest name first; null if there is none."""
    tries = []
    for alias, state in sorted(K.NATIVE_STATES.items(), key=lambda x: -len(x[0].split())):
        w = alias.lower().split()
        test = " AND ".join(f"{t}[i + {j}] = '{x}'" for j, x in enumerate(w))
        at = first_where(t, test)
        tries.append(f"CASE WHEN {at} IS NOT NULL THEN {{'at': {at}, 'width': {len(w)}, 'state': '{state}'}} END")
    return f"CASE WHEN kind = 'india' AND len(list_filter({t}, lambda x: regexp_matches(x, '{INDIC}'))) > 0 THEN coalesce({', '.join(tries)}) END"


def pin_of(t: str, p: str) -> str:
    pin = f"regexp_full_match({t}[i], '[1-9][0-9]{{5}}')"
    at = f"CASE WHEN {p} > 0 THEN coalesce({first_where(t, f'i > {p} AND {pin}')}, {last_where(t, f'i < {p} AND {pin}')}) ELSE {last_where(t, pin)} END"
    return f"CASE WHEN kind = 'india' THEN coalesce({t}[{at}], '') ELSE '' END"


def zip_of(t: str, p: str) -> str:
    code = f"regexp_full_match({t}[i], '[0-9]{{5}}(?:-[0-9]{{4}})?')"
    near = last_where(t, f"i < {p} AND i >= {p} - 3 AND i > 1 AND {code}")
    at = f"CASE WHEN {p} > 0 THEN coalesce({first_where(t, f'i > {p} AND {code}')}, {near}) ELSE {last_where(t, f'i >= len({t}) - 2 AND i > 1 AND {code}')} END"
    return f"CASE WHEN kind = 'us' THEN coalesce({t}[{at}], '') ELSE '' END"


def address_tokens(e: str) -> str:
    return words(collapse(replace(f"lower({e})", r"[,#;:./\\()\[\]]+", " ")))


STREET = r"(?:[a-z]+[-/]?)?[0-9]+(?:[-/][0-9]+)*(?:[-/][a-z]+)?[a-z]?"
#: An address without its Devanagari: each run of it is a word or a part of one.
_spoken = "business_address"
for _word, _roman in ROMAN.items():
    _spoken = f"replace({_spoken}, '{_word}', '{_roman}')"

ADDRESSES = f"""{NAMES},
a0 AS (SELECT *, CASE WHEN lower(country) IN ('us', 'india') THEN lower(country) ELSE 'other' END AS kind, lower(trim(business_address)) IN ({quoted(K.NULL_STRINGS)}) AS missing FROM names),
a1 AS (SELECT *, CASE WHEN missing THEN '' WHEN regexp_full_match(business_address, '[\\x00-\\x7F]*') THEN lower(business_address)
  ELSE lower({collapse(ascii_only(replace(_spoken, r'[\pP\pS]', ' ')))}) END AS address_transliterated, CASE WHEN missing THEN CAST([] AS VARCHAR[]) ELSE {address_tokens('business_address')} END AS t FROM a0),
a2 AS (SELECT *, list_transform(t, lambda x: strip_accents(x)) AS k, {address_tokens('address_transliterated')} AS t2, {native_place('t')} AS native FROM a1),
a3 AS (SELECT *, CASE WHEN native IS NOT NULL THEN native['at'] ELSE {state_at('k')} END AS p1, {state_at('t2')} AS p2 FROM a2),
a4 AS (SELECT *, CASE WHEN native IS NOT NULL THEN native['state'] ELSE {state_name('k', 'p1')} END AS st1, {state_name('t2', 'p2')} AS st2,
  {pin_of('t', 'p1')} AS pin1, {pin_of('t2', 'p2')} AS pin2, {zip_of('t', 'p1')} AS zip1, {zip_of('t2', 'p2')} AS zip2 FROM a3),
a5 AS (SELECT *, st1 = '' AND len(t2) > 0 AS use2, len(t) > 0 AS has_address FROM a4),
a6 AS (SELECT *, CASE WHEN NOT has_address THEN '' WHEN use2 THEN st2 ELSE st1 END AS state_token, CASE WHEN NOT has_address THEN '' WHEN use2 OR (pin1 = '' AND zip1 = '') THEN pin2 ELSE pin1 END AS pin_code,
  CASE WHEN NOT has_address THEN '' WHEN use2 OR (pin1 = '' AND zip1 = '') THEN zip2 ELSE zip1 END AS zip_code FROM a5),
a7 AS (SELECT *, list_filter(t, lambda x: x <> pin_code AND x <> zip_code) AS h FROM a6),
a8 AS (SELECT *, coalesce(list_filter(h, lambda x, i: i <= 12 AND x NOT IN ({quoted(K.NUMBER_LABELS)})
  AND (regexp_full_match(x, '{STREET}') OR (i > 1 AND h[i - 1] IN ({quoted(K.NUMBER_LABELS)}) AND regexp_matches(x, '[0-9]'))))[1], '') AS street_num FROM a7),
addresses AS MATERIALIZED (SELECT * EXCLUDE (t, t2, k, h, kind, missing, native, p1, p2, st1, st2, pin1, pin2, zip1, zip2, use2), t AS tokens,
  {joined(f"""list_filter(t, lambda x, i: x <> pin_code AND x <> zip_code AND x <> street_num AND regexp_full_match(x, '[\\x00-\\x7F]*') AND x NOT IN ({quoted(K.ADDRESS_NOISE)})
    AND NOT coalesce(i >= native['at'] AND i < native['at'] + native['width'], false)
    AND NOT ({by_country(lambda k: f"x IN ({quoted([*WORDS[k], *ABBREVIATIONS[k]])})")}) AND NOT regexp_full_match(x, '[0-9][0-9/-]+|[0-9]+') AND length(x) > 2)[1:5]""")} AS locality_tokens FROM a8),
s1 AS (SELECT * FROM addresses WHERE src = 's1'), tg AS (SELECT * FROM addresses WHERE src <> 's1')"""

PAIR = "country_key, src, s1_id, target_id"
KEYS = "list_filter([CASE WHEN pin_code <> '' THEN 'p' || pin_code END, CASE WHEN zip_code <> '' THEN 'z' || zip_code END, CASE WHEN street_num <> '' AND locality_tokens <> '' THEN 's|' || street_num || '|' || split_part(locality_tokens, ' ', 1) END], lambda k: k IS NOT NULL)"
A_STRONG = f"""ka AS (SELECT country_key, entity_id AS s1_id, unnest({KEYS}) AS k FROM s1 WHERE has_address),
kt AS (SELECT country_key, src, entity_id AS target_id, unnest({KEYS}) AS k FROM tg),
a_strong AS (SELECT DISTINCT {PAIR} FROM ka JOIN kt USING (country_key, k))"""
A_FALLBACK = f"""fa AS (SELECT s.country_key, x.src, s.entity_id AS s1_id, split_part(s.locality_tokens, ' ', 1) AS k FROM s1 s JOIN (SELECT DISTINCT country_key, src FROM tg) x USING (country_key)
  WHERE s.has_address AND s.locality_tokens <> '' AND NOT EXISTS (SELECT 1 FROM a_strong h WHERE h.country_key = s.country_key AND h.src = x.src AND h.s1_id = s.entity_id)),
a_fallback AS (SELECT DISTINCT fa.country_key, fa.src, s1_id, t.entity_id AS target_id FROM fa JOIN tg t ON t.country_key = fa.country_key AND t.src = fa.src AND split_part(t.locality_tokens, ' ', 1) = fa.k)"""
B_TOKENS = f"list_filter(list_distinct(string_split(concat_ws(' ', name_no_suffix, name_sorted, name_first2, name_transliterated_no_suffix), ' ')), lambda w: w <> '' AND w NOT IN ({quoted(K.STOPWORDS)}))"
B_DF = f"""bt AS (SELECT country_key, src, entity_id AS target_id, unnest({B_TOKENS}) AS token FROM tg),
bn AS (SELECT country_key, src, count(*) AS n FROM tg GROUP BY ALL),
bd AS (SELECT country_key, src, token, count(*) AS df, ln(1 + any_value(n) / count(*)) AS idf FROM bt JOIN bn USING (country_key, src) GROUP BY country_key, src, token)"""
B_HITS = f"""bq AS (SELECT country_key, entity_id AS s1_id, unnest({B_TOKENS}) AS token FROM s1),
b_hits AS (SELECT DISTINCT bt.country_key, bt.src, s1_id, target_id FROM bt JOIN bd ON bd.country_key = bt.country_key AND bd.src = bt.src AND bd.token = bt.token AND idf >= 2.0
  JOIN bq ON bq.country_key = bt.country_key AND bq.token = bt.token)"""
_bands, _rows = lsh_parameters(K.Config().minhash_threshold, K.Config().minhash_permutations)
_a, _b = multipliers(_bands * _rows)
_low = "list_min(list_transform(x, lambda v: (v * {0} + {1}) % " + str(PRIME) + "))"
_keys = ", ".join(f"{{{{'band': {b}, 'key': ({_low.format(_a[2 * b], _b[2 * b])}) * {PRIME} + {_low.format(_a[2 * b + 1], _b[2 * b + 1])}}}}}".replace("{{", "{").replace("}}", "}") for b in range(_bands))
C_NAMES = "unnest(list_distinct([name_no_suffix, name_transliterated_no_suffix, name_sorted])) AS name"
C_SHINGLES = f"""cq AS (SELECT country_key, entity_id AS s1_id, {C_NAMES} FROM s1), ct AS (SELECT country_key, src, entity_id AS target_id, {C_NAMES} FROM tg),
cn AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(name) - 2, 1) + 1), lambda i: substr(replace(name, ' ', '_'), i, 3))) AS g
  FROM (SELECT name FROM cq UNION SELECT name FROM ct) WHERE name <> '')"""
_code = "((unicode(substr(g, 1, 1))::BIGINT * 1114112 + CASE WHEN length(g) > 1 THEN unicode(substr(g, 2, 1)) ELSE 0 END) % {0} * 1114112 + CASE WHEN length(g) > 2 THEN unicode(substr(g, 3, 1)) ELSE 0 END) % {0}".format(PRIME)
C_HITS = f"""cx AS (SELECT name, list_transform(g, lambda g: {_code}) AS x FROM cn), cb AS (SELECT name, unnest([{_keys}]) AS band FROM cx),
cqb AS (SELECT DISTINCT country_key, s1_id, band FROM cq JOIN cb USING (name)), ctb AS (SELECT DISTINCT country_key, src, target_id, band FROM ct JOIN cb USING (name)),
c_hits AS (SELECT DISTINCT {PAIR} FROM cqb JOIN ctb USING (country_key, band))"""
D_CODES = f"""dt AS (SELECT country_key, src, entity_id, unnest(list_distinct(string_split(concat_ws(' ', name_no_suffix, name_transliterated_no_suffix), ' '))) AS token FROM addresses),
{phonetic.sql_walk('dt')},
de AS (SELECT DISTINCT country_key, src, entity_id, code FROM dt JOIN dmc USING (token))"""
D_HITS = "d_hits AS (SELECT DISTINCT t.country_key, t.src, s.entity_id AS s1_id, t.entity_id AS target_id FROM de s JOIN de t ON s.country_key = t.country_key AND s.code = t.code AND s.src = 's1' AND t.src <> 's1')"
G_HITS = "g_hits AS (SELECT DISTINCT t.country_key, t.src, s.entity_id AS s1_id, t.entity_id AS target_id FROM s1 s JOIN tg t ON s.country_key = t.country_key AND s.name_sorted = t.name_sorted WHERE s.name_sorted <> '')"


def similar(x: str, columns: list[str], floor: float, gate: str = "true") -> str:
    """CTEs up to {x}_hits for a gram channel."""
    text = "trim(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in columns) + "))"
    grams = " UNION ALL ".join(f"SELECT * EXCLUDE (p), unnest(list_transform(range(1, length(p) - {n} + 2), lambda i: substr(p, i, {n}))) AS gram FROM {x}p WHERE length(p) >= {n}" for n in (2, 3, 4))
    return f"""{x}x AS (SELECT s.country_key, c.src, 'q' AS side, entity_id AS id, {text} AS txt, {gate} AS asks FROM s1 s JOIN (SELECT DISTINCT country_key, src FROM tg WHERE {text} <> '') c USING (country_key)
  UNION ALL SELECT country_key, src, 't', entity_id, {text}, false FROM tg),
{x}y AS (SELECT * FROM {x}x WHERE txt <> ''),
{x}p AS (SELECT country_key, src, side, id, ' ' || unnest(list_filter(regexp_split_to_array(lower(txt), '\\s+'), lambda w: w <> '')) || ' ' AS p FROM {x}y),
{x}f AS (SELECT country_key, src, side, id, gram, count(*) AS tf FROM ({grams}) GROUP BY ALL),
{x}s AS (SELECT country_key, src, gram, count(*) AS df, sum(tf) AS total FROM {x}f GROUP BY country_key, src, gram QUALIFY row_number() OVER (PARTITION BY country_key, src ORDER BY total DESC, gram) <= 65536),
{x}n AS (SELECT country_key, src, count(*) AS n FROM {x}y GROUP BY ALL),
{x}w AS (SELECT f.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM {x}f f JOIN {x}s USING (country_key, src, gram) JOIN {x}n USING (country_key, src)),
{x}l AS (SELECT country_key, src, side, id, sqrt(sum(w * w)) AS norm FROM {x}w GROUP BY ALL),
{x}v AS (SELECT {x}w.country_key, {x}w.src, {x}w.side, {x}w.id, gram, w / norm AS w, asks FROM {x}w JOIN {x}l USING (country_key, src, side, id) JOIN {x}y USING (country_key, src, side, id)),
{x}_sim AS (SELECT a.country_key, a.src, a.id AS s1_id, b.id AS target_id, round(sum(a.w * b.w), 9) AS sim FROM {x}v a JOIN {x}v b ON a.country_key = b.country_key AND a.src = b.src AND a.gram = b.gram
  AND a.side = 'q' AND b.side = 't' AND a.asks GROUP BY ALL),
{x}_hits AS (SELECT {PAIR} FROM (SELECT * FROM {x}_sim QUALIFY row_number() OVER (PARTITION BY country_key, src, s1_id ORDER BY sim DESC, target_id) <= 15) WHERE sim >= {floor})"""


E_HITS = similar("e", ["name_no_suffix", "name_transliterated_no_suffix", "name_sorted"], 0.15)
F_HITS = similar("f", ["locality_tokens", "state_token", "address_transliterated"], 0.12, "s.has_address")

_has = ", ".join(f"max(CASE WHEN channel = '{c}' THEN 1 ELSE 0 END) AS has_{c}" for c in LABELS)
_priority = "CASE " + " ".join(f"WHEN has_{c} = 1 THEN {7 - i}" for i, c in enumerate(K.CHANNEL_PRIORITY)) + " ELSE 0 END"
UNION = f"""{ADDRESSES}, {A_STRONG}, {A_FALLBACK}, {B_DF}, {B_HITS}, {C_SHINGLES}, {C_HITS}, {D_CODES}, {D_HITS}, {E_HITS}, {F_HITS}, {G_HITS},
hits AS (SELECT *, 'A' AS channel FROM a_strong UNION ALL SELECT *, 'A' FROM a_fallback UNION ALL SELECT *, 'B' FROM b_hits UNION ALL SELECT *, 'C' FROM c_hits UNION ALL SELECT *, 'D' FROM d_hits
  UNION ALL SELECT *, 'E' FROM e_hits UNION ALL SELECT *, 'F' FROM f_hits UNION ALL SELECT *, 'G' FROM g_hits),
u0 AS (SELECT country_key, s1_id, target_id, {_has} FROM hits GROUP BY ALL),
u AS (SELECT *, {' + '.join(f'has_{c}' for c in LABELS)} AS agreement, {_priority} AS priority FROM u0)"""
CAPPED = f"""{UNION},
kept AS (SELECT *, count(*) OVER (PARTITION BY country_key, s1_id) AS n, row_number() OVER (PARTITION BY country_key, s1_id ORDER BY agreement DESC, priority DESC, target_id) AS rank FROM u QUALIFY rank <= 80),
lists AS (SELECT country_key, s1_id, string_agg(target_id, ',' ORDER BY CASE WHEN n <= 80 THEN 0 ELSE rank END, target_id) AS ids, count(*) AS n_candidates, {', '.join(f'CAST(sum(has_{c}) AS BIGINT) AS {c}' for c in LABELS)} FROM kept GROUP BY ALL),
report AS (SELECT s.entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids, coalesce(n_candidates, 0) AS n_candidates,
  '{{' || {" || ',' || ".join(f"'\"{c}\":' || CAST(coalesce({c}, 0) AS VARCHAR)" for c in LABELS)} || '}}' AS channel_tags
  FROM s1 s LEFT JOIN lists l ON l.country_key = s.country_key AND l.s1_id = s.entity_id)"""
TRUTH = "truth AS (SELECT s.entity_id AS source1_entity_id, string_agg(t.entity_id, ',') AS matched_entity_ids FROM s1 s JOIN tg t ON CAST(s.entity_id AS BIGINT) // 3 = CAST(t.entity_id AS BIGINT) // 3 GROUP BY ALL)"
PAIRS = """tp AS (SELECT DISTINCT source1_entity_id AS s1_id, unnest(string_split(matched_entity_ids, ',')) AS target_id FROM truth),
cp AS (SELECT DISTINCT source1_entity_id AS s1_id, unnest(list_filter(string_split(candidate_entity_ids, ','), lambda x: x <> '')) AS target_id FROM report)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
