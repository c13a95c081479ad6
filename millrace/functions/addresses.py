"""Address parsing as Column expressions over token arrays."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import constants as K
from millrace.functions.indic import fold as fold_text
from millrace.functions.indic import transliterate_address
from millrace.functions.names import among, collapse, fold, is_null_text, literal_map, paired, strip, with_previous

FIELDS = ["has_address", "pin_code", "zip_code", "street_num", "state_token", "locality_tokens", "address_transliterated"]
FULL = {"us": sorted(set(K.US_STATES.values())), "india": sorted(set(K.INDIA_STATES.values()))}
FULL["other"] = sorted({*FULL["us"], *FULL["india"]})
ABBREVIATIONS = {"us": K.US_STATES, "india": K.INDIA_STATES, "other": {}}
WORDS = {k: sorted({w for s in v for w in s.split()}) for k, v in FULL.items()}
STREET_NUMBER = r"^(?:[a-z]+[-/]?)?\p{Nd}+(?:[-/]\p{Nd}+)*(?:[-/][a-z]+)?[a-z]?$"
NATIVE = sorted({tuple(fold_text(w.lower()) for w in alias.split()): state for alias, state in K.NATIVE_STATES.items()}.items(), key=lambda x: -len(x[0]))


def tokenize(address: Column) -> Column:
    """Lower-case tokens; separators split, hyphens stay."""
    text = collapse(F.regexp_replace(F.lower(address), r"[,#;:./\\()\[\]]+", " "))
    return F.filter(F.split(text, " "), lambda t: t != "")


def folded(tokens: Column, ascii_input: bool) -> Column:
    return tokens if ascii_input else F.split(fold(F.array_join(tokens, "\x01")), "\x01")


def country_kind(country: Column) -> Column:
    c = F.lower(strip(F.coalesce(country, F.lit(""))))
    return F.when(c.isin("us", "india"), c).otherwise(F.lit("other"))


def by_country(kind: Column, make) -> Column:
    """make(kind name) for the row's kind of country."""
    return F.when(kind == "us", make("us")).when(kind == "india", make("india")).otherwise(make("other"))


def positions(tokens: Column) -> Column:
    """0 .. size - 1, empty for no tokens."""
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))


def last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


SEP = "\x01"
#: Native aliases, the longest first, as runs of folded tokens with a separator around each token.
ALIASES = {SEP + SEP.join(alias) + SEP: state for alias, state in NATIVE}


def native_text(tokens: Column) -> Column:
    """Tokens as one text with a separator around each."""
    return F.concat(F.lit(SEP), F.array_join(tokens, SEP), F.lit(SEP))


def native_alias(text: Column) -> Column:
    """The first alias in order of length that a ``native_text`` column holds; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(a)), F.lit(a)) for a in ALIASES])


def native_state(text: Column, alias: Column) -> Column:
    """struct(state, pos, width) of an alias found; null if there is none."""
    pos = F.size(F.split(F.substring(text, F.lit(1), F.instr(text, alias)), SEP)) - 2
    found = F.struct(F.try_element_at(literal_map(ALIASES), alias).alias("state"), pos.cast("int").alias("pos"), (F.size(F.split(alias, SEP)) - 2).alias("width"))
    return F.when(alias.isNotNull(), found)


def state(tokens: Column, kind: Column, native: Column | None = None) -> Column:
    """struct(state, pos): native name, two-word name, one-word name, abbreviation; the last such token each time.

    tokens: a column that is used often enough not to be inlined into the lambdas."""
    at = positions(tokens)

    def tiers(name: str) -> Column:
        full, short = FULL[name], literal_map(ABBREVIATIONS[name]) if ABBREVIATIONS[name] else None
        pair = lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1))
        two = last(F.filter(at, lambda i: (i < F.size(tokens) - 1) & among(pair(i), full)))
        one = last(F.filter(at, lambda i: among(F.get(tokens, i), full)))
        out = F.when(two.isNotNull(), F.struct(pair(two).alias("state"), two.cast("int").alias("pos")))
        out = out.when(one.isNotNull(), F.struct(F.get(tokens, one).alias("state"), one.cast("int").alias("pos")))
        if short is not None:
            few = last(F.filter(at, lambda i: ((i == 0) | (i >= F.size(tokens) - 3)) & among(F.get(tokens, i), ABBREVIATIONS[name])))
            out = out.when(few.isNotNull(), F.struct(F.try_element_at(short, F.get(tokens, few)).alias("state"), few.cast("int").alias("pos")))
        return out.otherwise(F.struct(F.lit("").alias("state"), F.lit(-1).alias("pos")))

    plain = by_country(kind, tiers)
    if native is None:
        return plain
    return F.when((kind == "india") & native.isNotNull(), F.struct(native["state"].alias("state"), native["pos"].alias("pos"))).otherwise(plain)


def postal(tokens: Column, kind: Column, pos: Column) -> Column:
    """struct(pin, zip) of the postal code, by its place from the state."""
    at = positions(tokens)

    def first(order: Column, pattern: str) -> Column:
        return F.get(F.filter(F.transform(order, lambda i: F.get(tokens, i)), lambda t: t.rlike(pattern)), 0)

    after, before = F.filter(at, lambda i: i > pos), F.reverse(F.filter(at, lambda i: i < pos))
    # with no state pos is -1: all tokens come after it
    pin = first(F.when(pos >= 0, F.concat(after, before)).otherwise(F.reverse(at)), r"^[1-9]\p{Nd}{5}$")
    near = F.filter(before, lambda i: (i >= pos - 3) & (i > 0))
    tail = F.filter(F.reverse(at), lambda i: (i >= F.size(tokens) - 3) & (i > 0))
    code = first(F.when(pos >= 0, F.concat(after, near)).otherwise(tail), r"^\p{Nd}{5}(?:-\p{Nd}{4})?$")
    none = F.lit("")
    return F.struct(F.when(kind == "india", F.coalesce(pin, none)).otherwise(none).alias("pin"), F.when(kind == "us", F.coalesce(code, none)).otherwise(none).alias("zip"))


def street_number(tokens: Column, codes: Column) -> Column:
    """The first number among the first 12 tokens that are no postal code."""
    head = F.slice(F.filter(tokens, lambda t: ~F.array_contains(codes, t)), 1, 12)

    def fits(p: Column) -> Column:
        labelled = F.coalesce(among(p["b"], K.NUMBER_LABELS), F.lit(False)) & p["a"].rlike(r"\p{Nd}")
        return ~among(p["a"], K.NUMBER_LABELS) & (p["a"].rlike(f"(?i){STREET_NUMBER}") | labelled)

    return F.coalesce(F.get(F.filter(with_previous(head), fits), 0)["a"], F.lit(""))


def locality(tokens: Column, keys: Column, kind: Column, codes: Column, street: Column, native: Column | None) -> Column:
    """The first five telling ASCII tokens."""

    def keep(p: Column, i: Column) -> Column:
        t, key = p["a"], p["b"]
        dull = by_country(kind, lambda n: among(key, [*WORDS[n], *ABBREVIATIONS[n]]))
        bad = among(key, K.ADDRESS_NOISE) | dull | ~t.rlike(r"^[\x00-\x7F]*$") | key.rlike(r"^\p{Nd}[\p{Nd}\-/]+$") | key.rlike(r"^\p{Nd}+$") | (F.length(key) <= 2)
        skip = F.array_contains(codes, t) | (t == street)
        if native is not None:
            skip = skip | F.coalesce((kind == "india") & (i >= native["pos"]) & (i < native["pos"] + native["width"]), F.lit(False))
        return ~skip & ~bad

    return F.array_join(F.transform(F.slice(F.filter(paired(tokens, keys), keep), 1, 5), lambda p: p["a"]), " ")


def parse(df, address: str = "raw_address", country: str = "country", ascii_input: bool = False):
    """``df`` with the address fields.  The steps are columns of successive projections, so each is evaluated once.

    ascii_input: no address has characters outside ASCII; then no Python is planned.
    """
    blank = F.lit("")
    a = F.coalesce(F.col(address), blank)
    missing = is_null_text(a)
    df = df.withColumns({"_missing": missing, "_kind": country_kind(F.col(country)), "address_transliterated": transliterate_address(a, ascii_input)})
    df = df.withColumns({"_t": F.when(F.col("_missing"), F.array().cast("array<string>")).otherwise(tokenize(a))})
    df = df.withColumns({"_k": folded(F.col("_t"), ascii_input)})
    if not ascii_input:
        df = df.withColumns({"_text": native_text(F.col("_k"))}).withColumns({"_alias": native_alias(F.col("_text"))})
        df = df.withColumns({"_native": native_state(F.col("_text"), F.col("_alias"))})
    df = df.withColumns({"_state": state(F.col("_k"), F.col("_kind"), None if ascii_input else F.col("_native"))})
    if not ascii_input:
        other = tokenize(F.col("address_transliterated"))
        df = df.withColumns({"_t2": other}).withColumns({"_state2": state(F.col("_t2"), F.col("_kind"))})
        df = df.withColumns({"_use2": (F.col("_state.state") == "") & (F.size("_t2") > 0)})
        df = df.withColumns({"_code1": postal(F.col("_t"), F.col("_kind"), F.col("_state.pos")), "_code2": postal(F.col("_t2"), F.col("_kind"), F.col("_state2.pos"))})
        found = (F.col("_code1.pin") != "") | (F.col("_code1.zip") != "")
        df = df.withColumns({"_code": F.when(F.col("_use2") | ~found, F.col("_code2")).otherwise(F.col("_code1")), "_name": F.when(F.col("_use2"), F.col("_state2.state")).otherwise(F.col("_state.state"))})
    else:
        df = df.withColumns({"_code": postal(F.col("_t"), F.col("_kind"), F.col("_state.pos")), "_name": F.col("_state.state")})
    codes = F.filter(F.array("_code.pin", "_code.zip"), lambda x: x != "")
    df = df.withColumns({"_codes": codes}).withColumns({"street_num": street_number(F.col("_t"), F.col("_codes"))})
    some = F.size("_t") > 0
    native = None if ascii_input else F.col("_native")
    pick = lambda c: F.when(some, c).otherwise(blank)
    df = df.withColumns({
        "has_address": some,
        "pin_code": pick(F.col("_code.pin")),
        "zip_code": pick(F.col("_code.zip")),
        "state_token": pick(F.col("_name")),
        "locality_tokens": locality(F.col("_t"), F.col("_k"), F.col("_kind"), F.col("_codes"), F.col("street_num"), native),
        "address_transliterated": F.when(F.col("_missing"), blank).otherwise(F.col("address_transliterated")),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


