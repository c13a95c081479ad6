"""The normalised record: 20 columns from (entity_id, business_name, business_address, country)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import addresses, indic
from millrace.functions import names as N

COLUMNS = [
    "entity_id", "country", "raw_name", "raw_address", "name_full", "name_no_suffix", "name_sorted", "name_first2", "name_ascii",
    "name_transliterated", "name_transliterated_no_suffix", "script_type", "is_domain_name", "has_address", "pin_code", "zip_code",
    "street_num", "locality_tokens", "state_token", "address_transliterated",
]


def normalize(df: DataFrame, keep: tuple[str, ...] = ("src", "split"), ocr: bool = False, ascii_input: bool = False) -> DataFrame:
    """``df`` as normalised records, with those of the columns ``keep`` that it has and country_key.

    Steps are successive projections, so each expression is evaluated once.  ascii_input: no text has characters
    outside ASCII; then everything stays in the JVM.
    """
    keep = tuple(c for c in keep if c in df.columns)
    text = lambda c: N.strip(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    raw = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    out = df.select(text("entity_id").alias("entity_id"), text("country").alias("country"), raw("business_name").alias("raw_name"), raw("business_address").alias("raw_address"), *keep)
    script = F.lit("latin") if ascii_input else N.script_type(F.col("raw_name"))
    out = out.withColumns({"script_type": script, "is_domain_name": N.is_domain_name(F.col("raw_name")), "country_key": N.slug(F.col("country"))})
    out = N.with_latin_name(out, "raw_name", "_clean", ocr, ascii_input)
    out = out.withColumns({"_words": N.strip_suffixes(N.tokens(F.col("_clean")))})
    latin = F.col("script_type") == "latin"
    if ascii_input:
        out = out.withColumns({"_roman": F.lit("")})
    else:
        roman = F.when(latin | (F.col("script_type") == "mixed"), F.lit("")).otherwise(indic.transliterate_name(F.col("raw_name"), F.col("script_type")))
        out = out.withColumns({"_roman": roman})
        out = out.withColumns({"_words": F.when(F.col("_roman") != "", N.strip_suffixes(N.tokens(F.col("_roman")))).otherwise(F.col("_words"))})
    words = F.col("_words")
    out = out.withColumns({
        "name_full": F.when(latin, F.col("_clean")).otherwise(F.col("raw_name")),
        "name_no_suffix": F.array_join(words, " "),
        "name_sorted": N.sorted_name(words),
        "name_first2": N.first_two(words),
        "name_ascii": F.when(latin, F.col("_clean")).otherwise(F.lit("")),
        "name_transliterated": F.when(latin, F.col("_clean")).otherwise(F.col("_roman")),
        "name_transliterated_no_suffix": F.array_join(words, " "),
    })
    out = addresses.parse(out.drop("_clean", "_words", "_roman"), ascii_input=ascii_input)
    return out.select(*COLUMNS, "country_key", *keep)


def split_by_country(records: DataFrame) -> DataFrame:
    """country, src and rows of every partition; rows without a country are a partition of their own."""
    country = F.when(F.col("country") == "", F.lit("__unknown__")).otherwise(F.col("country"))
    return records.groupBy(country.alias("country"), "src").agg(F.count("*").alias("n"))
