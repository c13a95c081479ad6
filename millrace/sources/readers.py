"""Sources: delimited files of entities and ground truth, Parquet layouts, and a derived data set for tests and benches."""

from __future__ import annotations

import warnings
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import null_fold, slug

RAW = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A tab-separated file with a header, all text, missing values folded to the empty string.

    columns: those wanted, so that nothing is inferred; absent ones are added empty.  multi_line: quoted fields hold line
    feeds; such a file can't be split, so it is one task.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    df = reader.csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return with_columns(df, columns or df.columns)


def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns as text: missing values and absent columns are empty."""
    return df.select(*[null_fold(F.col(c).cast("string")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def load_sources(spark: SparkSession, train_dir: str, test_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities with split and src, ground truth) of train_source1.tsv .. test_source3.tsv and train_ground_truth.tsv."""
    parts = []
    for split, folder in (("train", train_dir), ("test", test_dir)):
        for n in (1, 2, 3):
            rows = read_tsv(spark, f"{folder}/{split}_source{n}.tsv", RAW)
            parts.append(rows.withColumns({"split": F.lit(split), "src": F.lit(f"s{n}")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, read_tsv(spark, f"{train_dir}/train_ground_truth.tsv", TRUTH)


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    """A table of normalised records, written as TSV (file name in .tsv) or as Parquet."""
    return read_tsv(spark, path) if path.endswith(".tsv") else spark.read.parquet(path)


def load_partition(spark: SparkSession, root: str, split: str, country: str) -> DataFrame:
    """Normalised records of one country of a layout partitioned by (split, country_key, src): the scan is pruned.

    Warns where the layout has no such partition; the table is empty then."""
    key = spark.range(1).select(slug(F.lit(country))).first()[0]
    if key not in partition_names(spark, f"{root}/split={split}", "country_key"):
        warnings.warn(f"no partition {split}/{key} below {root}", stacklevel=2)
    return spark.read.parquet(root).where((F.col("split") == split) & (F.col("country_key") == key))


def partition_names(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, from the names of the folders in ``path``: no data is read."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [x.getPath().getName() for x in files.listStatus(place) if x.isDirectory()]
    return sorted(unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{column}="))


def discover_countries(df: DataFrame) -> DataFrame:
    """country_key of every partition, sorted.  Of a stored layout ``partition_names`` lists them without a scan."""
    return df.select("country_key").distinct().orderBy("country_key")


def explore(df: DataFrame, n: int = 20, order: str = "entity_id") -> tuple[int, DataFrame]:
    """Row count and the first rows."""
    return df.count(), df.orderBy(order).limit(n)


def head_of_each(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each partition in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


#: Words of the names and addresses that ``derived_entities`` writes in Devanagari, and as Latin spellings.
INDIC_FIRST = ["श्री", "राम", "गणेश", "भारत", "नगर"]
LATIN_FIRST = ["Shri", "Ram", "Ganesh", "Bharat", "Nagar"]
INDIC_KIND = ["ट्रेडर्स", "स्टील", "लिमिटेड"]
LATIN_KIND = ["Traders", "Steel", "Limited"]
LEGAL = [" Pvt. Ltd.", " L.L.C.", " Corp.", " & Co", ""]
ACCENTED, PLAIN = "éèêóñüäöçí", "eeeonuaoci"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _listed(values: list[str], i: str) -> str:
    """SQL for values[i % len(values)], in both dialects."""
    return "CASE " + " ".join(f"WHEN {i} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def entity_sql(source: str, title: str, div: str, first: str) -> str:
    """SELECT of the entities that each page gives, one a source, in SQL that Spark and DuckDB share.

    source: relation of the pages.  title: expression of the whole title.  div: integer division by {0} of the id.
    first: expression of the first word of t.
    """
    tens = div.format("pid", 5)
    indic = f"{_listed(INDIC_FIRST, 'pid')} || ' ' || {_listed(INDIC_FIRST, tens)} || ' ' || {_listed(INDIC_KIND, 'pid')}"
    latin = f"{_listed(LATIN_FIRST, 'pid')} || ' ' || {_listed(LATIN_FIRST, tens)} || ' ' || {_listed(LATIN_KIND, 'pid')}"
    number, code = "CAST(pid % 90 + 1 AS STRING)", "CAST({0} + pid % 500 AS STRING)"
    names = {
        0: f"CASE WHEN pid % 7 = 2 THEN {indic} ELSE t || {_listed(LEGAL, 'pid')} END",
        1: f"""CASE WHEN pid % 7 = 2 THEN {indic} WHEN pid % 4 = 0 THEN translate(t, '{LOWER}', '{UPPER}') || ' LIMITED' WHEN pid % 4 = 1 THEN rest || ' ' || w
               WHEN pid % 4 = 2 THEN w || '.com ' || rest ELSE t || ' & Sons Private Limited' END""",
        2: f"""CASE WHEN pid % 13 = 12 THEN reverse(t) WHEN pid % 7 = 2 THEN {latin} WHEN pid % 3 = 0 THEN substr(translate(t, '{ACCENTED}', '{PLAIN}'), 1, 2) || substr(translate(t, '{ACCENTED}', '{PLAIN}'), 4)
               WHEN pid % 3 = 1 THEN t || ' लिमिटेड' ELSE 'M/s ' || t || ' (Regd)' END""",
    }
    zip_code, pin = code.format(70000), code.format(400001)
    addresses = {
        0: ("{n} || ' ' || w || ' Road, Fort Worth, TX ' || {z}", "{n} || ', ' || w || ' Nagar, Andheri, Mumbai, Maharashtra ' || {p}", "w || ', Plateau, Abidjan'"),
        1: ("'Suite ' || {n} || ', ' || w || ' St, Fort Worth, Texas'", "w || ' Nagar, Andheri East, Mumbai, महाराष्ट्र ' || {p}", "w || ', Plateau, Abidjan 1'"),
        2: ("'Fort Worth, TX ' || {z} || '-1234, ' || {n} || ' ' || w || ' Road'", "'मुंबई, Flat ' || {n} || ', ' || w || ' Road, उत्तर प्रदेश'", "{n} || ' Rue ' || w || ', Abidjan'"),
    }
    parts = []
    for k in (0, 1, 2):
        us, india, other = (x.format(n=number, z=zip_code, p=pin) for x in addresses[k])
        missing = "pid % 9 = 4 OR pid % 13 = 12" if k == 2 else "pid % 9 = 4"
        parts.append(f"""SELECT CAST(pid * 3 + {k} AS STRING) AS entity_id, 's{k + 1}' AS src, CASE WHEN pid % 5 < 2 THEN 'US' WHEN pid % 5 < 4 THEN 'India' ELSE 'Côte d''Ivoire' END AS country,
  {names[k]} AS business_name, CASE WHEN {missing} THEN '' WHEN pid % 9 = 5 THEN {"'NULL'" if k == 1 else "''"} WHEN pid % 5 < 2 THEN {us} WHEN pid % 5 < 4 THEN {india} ELSE {other} END AS business_address FROM titled""")
    return f"""titles AS (SELECT page_id AS pid, {title} AS t FROM {source} WHERE page_id IS NOT NULL AND html IS NOT NULL),
titled AS (SELECT pid, t, w, trim(substr(t, length(w) + 1)) AS rest FROM (SELECT pid, t, {first} AS w FROM titles)),
entities AS ({" UNION ALL ".join(parts)})"""


#: DuckDB SQL for ``derived_entities``.
DERIVED_SQL = entity_sql("pages", "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))", "({0} // {1})", "split_part(t, ' ', 1)").replace("STRING", "VARCHAR")


def derived_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, src, country, business_name, business_address: three entities of each page, one a source.

    The name is the page's whole title in its own letters, in another form for each source: with legal words, in
    capitals, in another order, without accents and a letter, with words in Devanagari, or wholly in Devanagari.
    Addresses are American, Indian (some with native states) or neither, and some are missing.  entity_id is
    3 * page_id + 0, 1 or 2, so entities of one page are the true matches.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    sql = entity_sql("{pages}", r"trim(regexp_extract(html, '<title>([^<]*)</title>', 1))", "({0} div {1})", "substring_index(t, ' ', 1)")
    return spark.sql(f"WITH {sql} SELECT * FROM entities", pages=pages)
