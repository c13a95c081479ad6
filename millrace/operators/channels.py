"""The seven blocking channels: equi-joins and a sparse top-k join within one (country_key, src).

Each takes the query side ``s1`` and the target side ``targets`` (rows of one or more sources, column ``src``) and
returns distinct (country_key, src, s1_id, target_id) pairs.  S2 and S3 go through one job.  Keys always start with
(country_key, src); hot keys are left to AQE's skew join, and no key is dropped or capped.  What is broadcast is the
list of (country_key, src), measured first.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.constants import STOPWORDS, Config
from millrace.functions.names import quoted, strip, tokens
from millrace.sources.staging import staged

PAIR = ["country_key", "src", "s1_id", "target_id"]
NAMES = ["name_no_suffix", "name_sorted", "name_first2", "name_transliterated_no_suffix"]
LABELS = ["A", "B", "C", "D", "E", "F", "G"]


def text(df: DataFrame, column: str) -> Column:
    """A column as text; absent columns and nulls are empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit("")


def flag(df: DataFrame, column: str) -> Column:
    """A boolean that may have been stored as text."""
    return F.lower(strip(text(df, column))).isin("true", "1", "yes")


def sides(s1: DataFrame, targets: DataFrame, make) -> tuple[DataFrame, DataFrame]:
    """make(df) -> extra columns; the query side keyed by (country_key, s1_id), the target side by (country_key, src, target_id)."""
    q = s1.select("country_key", F.col("entity_id").alias("s1_id"), *make(s1))
    t = targets.select("country_key", "src", F.col("entity_id").alias("target_id"), *make(targets))
    return q, t


def matched(q: DataFrame, t: DataFrame, on: list[str]) -> DataFrame:
    return q.join(t, ["country_key", *on]).select(*PAIR).distinct()


def with_address(s1: DataFrame) -> DataFrame:
    return s1.where(flag(s1, "has_address")) if "has_address" in s1.columns else s1.limit(0)


def address_keys(df: DataFrame) -> tuple[Column, Column]:
    """(the strong keys: pin, zip, street number with first locality token; the first locality token)."""
    pin, code, street = (strip(text(df, c)) for c in ("pin_code", "zip_code", "street_num"))
    local = F.coalesce(F.get(tokens(F.lower(text(df, "locality_tokens"))), 0), F.lit(""))
    strong = F.array(
        F.when(pin != "", F.concat(F.lit("p"), pin)),
        F.when(code != "", F.concat(F.lit("z"), code)),
        F.when((street != "") & (local != ""), F.concat_ws("\x01", F.lit("s"), F.lower(street), local)),
    )
    return F.filter(strong, lambda k: k.isNotNull()), local


def channel_a_strong(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Equal pin, zip, or street number with first locality token."""
    q, t = sides(with_address(s1), targets, lambda df: [F.explode(address_keys(df)[0]).alias("key")])
    return matched(q, t, ["key"])


#: Rows up to which the list of (country_key, src) is broadcast.
SOURCES = 100_000


def source_list(targets: DataFrame) -> DataFrame:
    """country_key, src of the targets, to be broadcast if it is as short as it should be."""
    rows = targets.select("country_key", "src").distinct()
    return F.broadcast(rows) if rows.limit(SOURCES + 1).count() <= SOURCES else rows


def channel_a_fallback(s1: DataFrame, targets: DataFrame, strong: DataFrame) -> DataFrame:
    """Equal first locality token, for the entities that have no strong hit in the source."""
    q, t = sides(with_address(s1), targets, lambda df: [address_keys(df)[1].alias("key")])
    q = q.where("key <> ''").join(source_list(targets), "country_key")
    q = q.join(strong.select("country_key", "src", "s1_id").distinct(), ["country_key", "src", "s1_id"], "left_anti")
    return q.join(t.where("key <> ''"), ["country_key", "src", "key"]).select(*PAIR).distinct()


def channel_a(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    strong = channel_a_strong(s1, targets)
    return strong.unionByName(channel_a_fallback(s1, targets, strong))


def name_tokens(df: DataFrame) -> Column:
    words = tokens(F.lower(F.concat_ws(" ", *[text(df, c) for c in NAMES])))
    return F.array_except(F.array_distinct(words), F.expr(f"array({quoted(STOPWORDS)})"))


def token_weights(targets: DataFrame) -> DataFrame:
    """country_key, src, token, df, idf = ln(1 + N / df); N counts all target records."""
    keys = ["country_key", "src"]
    n = targets.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = targets.select(*keys, F.explode(name_tokens(targets)).alias("token"))
    df = rows.groupBy(*keys, "token").agg(F.count("*").alias("df")).join(n, keys)
    return df.select(*keys, "token", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def channel_b(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Shared name tokens that are rare among the targets; pairs are made in blocks, but for those that must share several."""
    from millrace.operators import pairing

    if config.min_overlap <= 1:
        return pairing.channel_pairs("B", s1, targets, config)
    q, t = sides(s1, targets, lambda df: [F.explode(name_tokens(df)).alias("token")])
    rare = token_weights(targets).where(F.col("idf") >= config.idf_floor).select("country_key", "src", "token")
    hits = q.join(t.join(rare, ["country_key", "src", "token"]), ["country_key", "token"])
    return hits.distinct().groupBy(*PAIR).agg(F.count("*").alias("n")).where(F.col("n") >= config.min_overlap).select(*PAIR)


def shingles(name: Column, k: int) -> Column:
    s = F.replace(name, F.lit(" "), F.lit("_"))
    return F.array_distinct(windows(s, k))


#: Shingle codes and permutations are taken modulo this prime.
PRIME = (1 << 31) - 1


@functools.cache
def lsh_parameters(threshold: float, permutations: int) -> tuple[int, int]:
    """(bands, rows) of at most ``permutations`` values in all that err least: the chance to miss a pair above the threshold
    plus the chance to take one below it, integrated over similarity."""
    x = np.linspace(0, 1, 1001)
    low, high = x <= threshold, x >= threshold

    def error(bands: int, rows: int) -> float:
        found = 1 - (1 - x**rows) ** bands
        return float(np.trapezoid(found[low], x[low]) + np.trapezoid(1 - found[high], x[high]))

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=lambda p: (error(*p), p))


@functools.cache
def multipliers(n: int, seed: int = 1) -> tuple[list[int], list[int]]:
    """Factors and terms of n permutations x -> (a * x + b) mod PRIME."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, n).tolist(), rng.integers(0, PRIME, n).tolist()


def gram_codes(names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the grams of n characters of each name as numbers, blanks as underscores; a shorter name is one gram."""
    sizes = np.array([len(x) for x in names], np.int64)
    letters = np.frombuffer("".join(names).replace(" ", "_").encode("utf-32-le"), np.uint32).astype(np.int64)
    counts = np.maximum(sizes - n + 1, 1)
    starts = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(starts, counts)
    first, size = np.repeat(np.cumsum(sizes) - sizes, counts), np.repeat(sizes, counts)
    letters = np.append(letters, 0)
    codes = np.zeros(len(place), np.int64)
    for i in range(n):
        at = place + i
        codes = (codes * 1114112 + letters[np.where(at < size, first + at, -1)]) % PRIME
    return codes, starts


def least_permuted(names: DataFrame, config: Config) -> DataFrame:
    """``names`` (name) with the least gram code under each permutation, as an array."""
    bands, rows = lsh_parameters(config.minhash_threshold, config.minhash_permutations)
    factors, terms = multipliers(bands * rows)
    k = config.shingle

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                codes, starts = gram_codes(batch.column(0).to_pylist(), k)
                low = np.stack([np.minimum.reduceat((codes * a + b) % PRIME, starts) for a, b in zip(factors, terms, strict=True)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * low.shape[1]), pa.array(low.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["name", "low"])

    return names.select("name").mapInArrow(run, "name string, low array<long>")


def minhash_bands(low: Column, config: Config) -> Column:
    """(band, key) of the least permuted gram codes; the parameters follow from the threshold and the permutations."""
    bands, rows = lsh_parameters(config.minhash_threshold, config.minhash_permutations)

    def key(band: int) -> Column:
        own = [F.get(low, band * rows + r) for r in range(rows)]
        return own[0] if rows == 1 else own[0] * F.lit(PRIME) + own[1] if rows == 2 else F.xxhash64(*own)

    return F.array(*[F.struct(F.lit(i).alias("band"), key(i).alias("key")) for i in range(bands)])


def names_and_bands(s1: DataFrame, targets: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides by name (three columns each), and the bands (band, key) of each distinct name."""

    def make(df: DataFrame):
        columns = ["name_no_suffix", "name_transliterated_no_suffix", "name_sorted"]
        return [F.explode(F.array_distinct(F.array(*[strip(text(df, c)) for c in columns]))).alias("name")]

    q, t = (side.where("name <> ''") for side in sides(s1, targets, make))
    names = q.select("name").unionByName(t.select("name")).distinct()
    return q, t, least_permuted(names, config).select("name", minhash_bands(F.col("low"), config).alias("bands"))


def channel_c(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Names that share a MinHash band; three name columns on both sides, each distinct name hashed once, and pairs are made in blocks."""
    from millrace.operators import pairing

    return pairing.channel_pairs("C", s1, targets, config)


def sound_tokens(df: DataFrame) -> list[Column]:
    words = tokens(F.lower(F.concat_ws(" ", text(df, "name_no_suffix"), text(df, "name_transliterated_no_suffix"))))
    return [F.explode(F.array_distinct(words)).alias("token")]


def channel_d(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """A shared Double Metaphone code of any name token; distinct tokens are coded once, and pairs are made in blocks."""
    from millrace.operators import pairing

    return pairing.channel_pairs("D", s1, targets, config)


def windows(s: Column, n: int) -> Column:
    """All substrings of n characters; the whole if it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))


def char_grams(value: Column, low: int, high: int) -> Column:
    """Character n-grams of each word with a blank at both ends; a padded word no longer than n is one gram, once."""

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        parts = []
        for n in range(low, high + 1):
            # a word shorter than n has given its only gram already
            parts.append(windows(padded, n) if n == low else F.when(size >= n, windows(padded, n)).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(tokens(F.lower(value)), grams))


@functools.lru_cache(1 << 16)
def word_grams(word: str, low: int, high: int) -> tuple[str, ...]:
    """``char_grams`` of one word, in Python."""
    padded = f" {word} "
    size = len(padded)
    # a word shorter than n has given its only gram already
    return tuple(padded[i : i + n] for n in range(low, high + 1) if size >= n or n == low for i in range(max(size - n + 1, 1)))


def gram_counts(texts: list[str], config: Config) -> Counter:
    """Grams of a record's texts, each with its words between single blanks."""
    return Counter(g for text in texts for word in text.split(" ") if word for g in word_grams(word, config.gram_low, config.gram_high))


#: Different grams that a task counts before it passes them on.
COUNTED = 1 << 18


def vocabulary(texts: DataFrame, n: DataFrame, config: Config) -> DataFrame:
    """country_key, src, gram, rank, idf: the ``max_features`` first grams by total count; counted in tasks, so that only sums move."""

    def run(batches):
        import pyarrow as pa

        def out():
            rows = list(zip(*((*k, v[0], v[1]) for k, v in seen.items()), strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in rows[:3]), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=["country_key", "src", "gram", "df", "total"])

        seen: dict = {}
        for batch in batches:
            for country, src, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for gram, tf in gram_counts(own, config).items():
                    sums = seen.setdefault((country, src, gram), [0, 0])
                    sums[0] += 1
                    sums[1] += tf
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    keys = ["country_key", "src"]
    stats = texts.select(*keys, "texts").mapInArrow(run, "country_key string, src string, gram string, df long, total long")
    stats = stats.groupBy(*keys, "gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    top = Window.partitionBy(*keys).orderBy(F.desc("total"), "gram")
    stats = stats.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= config.max_features)
    return stats.join(n, keys).select(*keys, "gram", "rank", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


class Weights:
    """Sublinear tf times smoothed idf, unit length, by the vocabulary of one (country_key, src)."""

    def __init__(self, grams: list[str], ranks: np.ndarray, idf: np.ndarray):
        self.at, self.ranks, self.idf = {g: i for i, g in enumerate(grams)}, ranks, idf

    def of(self, ids: list[str], records: list[list[str]], config: Config) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(ids, gram ranks, weights, sizes) of the records that have a gram of the vocabulary."""
        named, at, tfs, sizes = [], [], [], []
        for name, record in zip(ids, records, strict=True):
            own = [(self.at[g], tf) for g, tf in gram_counts(record, config).items() if g in self.at]
            if own:
                named.append(name)
                sizes.append(len(own))
                at += [x[0] for x in own]
                tfs += [x[1] for x in own]
        at, sizes = np.array(at, np.int64), np.array(sizes, np.int64)
        w = (1 + np.log(np.array(tfs, float))) * self.idf[at]
        if len(named):
            w /= np.repeat(np.sqrt(np.add.reduceat(w * w, np.cumsum(sizes) - sizes)), sizes)
        return named, self.ranks[at], w, sizes


def name_text(df: DataFrame) -> Column:
    return joined(df, ["name_no_suffix", "name_transliterated_no_suffix", "name_sorted"])


def address_text(df: DataFrame) -> Column:
    return joined(df, ["locality_tokens", "state_token", "address_transliterated"])


def joined(df: DataFrame, columns: list[str]) -> Column:
    return strip(F.concat_ws(" ", *[F.nullif(text(df, c), F.lit("")) for c in columns]))


def top_similar(s1: DataFrame, targets: DataFrame, make, floor: float, config: Config, ask=None) -> DataFrame:
    """PAIR and sim: exact cosine of weighted grams in blocks, the ``top_k`` of each entity, then the floor.

    ask: which of ``s1`` are queries; all of them count for the statistics, as the address channel needs.
    """
    q = s1.select("country_key", F.col("entity_id").alias("id"), make(s1).alias("text"), (ask(s1) if ask else F.lit(True)).alias("asks")).where("text <> ''")
    t = targets.select("country_key", "src", F.lit("t").alias("side"), F.col("entity_id").alias("id"), make(targets).alias("text")).where("text <> ''")
    keys = ["country_key", "src"]
    both = q.join(source_list(t), "country_key").select(*keys, F.lit("q").alias("side"), "id", "text", "asks").unionByName(t.withColumn("asks", F.lit(False)))
    words = F.array_join(tokens(F.lower(F.col("text"))), " ")
    texts = staged(both.groupBy(*keys, "side", "id").agg(F.collect_list(words).alias("texts"), F.count("*").alias("n"), F.bool_or("asks").alias("asks")))
    grams = staged(vocabulary(texts, texts.groupBy(*keys).agg(F.sum("n").alias("n")), config))
    hits = block_similar(texts.where("side = 'q' and asks"), texts.where("side = 't'"), grams, config)
    best = Window.partitionBy("country_key", "src", "s1_id").orderBy(F.desc("sim"), "target_id")
    return hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= config.top_k).where(F.col("sim") >= floor).drop("n")


#: Targets that a task holds, queries that pass by at once, and queries of one task.
HELD, PASSING, ASKED = 4096, 256, 1 << 16
SIMILAR = "country_key string, src string, s1_id string, target_id string, sim double"


def block_similar(left: DataFrame, right: DataFrame, grams: DataFrame, config: Config) -> DataFrame:
    """PAIR and sim (9 digits): exact dot products of unit vectors, the ``top_k`` of each entity within each block of targets.

    Frequent grams are shared by nearly all entities of a country, so a join on grams makes a row for each shared gram of
    each pair.  Instead a task holds a block of ``HELD`` targets by gram, and the queries of the country stream past it:
    targets move once, queries once for each block.  Work is the shared grams of each pair, without rows.  What moves are
    texts and the vocabulary; weights are made where they are used.
    """
    keys = ["country_key", "src"]

    def dealt(side: DataFrame, by: str, size: int) -> tuple[DataFrame, DataFrame]:
        n = side.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(f"n_{by}"))
        return side.join(n, keys).withColumn(by, F.pmod(F.xxhash64("id"), F.col(f"n_{by}")).cast("int")).drop(f"n_{by}"), n

    def every(rows: DataFrame, n: DataFrame, by: str) -> DataFrame:
        return rows.join(n, keys).withColumn(by, F.explode(F.sequence(F.lit(0), F.col(f"n_{by}") - 1))).drop(f"n_{by}")

    q, n_q = dealt(left, "qb", ASKED)
    t, n_t = dealt(right, "tb", HELD)
    q, t, words = every(q, n_t, "tb"), every(t, n_q, "qb"), every(every(grams, n_t, "tb"), n_q, "qb")
    none = F.array().cast("array<string>").alias("texts")
    kind = lambda rows, k, *more: rows.select(*keys, "qb", "tb", F.lit(k).alias("kind"), *more)
    plain = ["id", "texts", F.lit(0).alias("rank"), F.lit(0.0).alias("idf")]
    rows = kind(words, 0, F.col("gram").alias("id"), none, "rank", "idf").unionByName(kind(t, 1, *plain)).unionByName(kind(q, 2, *plain))
    rows = rows.repartition(*keys, "qb", "tb").sortWithinPartitions(*keys, "qb", "tb", "kind", "id")

    def run(batches):
        import pyarrow as pa

        names = [*keys, "s1_id", "target_id", "sim"]
        key = weights = block = None
        words: list = []
        held: list = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:7]]
            numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in (7, 8)]
            own = list(zip(*columns[:5], strict=True))
            cut = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if own[a][:4] != key:
                    key, weights, block, words, held = own[a][:4], None, None, [], []
                if own[a][4] == 0:
                    words.append((columns[5][a:b], numbers[0][a:b], numbers[1][a:b]))
                    continue
                if weights is None:
                    weights = Weights([g for x in words for g in x[0]], np.concatenate([np.empty(0, np.int64), *(x[1] for x in words)]), np.concatenate([np.empty(0), *(x[2] for x in words)]))
                if own[a][4] == 1:
                    held += [weights.of(columns[5][i : min(i + PASSING, b)], columns[6][i : min(i + PASSING, b)], config) for i in range(a, b, PASSING)]
                    continue
                block = block or Held(held)
                for i in range(a, b, PASSING):
                    j = min(i + PASSING, b)
                    asked, *vectors = weights.of(columns[5][i:j], columns[6][i:j], config)
                    row, col, sim = block.best(*vectors, config.top_k)
                    if len(row):
                        ids = block.ids
                        found = [[key[0]] * len(row), [key[1]] * len(row), [asked[r] for r in row.tolist()], [ids[c] for c in col.tolist()], sim]
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in found[:4]), pa.array(found[4])], names=names)

    return rows.mapInArrow(run, SIMILAR)


class Held:
    """A block of sparse unit vectors by gram."""

    def __init__(self, parts: list):
        self.ids = [i for p in parts for i in p[0]]
        grams, ws, sizes = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)) if parts else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        row = np.repeat(np.arange(len(self.ids)), sizes)
        order = np.argsort(grams, kind="stable")
        self.row, self.w = row[order], ws[order]
        self.grams, self.starts = np.unique(grams[order], return_index=True)
        self.sizes = np.diff(np.append(self.starts, len(order)))
        # grams that more than an eighth of the block has are multiplied as a dense matrix
        self.dense = np.flatnonzero(self.sizes > max(8, len(self.ids) // 8))
        self.matrix = np.zeros((len(self.dense), len(self.ids)))
        for i, g in enumerate(self.dense.tolist()):
            part = slice(self.starts[g], self.starts[g] + self.sizes[g])
            self.matrix[i, self.row[part]] = self.w[part]
        self.place = np.full(len(self.grams), -1)
        self.place[self.dense] = np.arange(len(self.dense))

    def best(self, grams: np.ndarray, ws: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, target, similarity) of the k most similar targets with a shared gram of each query; ties to the first."""
        n, m = len(sizes), len(self.ids)
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not n or not len(self.grams):
            return none
        row = np.repeat(np.arange(n), sizes)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        own = self.grams[at] == grams
        row, at, w = row[own], at[own], ws[own]
        place = self.place[at]
        thick = place >= 0
        left = np.zeros((n, len(self.dense)))
        left[row[thick], place[thick]] = w[thick]
        sims = left @ self.matrix
        row, at, w = row[~thick], at[~thick], w[~thick]
        count = self.sizes[at]
        spread = np.repeat(np.arange(len(at)), count)
        entry = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count) + self.starts[at][spread]
        sims += np.bincount(row[spread] * m + self.row[entry], weights=w[spread] * self.w[entry], minlength=n * m).reshape(n, m)
        sims = np.round(sims, 9)
        least = np.partition(sims, m - k, axis=1)[:, m - k] if m > k else np.zeros(n)
        row, col = np.nonzero((sims >= least[:, None]) & (sims > 0))
        sim = sims[row, col]
        order = np.lexsort((col, -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], col[rank < k], sim[rank < k]


def channel_e(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    return top_similar(s1, targets, name_text, config.name_floor, config).select(*PAIR)


def channel_f(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    return top_similar(s1, targets, address_text, config.address_floor, config, lambda df: flag(df, "has_address")).select(*PAIR)


def channel_g(s1: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """Equal sorted names."""
    q, t = (side.where("name <> ''") for side in sides(s1, targets, lambda df: [strip(text(df, "name_sorted")).alias("name")]))
    return matched(q, t, ["name"])


CHANNELS = {"A": channel_a, "B": channel_b, "C": channel_c, "D": channel_d, "E": channel_e, "F": channel_f, "G": channel_g}
