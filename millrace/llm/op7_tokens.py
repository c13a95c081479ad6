"""Token-ID / binary output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by id.  Each partition writes one shard: ``shard-00000.bin`` (ids,
little-endian, 16 bits where the vocabulary allows it, else 32), ``.idx`` (64-bit offsets of the documents in the
shard, one more than there are documents) and ``.ids`` (64-bit document ids).  A shard is written under a name of
its task attempt and renamed when whole, so a task that is run again after a lost executor does no harm.  The
driver gets one row of counts a shard, and their prefix sums are the shards' bases; ``read_tokens`` maps the
files into memory and adds the bases.

Null texts are empty: their only id is the end id.  A null doc_id sorts first and is stored as the least 64-bit
integer.  Repeated ids are all kept, ordered by a hash of the text.  A very long text is encoded by itself.  Other columns are ignored; an empty table
gives no shards and no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

NO_ID = -(1 << 63)
#: Entries of one generation of a worker's caches.
CACHE = 500_000
#: Input bytes that one shard is for, and ids that are read at once.
SHARD, READ = 1 << 28, 1 << 22
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
COUNTS = "shard int, n_docs long, n_tokens long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pre-tokenizer pattern and the normalizers of the word tokenizer whose pieces are cached below.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: What that pattern and lower-casing give on plain text: ASCII white space and print, and the Latin-1 letters.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Cache:
    """What has been encoded, in two generations of at most ``CACHE`` entries, so that frequent keys stay."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def need(self, keys: set[str]) -> list[str]:
        """Those of the keys that must be encoded; the others are in ``young`` now."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        if self.old:
            kept = [k for k in new if k in self.old]
            self.young.update((k, self.old[k]) for k in kept)
            new.difference_update(kept)
        return list(new)


class Encoder:
    """Texts to little-endian id bytes.

    With ``by_word`` each distinct white-space word is encoded once by the library and its ids are joined.  That is
    right for tokenizers that drop white space and never look across it; None asks for it only where the tokenizer's own
    file has the normalizers and the pattern above.  There plain texts are split into its pre-tokens instead, which repeat
    more often than words.
    """

    def __init__(self, path: str, by_word: bool | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = splits[:1] == [SPLIT] and steps == NORMALIZERS
        self.by_word = known if by_word is None else by_word
        self.by_piece = self.by_word and known
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.pieces = Cache(), Cache()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Encodings of pre-tokens, many in one text: each token names the pre-token that it is from."""
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        at, data = np.array(found.word_ids), np.array(found.ids, self.dtype).tobytes()
        cut = (np.searchsorted(at, np.arange(len(pieces) + 1)) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _joined(self, split: list[list[str]], cache: Cache, encode, size: int) -> list[bytes]:
        new = cache.need(set().union(*split))
        for i in range(0, len(new), size):
            cache.young.update(zip(new[i : i + size], encode(new[i : i + size]), strict=True))
        return [b"".join(map(cache.young.__getitem__, keys)) for keys in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encoded(texts)
        plain = [self.by_piece and PLAIN.fullmatch(x) is not None and not any(t in x for t in self.special) for x in texts]
        pieces = iter(self._joined([PIECE.findall(x.lower()) for x, p in zip(texts, plain, strict=True) if p], self.pieces, self._together, 1000))
        words = iter(self._joined([WORD.findall(x) for x, p in zip(texts, plain, strict=True) if not p], self.words, self._encoded, 4096))
        return [next(pieces if p else words) for p in plain]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, by_word: bool | None) -> Encoder:
    """One encoder a worker process."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def _groups(texts: list[str], limit: int = 1 << 21):
    """Runs of texts of about ``limit`` characters."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 2, by_word: bool | None = None, partitions: int | None = None) -> list[dict]:
    """Write shards below the URI ``out``; return and save (manifest.json) shard, n_docs, n_tokens and the bases."""
    spark = docs.sparkSession
    store.arrow_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(size, 1 << 50) // SHARD))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    # the hash lets ranges cut among equal ids, so that neither null nor repeated ids are one shard
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    fs, top = store.filesystem(out)
    fs.create_dir(top, recursive=True)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        encode, (files, place) = encoder(path, by_word), store.filesystem(out)
        name = f"{place}/shard-{task.partitionId():05d}"
        tries = {x: f"{name}.{x}.try{task.taskAttemptId()}" for x in ("bin", "idx", "ids")}
        end = np.array([end_id], encode.dtype).tobytes()
        total = count = 0
        streams = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams is None:
                streams = {x: files.open_output_stream(p) for x, p in tries.items()}
                streams["idx"].write(np.zeros(1, "<i8").tobytes())
            streams["ids"].write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for run in _groups(batch.column(1).to_pylist()):
                parts = encode.encode(run)
                sizes = np.array([len(x) // encode.dtype.itemsize + 1 for x in parts], np.int64)
                streams["bin"].write(end.join(parts) + end)
                streams["idx"].write((total + np.cumsum(sizes)).astype("<i8").tobytes())
                total, count = total + int(sizes.sum()), count + len(run)
        if streams:
            for x, stream in streams.items():
                stream.close()
                files.move(tries[x], f"{name}.{x}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([count], pa.int64()), pa.array([total], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    shards = sorted((r.asDict() for r in rows.mapInArrow(write, COUNTS).collect()), key=lambda r: r["shard"])
    base = first = 0
    for shard in shards:
        shard |= {"base": base, "first": first}
        base, first = base + shard["n_tokens"], first + shard["n_docs"]
    with fs.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps({"dtype": encoder(path, by_word).dtype.str, "shards": shards}).encode())
    return shards


class Mapped:
    """A file as an array: mapped into memory where the file system is local, else read in parts of ``READ`` entries."""

    def __init__(self, uri: str, dtype: str):
        files, place = store.filesystem(uri)
        self.dtype = np.dtype(dtype)
        self.size = files.get_file_info(place).size // self.dtype.itemsize
        self.map = self.file = None
        if files.type_name != "local":
            self.file = files.open_input_file(place)
        elif self.size:
            self.map = np.memmap(place, self.dtype, "r")
        self.low, self.held = 0, np.empty(0, self.dtype)

    def part(self, a: int, b: int) -> np.ndarray:
        """Entries a to b, at most ``READ`` of them."""
        if self.map is not None or a >= b:
            return self.map[a:b] if self.map is not None else self.held[:0]
        if not (self.low <= a and b <= self.low + len(self.held)):
            self.file.seek(a * self.dtype.itemsize)
            self.low, self.held = a, np.frombuffer(self.file.read(READ * self.dtype.itemsize), self.dtype)
        return self.held[a - self.low : b - self.low]

    def crc(self, a: int, b: int) -> int:
        """crc32 of entries a to b as little-endian 32-bit integers."""
        out = 0
        for i in range(a, b, READ):
            out = zlib.crc32(self.part(i, min(b, i + READ)).astype("<u4").tobytes(), out)
        return out


def read_tokens(spark: SparkSession, out: str, shards: list[dict], dtype: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""

    def read(frames):
        import pandas as pd

        for frame in frames:
            for shard, base in zip(frame["shard"], frame["base"], strict=True):
                ids, at, data = (Mapped(f"{out}/shard-{shard:05d}.{x}", t) for x, t in (("ids", "<i8"), ("idx", "<i8"), ("bin", dtype)))
                for i in range(0, ids.size, 5000):
                    own_ids = ids.part(i, min(ids.size, i + 5000))
                    ends = np.array(at.part(i, i + len(own_ids) + 1))
                    crc = [data.crc(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    own = pd.array(np.where(own_ids == NO_ID, 0, own_ids), "Int64")
                    own[np.asarray(own_ids == NO_ID)] = pd.NA
                    yield pd.DataFrame({"doc_id": own, "start": ends[:-1] + base, "n_tokens": np.diff(ends), "ids_crc32": crc, "shard": np.int32(shard)})

    rows = [(s["shard"], s["base"]) for s in shards]
    plan = spark.createDataFrame(rows, "shard int, base long").repartition(max(1, len(rows)), "shard")
    return plan.mapInPandas(read, TOKENS)


def token_output(docs: DataFrame, path: str | None = None, end_id: int = 2, by_word: bool | None = None, out: str | None = None) -> DataFrame:
    """Write the shards of ``docs``, then return what ``read_tokens`` reads back from them."""
    spark = docs.sparkSession
    path, out = path or tokenizer_path(), out or store.new_path(spark, "tokens")
    shards = write_tokens(docs, out, path, end_id, by_word)
    return read_tokens(spark, out, shards, encoder(path, by_word).dtype.str)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents with the 49k word tokenizer, read back."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
