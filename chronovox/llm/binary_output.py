"""Token ids as compressed binary files: documents in doc_id order, blocks coded with a shared
static rANS table, every block decodable on its own.

A file set is a folder with two Parquet parts: `table` (the frequency of each id) and `blocks` (one row
per block: file, number in it, ids in it, doc_ids, n_tokens, payload).  Blocks hold
whole documents; files follow each other in doc_id order, and blocks within a file do.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronovox.llm.common import batched, partitions, ragged, saved, scratch
from chronovox.llm.rans import Coder, frequency_table
from chronovox.llm.words import WordTable, ascii_words, text_slices

END_ID = 2
#: A block is closed when it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
SLICE = 6 << 20
#: Pieces of words that a worker remembers at most.
PIECES = 500_000
VOCABULARY = "word_bpe_49k.json"

_BLOCK = "part int, block long, n_ids long, doc_ids binary, known binary, n_tokens binary, ids binary"
_FILE = "part int, block long, n_ids long, doc_ids binary, known binary, n_tokens binary, payload binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: The split of this vocabulary's tokenizer: contractions, runs of letters, single digits, the rest.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that may end a plain word; a run of them is one piece of its own.
_MARKS = string.punctuation

_TABLES: dict = {}


def word_encoder(path: str):
    """A table from words to their ids, made once by a worker.

    The vocabulary's steps (normalisation per character, a split that never spans white space, merges
    within a split) never cross ASCII white space, so a text's ids are those of its words in order.
    A word of plain letters and closing marks needs no normalisation but lower case; the library's
    merges then run once per distinct piece.  All other words go through the whole tokenizer.
    """
    if path in _TABLES:
        return _TABLES[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.loads(whole.to_str())
    split = spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {})
    plain = split.get("Regex") == _SPLIT  # another vocabulary goes through the whole tokenizer
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    merges = Tokenizer.from_str(json.dumps(spec))

    def run(tok, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every = [e.ids for at in range(0, len(items), 5000) for e in tok.encode_batch_fast(items[at : at + 5000], add_special_tokens=False)]
        lengths = np.fromiter(map(len, every), np.int64, len(every))
        return lengths, np.fromiter(chain.from_iterable(every), np.int64, int(lengths.sum()))

    pieces = WordTable(lambda items: run(merges, items), PIECES)

    def encode(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, all ids) of distinct words."""
        if not plain:
            return run(whole, items)
        words = pa.array(items, pa.large_string())
        stems = pc.utf8_rtrim(words, characters=_MARKS)
        marks = np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(stems))
        good = np.asarray(pc.ascii_is_alpha(stems)).copy()
        wide_at = np.flatnonzero(~np.asarray(pc.string_is_ascii(stems)))
        lowered = pc.ascii_lower(stems)
        if len(wide_at):
            wide = stems.take(pa.array(wide_at)).to_pylist()
            ok = [x.isalpha() and "\u0130" not in x and "\u03a3" not in x and unicodedata.is_normalized("NFC", x) for x in wide]
            good[wide_at] = ok
            mask = np.zeros(len(words), bool)
            mask[wide_at] = True
            lowered = pc.replace_with_mask(lowered, pa.array(mask), pa.array([x.lower() for x in wide], lowered.type))
        stem_len, stem_ids = pieces.expand(lowered.filter(pa.array(good)))
        tail = np.flatnonzero(good & (marks > 0))
        ends_of = [w[-m:] for w, m in zip(words.take(pa.array(tail)).to_pylist(), marks[tail].tolist(), strict=True)]
        tail_len, tail_ids = pieces.expand(pa.array(ends_of, pa.large_string()))
        odd = np.flatnonzero(~good)
        odd_len, odd_ids = run(whole, words.take(pa.array(odd)).to_pylist())
        lengths = np.zeros(len(words), np.int64)
        first = np.zeros(len(words), np.int64)
        first[good] = stem_len
        first[odd] = odd_len
        lengths += first
        lengths[tail] += tail_len
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int64)
        out[ragged(starts[good], stem_len)] = stem_ids
        out[ragged(starts[odd], odd_len)] = odd_ids
        out[ragged(starts[tail] + first[tail], tail_len)] = tail_ids
        return lengths, out

    _TABLES[path] = WordTable(encode, PIECES)
    return _TABLES[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each text, end id included; all ids)."""
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)  # no special token in sight, whose case would count
    counts, words = ascii_words(texts)
    per_word, flat = word_encoder(path).expand(words)
    upto = np.concatenate([[0], np.cumsum(per_word)])
    ends = upto[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([[0], ends]))
    return lengths + 1, np.insert(flat, ends, END_ID)


def tokenized_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Rows of _BLOCK in doc_id order: part is the range partition, block counts within it."""
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that share a doc_id, or have none, are spread by their texts
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = ordered.repartitionByRange(max(4, partitions(spark)), *keys)
    ordered = ordered.sortWithinPartitions(*keys, "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        part, block, ids_of, size = 0, 0, [], 0

        def flush():
            ids = np.concatenate([x for _, _, x in ids_of]).astype("<u4")
            lengths = np.concatenate([x for _, x, _ in ids_of]).astype("<u4")
            doc_ids = [x for d, _, _ in ids_of for x in d]
            known = np.array([x is not None for x in doc_ids], np.uint8)
            keys = np.array([x or 0 for x in doc_ids], "<i8")
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": [keys.tobytes()], "known": [known.tobytes()], "n_tokens": [lengths.tobytes()], "ids": [narrow(ids)]}
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for first, texts in text_slices(batch, SLICE):
                lengths, ids = encode_texts(texts, path)
                ends = np.cumsum(lengths)
                at = 0
                while at < len(lengths):
                    done = ends[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(ends, done + BLOCK_IDS - size, "right")))
                    ids_of.append((doc_ids[first + at : first + end], lengths[at:end], ids[done : ends[end - 1]]))
                    size += int(ends[end - 1] - done)
                    at = end
                    if at < len(lengths) or size >= BLOCK_IDS:
                        yield flush()
                        block, ids_of, size = block + 1, [], 0
        if ids_of:
            yield flush()

    return batched(ordered).mapInArrow(run, _BLOCK)


def narrow(ids: np.ndarray) -> bytes:
    """Ids for the intermediate table: 16 bits each where all fit, low bytes before high ones."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + planes.tobytes()


def wide(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint32)


def write_ids(docs: DataFrame, folder: str | None = None, path: str | None = None) -> str:
    """Encode every text of docs (null: empty), append the end id, write the file set; its folder.

    Null doc_ids come last; repeated rows are written as often as they come; an empty table gives a
    file set without blocks.  Only the id counts (one per vocabulary entry) come to the driver.
    """
    spark, path = docs.sparkSession, path or default_path()
    folder = folder or scratch(spark, "ids")
    blocks = saved(tokenized_blocks(docs, path), "tokenized")

    def count(batches):
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                got = np.bincount(wide(data))
                if len(got) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(got) - len(seen), np.int64)])
                seen[: len(got)] += got
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "n": pa.array(seen[ids], pa.int64())})

    counted = blocks.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([END_ID, *(r.id for r in counted)]) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    freq = frequency_table(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)] or [(END_ID, 1)], "id int, freq int").coalesce(1).write.parquet(f"{folder}/table")

    def pack(batches):
        coder = Coder(freq)
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([r["part"]], pa.int32()), "block": pa.array([r["block"]], pa.int64()), "n_ids": pa.array([r["n_ids"]], pa.int64()), "doc_ids": [r["doc_ids"]], "known": [r["known"]], "n_tokens": [r["n_tokens"]], "payload": [coder.encode(wide(r["ids"]))]}
                )

    packed = batched(blocks).mapInArrow(pack, _FILE)
    packed.write.parquet(f"{folder}/blocks")
    return folder


def _frequencies(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/table").collect()
    freq = np.zeros(max(r.id for r in rows) + 1, np.uint32)
    for r in rows:
        freq[r.id] = r.freq
    return freq


def read_ids(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the file set.

    Each block is checked and decoded by itself.  start comes from the blocks' lengths: a sum within
    each file, and one row per file for the files before it.
    """
    freq = _frequencies(spark, folder)
    schema = "part int, block long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def unpack(batches):
        coder = Coder(freq)
        for batch in batches:
            for r in batch.to_pylist():
                flat = coder.decode(r["payload"]).astype("<u4")
                lengths = np.frombuffer(r["n_tokens"], "<u4").astype(np.int64)
                if lengths.sum() != len(flat):
                    raise ValueError("block and document lengths differ")
                ends = np.cumsum(lengths)
                view, n = memoryview(flat.tobytes()), len(lengths)
                keys = np.frombuffer(r["doc_ids"], "<i8")
                known = np.frombuffer(r["known"], np.uint8) == 0
                cols = {
                    "part": pa.array(np.full(n, r["part"], np.int32)), "block": pa.array(np.full(n, r["block"], np.int64)),
                    "doc_id": pa.array(keys, mask=known), "at": pa.array(ends - lengths), "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64()),
                }
                if ids:
                    cols["ids"] = pa.array([flat[e - k : e].astype(np.int32) for e, k in zip(ends, lengths, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.select("part", "block", F.col("n_ids").alias("n"))
    within = Window.partitionBy("part").orderBy("block")
    sizes = sizes.withColumn("before", F.sum("n").over(within) - F.col("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    bases = sizes.join(parts, "part").select("part", "block", (F.col("base") + F.col("before")).alias("base"))
    docs = batched(blocks).mapInArrow(unpack, schema)
    out = docs.join(bases, ["part", "block"])
    return out.select("doc_id", (F.col("base") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op5_binary_output(spark, sf_dir: str) -> DataFrame:
    from chronovox.llm.common import table

    folder = write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read_ids(spark, folder)
