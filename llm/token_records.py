"""Token-ID / binary output: framed records in shard files, with a separate offset index.

A record is ``length (u64) | masked crc32 of the length (u32) | payload | masked
crc32 of the payload (u32)``, all little-endian; the payload is the width of an id
in bytes (2 where the vocabulary has at most 65,536 entries, else 4) and a document's ids.  The mask rotates the checksum right by 15 bits and adds 0xa282ead8, so
that a checksum stored inside checksummed data does not weaken it.

Every task writes one shard under a name of its own and returns its index rows;
the index is a table committed by Spark, so files of failed or repeated attempts
are never referred to.  Order over shards is ascending document id.

Null text is an empty sequence (only the end id).  Rows with a null id come
first; repeated rows are all written.  An empty table gives an empty index.
Columns other than the id and text columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.session import shared_folder
from llm._common import read, store
from llm.registry import query

MASK = 0xA282EAD8
CACHE_WORDS = 800_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENCODERS: dict[str, Encoder] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; raises where a length or checksum is wrong."""
    length = record[:8]
    if masked(length) != int.from_bytes(record[8:12], "little") or len(record) != int.from_bytes(length, "little") + 16:
        raise ValueError("broken record: length")
    payload = record[12:-4]
    if masked(payload) != int.from_bytes(record[-4:], "little"):
        raise ValueError("broken record: payload checksum")
    return payload


class Encoder:
    """Ids of a text.  White space always parts tokens here, so each distinct word is encoded once and remembered.

    A word of plain Latin characters, on which the normalizer only lower-cases, is cut by the pre-tokenizer's pattern
    (read from the tokenizer file) and its pieces go straight to the BPE model; any other word takes the whole way.
    The memory is emptied when it holds ``CACHE_WORDS`` words; results do not depend on it.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        steps = json.loads(self.tokenizer.pre_tokenizer.__getstate__())["pretokenizers"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.plain = regex.compile("[!-~\u00a1-\u017f]+").fullmatch
        self.byte_chars = self._byte_chars()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _byte_chars(self) -> list[str]:
        """The printable character that stands for each byte, as the byte-level step makes it."""
        from tokenizers.pre_tokenizers import ByteLevel

        step, out = ByteLevel(add_prefix_space=False, use_regex=False), {}
        for code in (*range(0x80), *range(0x80, 0x800), 0x1000 * 15, *(0x1000 * i for i in range(1, 13)), 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
            for byte, mark in zip(chr(code).encode(), step.pre_tokenize_str(chr(code))[0][0], strict=True):
                out[byte] = mark
        return [out.get(byte, "") for byte in range(256)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def word(self, word: str) -> bytes:
        if "<|" in word or not (word.isascii() and word.isprintable() or self.plain(word)):
            return self.whole(word)
        small = word.lower()
        core = small.rstrip(PUNCTUATION)
        if core.isalpha():
            cut = (core, small[len(core) :]) if len(core) < len(small) else (core,)
        else:
            cut = self.cut(small)
        out = []
        for piece in cut:
            got = self.pieces.get(piece)
            if got is None:
                marks = self.byte_chars
                tokens = self.model.tokenize("".join([marks[b] for b in piece.encode()]))
                got = self.pieces[piece] = b"".join([token.id.to_bytes(self.width, "little") for token in tokens])
            out.append(got)
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split parts there, the tokenizer does not
                out.append(self.whole(text))
                continue
            parts = text.split()
            try:
                out.append(b"".join([known[part] for part in parts]))
            except KeyError:
                for part in parts:
                    if part not in known:
                        known[part] = self.word(part)
                out.append(b"".join([known[part] for part in parts]))
            if len(known) > CACHE_WORDS:
                known.clear()
                self.pieces.clear()
        return out


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_of(record: bytes) -> np.ndarray:
    """Ids of one framed record."""
    payload = unframe(record)
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_id: bool = True) -> DataFrame:
    """Encode, write shard files below ``folder`` and return the stored index.

    Records lie in ascending id order, or without ``by_id`` in the order in which a stored, shuffled table is read: a shard for each task.

    Index: ``doc_id, shard, place (order in the shard), path, position, length``.
    ``folder`` is any place that Spark and pyarrow.fs both reach.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if by_id:
        ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        start_mark, end_mark = bytes([encode.width]), end_id.to_bytes(encode.width, "little")
        target, where = pafs.FileSystem.from_uri(folder)
        path, out, place, position = f"{where}/shard-{shard:06d}-{uuid.uuid4().hex}.rec", None, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = []
                for ids in encode([text or "" for text in part.column(1).to_pylist()]):
                    record = frame(start_mark + ids + end_mark)
                    out = out or target.open_output_stream(path)
                    out.write(record)
                    rows.append((place, position, len(record)))
                    place, position = place + 1, position + len(record)
                if rows:
                    places, positions, lengths = map(pa.array, zip(*rows, strict=True))
                    n = len(rows)
                    columns = [part.column(0), pa.array([shard] * n, pa.int32()), places.cast(pa.int64()), pa.array([path.rsplit("/", 1)[1]] * n), positions.cast(pa.int64()), lengths.cast(pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "place", "path", "position", "length"])
        if out:
            out.close()

    return store(ordered.mapInArrow(run, "doc_id bigint, shard int, place bigint, path string, position bigint, length bigint"), "record-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, shard, place, n_tokens, ids_crc32`` of every record of ``index``, read by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            counts, sums = [], []
            for path, position, length in zip(*(batch.column(c).to_pylist() for c in ("path", "position", "length")), strict=True):
                if path != name:
                    name, source = path, fs.open_input_file(f"{where}/{path}")
                ids = ids_of(source.read_at(length, position))
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("place"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "shard", "place", "n_tokens", "ids_crc32"],
            )

    return index.mapInArrow(run, "doc_id bigint, shard int, place bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, ids array<bigint>`` of every record of ``index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            for path, position, length in zip(*(batch.column(c).to_pylist() for c in ("path", "position", "length")), strict=True):
                with fs.open_input_file(f"{where}/{path}") as source:
                    out.append(ids_of(source.read_at(length, position)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return index.mapInArrow(run, "doc_id bigint, ids array<bigint>")


def token_offsets(records: DataFrame) -> DataFrame:
    """Add ``start``: all ids before the record.  Running sums inside shards, one row per shard beyond that."""
    shard = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = records.withColumn("inside", F.coalesce(F.sum("n_tokens").over(shard), F.lit(0)))
    return inside.join(before, "shard").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def run_stage(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, by_id: bool = True) -> DataFrame:
    """Write ``docs`` (in the order of `write_records`), read every record back and return ``doc_id, start, n_tokens, ids_crc32``."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    index = write_records(docs, folder, tokenizer or default_tokenizer(), end_id, by_id=by_id)
    records = store(read_records(index, folder), "records-read")
    return token_offsets(records).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_token_records")
def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stage(spark, read(spark, sf_dir, "documents"))
