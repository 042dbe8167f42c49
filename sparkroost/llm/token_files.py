"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A shard is four files without headers, little-endian, so that any language can map them:

* ``tokens-<shard>.bin`` the ids of all its documents, uint16 if the vocabulary allows, else uint32;
* ``tokens-<shard>.off`` ``n + 1`` int64 offsets, in ids, of the documents in the shard;
* ``tokens-<shard>.ids`` ``n`` int64 doc_ids (0 where it is null);
* ``tokens-<shard>.has`` ``n`` bytes, 0 where the doc_id is null, else 1.

Shards hold ascending ranges of (doc_id, hash of text); a shard's base, the number of ids before
it, is the prefix sum of the shards' totals. Files are first written under a name of the task
attempt and then renamed, and only what the manifest names is read, so lost executors and
speculative copies leave no wrong shard.

All ids come from the tokenizers library. Where the vocabulary's splitter is the byte-level one
without a normalizer, a split always lies between a character that is no space and an ASCII space
after it, and nothing after a split depends on what is before it; so a text is cut there and the
library's ids of each chunk are kept in a bounded memo; a line end, letters and the
marks after them are pieces of their own, which go to the library's merge model directly. Texts with a space beyond ASCII or the
string of an added token, and all texts of other vocabularies, go to the library in one piece.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows that
repeat a doc_id are ordered by their text's hash; an empty table gives an empty table.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared
from ._chunks import any_of, different, gather, spans
from ._words import pack

END_ID = 2
SHARD_BYTES = 32 << 20
#: Spaces beyond ASCII, and characters that some Unicode versions count as such.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Chunks of one word, with a line end before and marks after it: the byte-level splitter cuts them
#: there alone.
WORD = re.compile("(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
MEMO_CHUNKS, MEMO_CHARS = 400_000, 40


@functools.lru_cache(maxsize=1)
def byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, with their bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to ids, as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.whole = re.compile("|".join([WIDE_SPACE.pattern, *added]))
        split = spec["pre_tokenizer"] or {}
        self.chunked = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True) and not spec["normalizer"]
        #: First bytes of what ``whole`` looks for: a text without them needn't be searched.
        begins = ["\x85", "\u1680", "\u2000", "\u3000", "\ufeff", *(t["content"] for t in spec["added_tokens"])]
        self.suspect = np.isin(np.arange(256), [x.encode("utf-8")[0] for x in begins])
        self.char_of = {b: c for c, b in byte_chars().items()}
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _merge(self, word: bytes) -> bytes:
        return _packed([t.id for t in self.library.model.tokenize("".join([self.char_of[b] for b in word]))])

    def _missing(self, chunk: bytes) -> bytes:
        """The ids of a chunk that the memo lacks; it forgets the older half when it is full."""
        ids = self.older.get(chunk)
        if ids is None:
            text = chunk.decode("utf-8")
            parts = WORD.fullmatch(text) if len(text) <= MEMO_CHARS else None
            if not parts:
                ids = _packed(self.library.encode(text, add_special_tokens=False).ids)
            elif parts[2] != text:
                ids = b"".join([self._ids(part.encode("utf-8")) for part in parts.groups() if part])
            else:
                ids = self._merge(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_CHUNKS:
                self.memo, self.older = {}, self.memo
            self.memo[chunk] = ids
        return ids

    def _ids(self, chunk: bytes) -> bytes:
        return self.memo.get(chunk) or self._missing(chunk)

    def _in_chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end, first = spans(data, offsets, lead=True)
        of, head = different(data, begin, end)
        raw = data.tobytes()
        return gather(of, [self._ids(raw[a:b]) for a, b in zip(begin[head].tolist(), end[head].tolist(), strict=True)], first)

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts of a column, and where each text's begin (``n + 1`` of them)."""
        data, offsets = pack(column)
        odd = any_of(self.suspect[data], offsets) if self.chunked else np.ones(len(column), bool)
        whole = {}
        for i in np.flatnonzero(odd).tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
            if not self.chunked or self.whole.search(text):
                whole[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if not whole:
            return self._in_chunks(data, offsets)
        rest = np.ones(len(column), bool)
        rest[list(whole)] = False
        tokens, at = self._in_chunks(*pack(column.filter(pa.array(rest))))
        parts, k = [], 0
        for i in range(len(column)):
            if i in whole:
                parts.append(whole[i])
            else:
                parts.append(tokens[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write_shard(vocabulary: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles, TaskContext

        task = TaskContext.get()
        shard, encode = task.partitionId(), encoder(SparkFiles.get(vocabulary))
        kind = np.uint16 if max(encode.size, end_id + 1) <= 1 << 16 else np.uint32
        fs, root = _shared.open_fs(folder)
        fs.create_dir(root, recursive=True)
        trial = f"{root}/trial-{shard}-{task.taskAttemptId()}"
        ids, has, lens = [], [], []
        with fs.open_output_stream(f"{trial}.bin") as out:
            for batch in _shared.parts(batches):
                tokens, at = encode.batch(batch.column(1))
                lens.append(np.diff(at) + 1)
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                has.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
                out.write(np.insert(tokens.astype(np.dtype(kind).newbyteorder("<")), at[1:], end_id).tobytes())
        if not lens:
            fs.delete_file(f"{trial}.bin")
            return
        ends = np.cumsum(np.concatenate(lens))
        for end_of, body in (("off", np.append(0, ends).astype("<i8")), ("ids", np.concatenate(ids).astype("<i8")), ("has", np.concatenate(has))):
            with fs.open_output_stream(f"{trial}.{end_of}") as out:
                out.write(body.tobytes())
        name = f"tokens-{shard:06d}-{task.taskAttemptId()}"
        for end_of in ("bin", "off", "ids", "has"):
            fs.move(f"{trial}.{end_of}", f"{root}/{name}.{end_of}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": pa.array([len(ends)], pa.int64()), "n_tokens": pa.array([int(ends[-1])], pa.int64()), "width": pa.array([np.dtype(kind).itemsize], pa.int32())})

    return run


MANIFEST = "shard int, name string, n_docs long, n_tokens long, width int"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards of ``docs`` under ``folder`` (which all executors reach) and return the
    manifest: shard, name, n_docs, n_tokens, width, base. One row for each shard."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // shard_bytes + 1)
    vocabulary = _shared.send_file(spark, Path(tokenizer_path).read_bytes(), "tokenizer.json")
    tie = F.xxhash64("text").alias("tie")
    ordered = rows.select("doc_id", "text", tie).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = _shared.keep(ordered.mapInArrow(_write_shard(vocabulary, end_id, folder), MANIFEST), "manifest")
    held = sorted(manifest.collect(), key=lambda r: r["shard"])  # one small row for each shard
    base, out = 0, []
    for r in held:
        out.append((*r, base))
        base += r["n_tokens"]
    return spark.createDataFrame(out, MANIFEST + ", base long")


def map_shard(folder: str, name: str, width: int, n_docs: int, n_tokens: int) -> tuple[np.ndarray, ...]:
    """(tokens, offsets, doc_ids, has) of a shard; mapped, not read, where the folder is a mount."""
    from pyarrow import fs as pafs

    fs, root = _shared.open_fs(folder)
    out = []
    for end_of, kind, n in (("bin", f"<u{width}", n_tokens), ("off", "<i8", n_docs + 1), ("ids", "<i8", n_docs), ("has", "u1", n_docs)):
        if isinstance(fs, pafs.LocalFileSystem):
            out.append(np.memmap(f"{root}/{name}.{end_of}", kind, "r", shape=(n,)))
        else:
            with fs.open_input_file(f"{root}/{name}.{end_of}") as f:
                out.append(np.frombuffer(f.read_buffer(), kind, n))
    return tuple(out)


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens, offsets, ids, has = map_shard(folder, r["name"], r["width"], r["n_docs"], r["n_tokens"])
                for lo in range(0, r["n_docs"], 4096):
                    hi = min(lo + 4096, r["n_docs"])
                    part = tokens[offsets[lo] : offsets[hi]].astype("<u4")
                    at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(np.array(ids[lo:hi]), pa.int64(), mask=has[lo:hi] == 0),
                            "start": pa.array(offsets[lo:hi] + r["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets[lo : hi + 1]), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(part[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                        }
                    )

    return run


def read_index(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(_read_shards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = _shared.scratch(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_index(manifest, folder)
