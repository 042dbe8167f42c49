"""Cross-tokenizer alignment: token intervals of two vocabularies, joined by byte offsets in DuckDB.

1. A text, with a space before it, is cut into runs (white space and the word after it) where no token of either
   vocabulary can cross; a text with a space beyond ASCII, or with white space that ends a piece of the second
   vocabulary (a carriage return), is one run. Each different run of a block is encoded once by both libraries, and once for many blocks of the same worker.
2. The new runs' tokens are two interval tables on one axis of bytes, in a DuckDB of the task: an ASOF join finds the
   token of A that ends with or after each token of B, a window sum of the common ends numbers the groups, a second
   ASOF join gives A's tokens their group. A third finds the first token of A that shares bytes with each of B; the range
   from there to the first partner, joined by number (so in linear time), is all pairs that share bytes; those
   that end together are the links.
3. Documents get the sums of their runs by joins in the same DuckDB, the digest of their groups, and their links by pair
   of ids. The task's partial pair counts are merged in Spark.
4. A pair that ends together is one where a token's bytes end with the other's, so there are at most as many pairs as
   both vocabularies have bytes (times two, for byte pieces): the totals are sent to every task, whatever the corpus.

Defined results: texts that are null or empty, and those whose tokens' bytes are not the text's (U+2581, which the second
vocabulary takes for a space), have no tokens: zeros, and an empty digest. They give no links. Repeated ids have a row
each; null ids stay null; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared
from ._chunks import any_of, different, spans
from ._words import pack
from .token_files import WIDE_SPACE, Encoder, byte_chars

#: Text of one block, runs aligned at a time, and what a worker remembers before it begins anew.
BLOCK_BYTES, LEARN_RUNS, MEMO_RUNS, MEMO_BYTES = 4 << 20, 50_000, 400_000, 32 << 20
_WIDE = np.isin(np.arange(256), [x.encode("utf-8")[0] for x in ("\x85", "\u1680", "\u2000", "\u3000", "\ufeff")])
STAGED = "doc_id long, is_doc boolean, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, links binary, a int, b int, n long"

#: Tokens ``a`` and ``b`` (run, n: number, id, lo, hi: bytes on one axis) of runs whose bytes both give.
ALIGN = """
CREATE OR REPLACE TEMP TABLE of_b AS
  SELECT b.run, b.n, b.id, b.lo, b.hi, a.n AS last, a.hi = b.hi AS meets,
    coalesce(sum((a.hi = b.hi)::INT) OVER (ORDER BY b.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
  FROM b ASOF JOIN a ON b.hi <= a.hi;
CREATE OR REPLACE TEMP TABLE of_a AS
  SELECT a.run, a.n, a.id, a.lo, a.hi, e.g, a.hi = e.hi AS ends FROM a ASOF JOIN (SELECT hi, g FROM of_b WHERE meets) e ON a.hi <= e.hi;
CREATE OR REPLACE TEMP TABLE overlap AS
  SELECT y.run, x.id AS a, y.id AS b, x.hi = y.hi AS meets
  FROM (SELECT b.*, unnest(range(a.n, b.last + 1)) AS n_a FROM of_b b ASOF JOIN of_a a ON b.lo < a.hi) y JOIN of_a x ON x.n = y.n_a;
INSERT INTO link SELECT run, a, b, count(*)::BIGINT FROM overlap WHERE meets GROUP BY ALL;
INSERT INTO run_sums
  SELECT run, n_a, n_b, n_groups, n_links, n_overlaps
  FROM (SELECT run, count(*)::BIGINT AS n_a, count(DISTINCT g)::BIGINT AS n_groups FROM of_a GROUP BY run)
  JOIN (SELECT run, count(*)::BIGINT AS n_b FROM of_b GROUP BY run) USING (run)
  JOIN (SELECT run, count(*) FILTER (meets)::BIGINT AS n_links, count(*)::BIGINT AS n_overlaps FROM overlap GROUP BY run) USING (run);
"""
#: Tokens group by group, A's before B's; ``ends``: the last of its side in the group.
GROUPS = """
SELECT run, id, side, ends FROM (
  SELECT run, 0::TINYINT AS side, n, id, g, ends FROM of_a UNION ALL SELECT run, 1::TINYINT, n, id, g, meets FROM of_b)
ORDER BY g, side, n
"""
#: ``seen`` (doc, run): the runs of a block, one row for each occurrence.
SUMS = """
SELECT doc, sum(k * n_a)::BIGINT AS n_a, sum(k * n_b)::BIGINT AS n_b, sum(k * n_groups)::BIGINT AS n_groups, sum(k * n_links)::BIGINT AS n_links, sum(k * n_overlaps)::BIGINT AS n_overlaps
FROM held JOIN run_sums USING (run) GROUP BY doc ORDER BY doc
"""
LINKS = "SELECT doc, a, b, sum(k * n)::BIGINT AS n FROM held JOIN link USING (run) GROUP BY doc, a, b ORDER BY doc, a, b"


class Pieces:
    """The second vocabulary: a run's ids as in the whole text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode("utf-8") for i, x in enumerate(names)]
        #: White space into which a piece goes on from a word: texts with it aren't cut.
        self.joins = np.isin(np.arange(256), sorted({m[0] for x in self.bytes for m in re.findall(b"(?<=[^ \t-\r])[ \t-\r]", x)}))
        self.before = len(self.library.encode("x"))

    def ids(self, runs: list[str]) -> list[list[int]]:
        """A run follows a letter, since the library puts a space of its own before a text."""
        return [x[self.before :] for x in self.library.encode(["x" + r for r in runs], num_threads=1)]


class Aligner:
    """A worker's two vocabularies and its DuckDB of aligned runs."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb

        self.a, self.b = Encoder(a_path), Pieces(b_path)
        self.a.library.encode_special_tokens = True
        chars = byte_chars()
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * self.a.size
        for x, i in vocab.items():
            self.a_bytes[i] = bytes(chars[c] for c in x) if all(c in chars for c in x) else x.encode("utf-8")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b.bytes))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b.bytes)))], object) for mark in ",|;")
        self.cut = self.a.chunked and not self.b.joins[32]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.said: list[str | None] = []
        self.size = 0
        self.db.execute("CREATE OR REPLACE TEMP TABLE link (run INT, a INT, b INT, n BIGINT); CREATE OR REPLACE TEMP TABLE run_sums (run INT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_overlaps BIGINT)")

    def _tokens(self, name: str, runs: np.ndarray, flat: np.ndarray, count: np.ndarray, size: np.ndarray) -> None:
        """Register an interval table: the runs' tokens one after the other, on the axis of all runs' bytes."""
        hi = np.cumsum(size[flat])
        self.db.register(name, pa.table({"run": np.repeat(runs, count), "n": np.arange(len(flat)), "id": flat.astype(np.int32), "lo": hi - size[flat], "hi": hi}))

    def learn(self, new: list[bytes]) -> None:
        """Encode and align runs that the memo lacks; one whose bytes differ is remembered without tokens."""
        a = list(map(self.a._ids, new))
        b = self.b.ids([x.decode("utf-8") for x in new])
        first = len(self.said)
        self.memo.update(zip(new, itertools.count(first)))
        self.said += [None] * len(new)
        self.size += sum(map(len, new))
        good = range(len(new))
        flat = lambda: (np.frombuffer(b"".join([a[i] for i in good]), np.uint32).astype(np.int64), np.fromiter(itertools.chain.from_iterable(b[i] for i in good), np.int64))
        bytes_of = lambda ids, of: b"".join([of[t] for t in ids.tolist()])
        of_a, of_b = flat()
        if not bytes_of(of_a, self.a_bytes) == b"".join(new) == bytes_of(of_b, self.b.bytes):
            same = lambda i: bytes_of(np.frombuffer(a[i], np.uint32), self.a_bytes) == new[i] == b"".join([self.b.bytes[t] for t in b[i]])
            good = [i for i in good if same(i)]
            of_a, of_b = flat()
        if not len(good):
            return
        runs = np.array(good, np.int32) + np.int32(first)
        self._tokens("a", runs, of_a, np.array([len(a[i]) // 4 for i in good]), self.a_size)
        self._tokens("b", runs, of_b, np.array([len(b[i]) for i in good]), self.b_size)
        self.db.execute(ALIGN)
        got = self.db.execute(GROUPS).fetchnumpy()
        said = np.where(got["ends"], np.where(got["side"] == 0, self.bar[got["id"]], self.semicolon[got["id"]]), self.comma[got["id"]]).tolist()
        cut = np.flatnonzero(np.diff(got["run"], prepend=-1, append=-1)).tolist()
        for run, x, y in zip(runs.tolist(), cut[:-1], cut[1:], strict=True):
            self.said[run] = "".join(said[x:y])[:-1]

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first): runs of each text; one for a text that can't be cut."""
        begin, end, first = spans(data, offsets, lead=True)
        whole = any_of(self.b.joins[data], offsets) | (not self.cut)
        stays = np.ones(len(begin), bool)
        for i in np.flatnonzero(whole | any_of(_WIDE[data], offsets)).tolist():
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            if first[i + 1] > first[i] and (whole[i] or WIDE_SPACE.search(data[lo:hi].tobytes().decode("utf-8"))):
                stays[first[i] + 1 : first[i + 1]] = False
                end[first[i]] = hi
        return begin[stays], end[stays], np.concatenate([[0], np.cumsum(stays)])[first]

    def block(self, column: pa.Array) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
        """(sums by text, digests, links) of one block of texts."""
        n = len(column)
        data, offsets = pack(column)
        empty = np.diff(offsets) == 0
        data = np.insert(data, offsets[:-1], 32)
        offsets = offsets + np.arange(n + 1)
        begin, end, first = self._runs(data, offsets)
        of, head = different(data, begin, end)
        raw = data.tobytes()
        own = [raw[x:y] for x, y in zip(begin[head].tolist(), end[head].tolist(), strict=True)]
        new = [x for x in own if x not in self.memo]
        if len(self.memo) + len(new) > MEMO_RUNS or self.size + sum(map(len, new)) > MEMO_BYTES:
            self.forget()
            new = own  # a block's own runs are bounded by its bytes
        for lo in range(0, len(new), LEARN_RUNS):
            self.learn(new[lo : lo + LEARN_RUNS])
        run = np.fromiter((self.memo[x] for x in own), np.int32, len(own))[of]
        bad = np.fromiter((self.said[x] is None for x in run.tolist()), bool, len(run))
        doc = np.repeat(np.arange(n), np.diff(first))
        good = ~empty
        good[doc[bad]] = False
        kept = good[doc]
        self.db.register("seen", pa.table({"doc": doc[kept].astype(np.int32), "run": run[kept]}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE held AS SELECT doc, run, count(*)::BIGINT AS k FROM seen GROUP BY doc, run")
        got = self.db.execute(SUMS).fetchnumpy()
        at, sums = got.pop("doc"), {k: np.zeros(n, np.int64) for k in got}
        for k, values in got.items():
            sums[k][at] = values
        digests = [hashlib.sha256(";".join([self.said[x] for x in run[first[i] : first[i + 1]].tolist()]).encode()).hexdigest() if good[i] else "" for i in range(n)]
        return sums, digests, self.db.sql(LINKS).to_arrow_table()


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``BLOCK_BYTES`` of text; a text over that is a batch by itself."""
    for batch in _shared.parts(batches):
        _, offsets = pack(batch.column(1))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = min(j, n)


def _stage(a_name: str, b_name: str):
    names = [x.split()[0] for x in STAGED.split(", ")]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def rows(n: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        own = aligner(SparkFiles.get(a_name), SparkFiles.get(b_name))
        own.db.execute("CREATE OR REPLACE TEMP TABLE partial (a INT, b INT, n BIGINT)")
        for batch in _in_blocks(batches):
            sums, digests, links = own.block(batch.column(1))
            own.db.register("links", links)
            own.db.execute("INSERT INTO partial SELECT a, b, sum(n)::BIGINT FROM links GROUP BY a, b")
            own.db.unregister("links")
            cut = np.searchsorted(links.column("doc").to_numpy(), np.arange(batch.num_rows + 1))
            a, b, n = (links.column(k).to_numpy() for k in ("a", "b", "n"))
            packed = [np.concatenate([a[x:y], b[x:y]]).astype("<i4").tobytes() + n[x:y].astype("<i8").tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield rows(batch.num_rows, doc_id=batch.column(0), is_doc=[True] * batch.num_rows, groups_sha256=digests, links=packed, **sums)
        totals = own.db.sql("SELECT a, b, sum(n)::BIGINT AS n FROM partial GROUP BY a, b ORDER BY a, b").to_arrow_table()
        for batch in totals.to_batches(max_chunksize=65536):
            yield rows(batch.num_rows, is_doc=[False] * batch.num_rows, a=batch.column(0), b=batch.column(1), n=batch.column(2))

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table of documents and partial pair counts (``STAGED``); ``pair_counts`` and ``documents`` read it."""
    spark = docs.sparkSession
    a_name, b_name = _shared.send_file(spark, Path(a_path).read_bytes(), "a.json"), _shared.send_file(spark, Path(b_path).read_bytes(), "b.model")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _shared.keep(rows.mapInArrow(_stage(a_name, b_name), STAGED), "aligned", rows=2048)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): each linked pair of ids, its links corpus-wide, and whether no other id of A has more with b."""
    totals = aligned.where(~F.col("is_doc")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def documents(aligned: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps) for each row."""
    found = pair_counts(aligned).select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n", "best")
    held = sorted(map(tuple, found.collect()))  # bounded by the vocabularies' bytes
    sent = aligned.sparkSession.sparkContext.broadcast((np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], bool)))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total, best = sent.value
        for batch in _shared.parts(batches):
            n_best, count_sum = [], []
            for raw in batch.column("links"):
                own = raw.as_py()
                k = len(own) // 16
                a, b, n = np.frombuffer(own, "<i4", k), np.frombuffer(own, "<i4", k, 4 * k), np.frombuffer(own, "<i8", k, 8 * k)
                at = np.searchsorted(pairs, a.astype(np.int64) << 32 | b)
                n_best.append(int(n[best[at]].sum()) if k else 0)
                count_sum.append(int((n * total[at]).sum()) if k else 0)
            held = {name: batch.column(name) for name in batch.schema.names} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            yield pa.RecordBatch.from_pydict({x.split()[0]: held[x.split()[0]] for x in schema.split(", ")})

    rows = aligned.where("is_doc").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_overlaps", "links")
    return rows.mapInArrow(run, schema)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return documents(aligned)
