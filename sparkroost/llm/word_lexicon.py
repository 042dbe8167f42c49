"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words of all texts are counted; the most frequent ones and their token ids are compiled into a
minimal acyclic automaton over UTF-8 bytes (prefixes and suffixes are shared). An edge's output is
the number of words that precede those beyond it, so the outputs along a word's path add up to the
word's number, and a table holds the ids under that number. The automaton is one file of flat
arrays that workers memory-map. Words that it doesn't hold are merged exactly, by the byte-pair
rules of the vocabulary, and remembered by each worker up to a bound.

Texts of plain Latin characters are cut into words here; other texts are normalised and cut by the
tokenizers library's own normaliser and pre-tokeniser. Strings of added tokens are ids of their own.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated ids and
null ids keep a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import array
import functools
import json
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, functions as F

from . import _shared
from ._chunks import any_of, different, gather, spans
from ._words import pack
from .token_files import byte_chars

#: Words in the lexicon, at most: the bound on the compiled file (about 3 MB) and on what the driver gathers.
LEXICON_WORDS = 100_000
#: Levels of word counts in a doubling.
LEVELS = 16
#: Words that a worker remembers, at most.
MEMO_WORDS = 400_000
#: Characters on which all Unicode tables in use agree; a text with others takes the library's path.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞]")
#: Bytes that a text of printable ASCII lacks, and the one that begins added tokens.
_ODD = ~np.isin(np.arange(256), [9, 10, 13, *range(32, 60), *range(61, 127)])
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordCutter:
    """A text as its words; a word is a str, an added token an int id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added))) + ")") if added else None
        self.bytes_of = byte_chars()
        self.char_of = {b: c for c, b in self.bytes_of.items()}
        self.known: dict[bytes, list[str]] = {}

    def plain(self, text: str) -> list[str]:
        if not PLAIN.search(text):
            return WORD.findall(text.lower())
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in piece).decode("utf-8") for piece, _ in cut]

    def plain_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(plain, data, offsets): which texts may be cut at ASCII spaces first, each chunk by itself."""
        data, offsets = pack(column)
        plain = ~any_of(_ODD[data], offsets)
        for i in np.flatnonzero(~plain).tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
            plain[i] = not PLAIN.search(text) and "<|" not in text
        return plain, data, offsets

    def words_of(self, chunk: bytes) -> list[str]:
        """The words of a chunk of a plain text."""
        words = self.known.get(chunk)
        if words is None:
            if len(self.known) > MEMO_WORDS:
                self.known.clear()
            words = self.known[chunk] = self.plain(chunk.decode("utf-8"))
        return words

    def __call__(self, text: str) -> list:
        if not self.special or "<|" not in text:
            return self.plain(text)
        out: list = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.added[part]] if i % 2 else self.plain(part)
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of one word by the vocabulary's merges."""
        return [t.id for t in self.library.model.tokenize("".join(self.char_of[b] for b in word.encode("utf-8")))]


@functools.lru_cache(maxsize=2)
def cutter(path: str) -> WordCutter:
    return WordCutter(path)


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """Words with ids as one file: a minimal acyclic automaton, built word by word in byte order.

    Layout: seven int64 (states, edges, words, ids, and three zeros), then int32 arrays: each state's
    first edge (states + 1); each edge's label, target and output; each state's end mark; then the
    words' id offsets (words + 1) and the ids. State 0 is the root.
    """
    ordered = sorted((w.encode("utf-8"), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    path: list[list] = [[False, []]]  # of the word before: [end mark, finished edges]

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            edges.append(key[1])
        return register[key]

    before = b""
    for word, _ in ordered:
        same = 0
        for x, y in zip(before, word, strict=False):
            if x != y:
                break
            same += 1
        for depth in range(len(before), same, -1):
            path[depth - 1][1].append((before[depth - 1], freeze(path.pop())))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1][1].append((before[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    total = [0] * len(finals)  # words from each state; targets are frozen before their sources
    for s, own in enumerate(edges):
        total[s] = finals[s] + sum(total[t] for _, t in own)
    rename = lambda s: 0 if s == root else s + 1 if s < root else s
    first, label, target, output, end = [0], [], [], [], []
    for s in [root, *(x for x in range(len(finals)) if x != root)]:
        gone = int(finals[s])
        for b, t in edges[s]:
            label.append(b)
            target.append(rename(t))
            output.append(gone)
            gone += total[t]
        first.append(len(label))
        end.append(int(finals[s]))
    offsets = np.concatenate([[0], np.cumsum([len(ids) for _, ids in ordered])]) if ordered else np.zeros(1)
    ids = [i for _, own in ordered for i in own]
    head = np.array([len(end), len(label), len(ordered), len(ids), 0, 0, 0], "<i8")
    return head.tobytes() + b"".join(np.asarray(x, "<i4").tobytes() for x in (first, label, target, output, end, offsets, ids))


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        states, n_edges, self.n, n_ids = (int(x) for x in raw[:32].view("<i8"))
        at, parts = 56, []
        for k in (states + 1, n_edges, n_edges, n_edges, states, self.n + 1, n_ids):
            parts.append(raw[at : at + 4 * k].view("<i4"))
            at += 4 * k
        first, label, self.target, self.output, self.end, self.offsets, self.ids = parts
        self.key = np.repeat(np.arange(states, dtype=np.int64), np.diff(first)) * 256 + label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1: all words walk the automaton one byte at a time."""
        out = np.full(len(words), -1, np.int64)
        if not self.n or not words:
            return out
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lens) - lens
        live, state, number = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = lens[live] == step
            stop = live[done]
            out[stop] = np.where(self.end[state[stop]] == 1, number[stop], -1)
            live = live[~done]
            if not len(live) or not len(self.key):
                break
            want = state[live] * 256 + flat[begin[live] + step]
            e = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[e] == want
            live, e = live[ok], e[ok]
            state[live] = self.target[e]
            number[live] += self.output[e]
            step += 1
        return out

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        return [None if k < 0 else self.ids[self.offsets[k] : self.offsets[k + 1]] for k in self.numbers(words).tolist()]


class Codec:
    """Texts to ids and back, with a lexicon and a bounded memory of other words and of chunks."""

    def __init__(self, path: str, lexicon: Lexicon, memo_words: int = MEMO_WORDS):
        self.cut, self.lexicon, self.bound = cutter(path), lexicon, memo_words
        self.token = {i: t for t, i in self.cut.library.get_vocab(with_added_tokens=True).items()}
        self.memo: dict = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}

    def _learn(self, words: set) -> None:
        if len(self.memo) > self.bound:
            self.memo.clear()
        words = words.difference(self.memo)
        own = [w for w in words if isinstance(w, str)]
        for w, ids in zip(own, self.lexicon.lookup([w.encode("utf-8") for w in own]), strict=True):
            self._put(w, self.cut.merge(w) if ids is None else ids.tolist())
        for w in words.difference(own):
            self._put(w, [w])

    def _put(self, word, ids: list[int]) -> None:
        self.memo[word] = (array.array("I", ids).tobytes(), "".join([self.token[i] + " " for i in ids]).encode("utf-8"))

    def _joined(self, words: list) -> tuple[bytes, bytes]:
        """The ids of words, and what they decode to with a space after each that has ids."""
        if len(words) == 1:
            return self.memo[words[0]]
        found = [self.memo[w] for w in words]
        return b"".join([x for x, _ in found]), b"".join([y for _, y in found])

    def _in_chunks(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of texts that are cut into words chunk by chunk."""
        data, offsets = pack(column)
        begin, end, first = spans(data, offsets, lead=False)
        of, head = different(data, begin, end)
        raw = data.tobytes()
        own = [raw[a:b] for a, b in zip(begin[head].tolist(), end[head].tolist(), strict=True)]
        if len(self.chunks) > self.bound:
            self.chunks.clear()
        new = {c: self.cut.plain(c.decode("utf-8")) for c in own if c not in self.chunks}
        self._learn({w for words in new.values() for w in words})
        for c, words in new.items():
            self.chunks[c] = self._joined(words)
        found = [self.chunks[c] for c in own]
        ids, at = gather(of, [x for x, _ in found], first)
        shown, to = gather(of, [y for _, y in found], first, np.uint8)
        last = to[1:][np.diff(to) > 0] - 1  # the space after a text's last word
        to = to - np.concatenate([[0], np.cumsum(np.diff(to) > 0)])
        n, shown = len(column), np.delete(shown, last)
        binary = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(at * 4)), pa.py_buffer(np.ascontiguousarray(ids))])
        return binary, pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.ascontiguousarray(to)), pa.py_buffer(shown)])

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        words = self.cut(text)
        self._learn(set(words))
        ids, shown = self._joined(words)
        return ids, shown[:-1]

    def batch(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids as little-endian uint32 in one binary, decoded text) of each text of a column."""
        plain, data, offsets = self.cut.plain_texts(column)
        if plain.all():
            ids, shown = self._in_chunks(column)
        else:
            odd = np.flatnonzero(~plain)
            other = [self._whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")) for i in odd.tolist()]
            ids, shown = self._in_chunks(column.filter(pa.array(plain)))
            place = np.empty(len(column), np.int64)  # of each row among the plain texts, then the others
            place[plain], place[odd] = np.arange(len(ids)), len(ids) + np.arange(len(odd))
            ids = pa.concat_arrays([ids, pa.array([x for x, _ in other], pa.large_binary())]).take(pa.array(place))
            shown = pa.concat_arrays([shown, pa.array([y for _, y in other], pa.large_binary()).cast(pa.large_string())]).take(pa.array(place))
        return ids.cast(pa.binary()), shown.cast(pa.string())


def _count_words(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        cut = cutter(SparkFiles.get(vocabulary))
        chunks, seen = Counter(), Counter()

        def flush():
            for chunk, n in chunks.items():
                for w in cut.words_of(chunk):
                    seen[w] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            chunks.clear()

        for batch in _shared.parts(batches):
            plain, data, offsets = cut.plain_texts(batch.column(0))
            for i in np.flatnonzero(~plain).tolist():
                seen.update([w for w in cut(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")) if isinstance(w, str)])
            if not plain.all():
                data, offsets = pack(batch.column(0).filter(pa.array(plain)))
            begin, end, _ = spans(data, offsets, lead=False)
            of, head = different(data, begin, end)
            raw, many = data.tobytes(), np.bincount(of, minlength=len(head)).tolist()
            for a, b, n in zip(begin[head].tolist(), end[head].tolist(), many, strict=True):
                chunks[raw[a:b]] += n
            if len(chunks) + len(seen) > 1_000_000:  # sums continue after the shuffle
                yield from flush()
        yield from flush()

    return run


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", n_words: int = LEXICON_WORDS) -> bytes:
    """Count the words of all texts and compile the most frequent ones, at most ``n_words``: all words
    from the lowest count level (a 16th of a doubling) at which they still fit."""
    rows = docs.select(docs[text_col].cast("string").alias("text")).where("text is not null")
    vocabulary = _shared.send_file(docs.sparkSession, Path(tokenizer_path).read_bytes(), "tokenizer.json")
    counted = rows.mapInArrow(_count_words(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = _shared.keep(counted.withColumn("level", F.floor(F.log2("n") * LEVELS).cast("int")), "words")
    least, total = None, 0  # the lowest level down to which all words fit
    for level, n in sorted((tuple(r) for r in counts.groupBy("level").count().collect()), reverse=True):  # at most 63 * LEVELS rows
        total += n
        if total > n_words:
            break
        least = level
    top = counts.where(F.lit(False) if least is None else F.col("level") >= least).select("word")
    cut = cutter(tokenizer_path)
    words = [r[0] for r in top.collect()]  # at most n_words, the stated bound
    _shared.drop(docs.sparkSession, *_shared.paths(counts))
    return compile_lexicon({w: cut.merge(w) for w in words})


def _encode(vocabulary: str, lexicon: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        codec = Codec(SparkFiles.get(vocabulary), Lexicon(SparkFiles.get(lexicon)))
        for batch in _shared.parts(batches):
            ids, decoded = codec.batch(batch.column(1))
            n = pa.compute.cast(pa.compute.divide(pa.compute.binary_length(ids), 4), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", n_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row; ids are little-endian uint32 in one binary."""
    spark = docs.sparkSession
    lexicon = _shared.send_file(spark, build_lexicon(docs, tokenizer_path, text_col, n_words), "lexicon.bin")
    vocabulary = _shared.send_file(spark, Path(tokenizer_path).read_bytes(), "tokenizer.json")
    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return rows.mapInArrow(_encode(vocabulary, lexicon), "doc_id long, n_tokens long, ids binary, decoded string")


def op10_word_lexicon(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
