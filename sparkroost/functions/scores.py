"""Per-row scorers as native column expressions: (score, extracted) columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as T

_NUMERIC = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def score_if(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)


def number(c: Column) -> Column:
    """A double where the text is one by Python's rules (without underscores); else null."""
    return F.when(c.rlike(_NUMERIC), T.strip(c).try_cast("double"))


def index_letter(c: Column) -> Column:
    """Truth as a letter: A-Z, a-z, or an index 0..25 (truncated toward zero); else null."""
    t = T.strip(c)
    k = number(t).cast("int")
    return F.when(t.rlike("^[A-Za-z]$"), F.upper(t)).when((k >= 0) & (k <= 25), F.char(k + 65))


def mcq_exact(text: Column, truth: Column) -> Column:
    return score_if(T.answer(text) == T.strip(truth))


def mcq_accuracy_of(answer: Column, truth: Column) -> Column:
    return score_if(answer == index_letter(truth))


def mcq_accuracy(text: Column, truth: Column) -> Column:
    """An invalid truth scores 0 and still counts."""
    return mcq_accuracy_of(T.answer(text), truth)


def exact_match_of(answer: Column, truth: Column) -> Column:
    return score_if(T.normalize_exact(answer) == T.normalize_exact(truth))


def exact_match(text: Column, truth: Column) -> Column:
    return exact_match_of(T.answer(text), truth)


def chess_normal(c: Column) -> Column:
    t = T.strip(F.lower(c))
    k = number(t).cast("int")
    return F.when(t.rlike("^[a-z]$"), F.upper(t)).when(t.rlike("^[0-9]+$") & (k >= 0) & (k <= 25), F.char(k + 65)).otherwise(F.regexp_replace(t, "[^a-z0-9]", ""))


def chess_accuracy(text: Column, truth: Column) -> Column:
    return score_if(chess_normal(T.chess_move(text)) == chess_normal(truth))


def superglue_label(c: Column, truth: Column) -> Column:
    """An answer's label in the form of its truth: numbers for 0 or 1, words for Yes or No (``X`` is
    Yes, ``Y`` is No); texts that are no key, and other truths, leave it as it is."""
    key = F.upper(c)
    yes, no = key.isin("A", "X", "1", "TRUE"), key.isin("B", "Y", "0", "FALSE")
    as_number = F.when(key.isin("A", "0", "FALSE"), "0.0").when(key.isin("B", "1", "TRUE"), "1.0")
    as_word = F.when(yes, "Yes").when(no, "No")
    return F.coalesce(F.when(truth.isin("0.0", "1.0", "0", "1"), as_number).when(truth.isin("Yes", "No", "yes", "no", "YES", "NO"), as_word), c)


def superglue_exact_of(answer: Column, truth: Column) -> Column:
    return score_if(superglue_label(answer, truth) == truth)


def superglue_exact(text: Column, truth: Column) -> Column:
    return superglue_exact_of(T.answer(text), truth)


def cloze(text: Column, truth: Column) -> Column:
    """As :func:`mcq_accuracy`, but an answer outside a box is the text's first character; a truth
    that is no index is compared as text."""
    return score_if(T.answer(text, "SuperGLUE-ClozeTest") == F.coalesce(index_letter(truth), T.strip(truth)))


def parse_digits(c: Column) -> Column:
    """A number without its thousands commas; a percent sign divides by 100; else null."""
    t = F.replace(T.strip(c), F.lit(","), F.lit(""))
    part = F.regexp_replace(t, r"\\?%$", "")
    return F.when(t.endswith("%"), number(part) / 100).otherwise(number(t))


def numeric_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-4 * F.greatest(F.abs(a), F.abs(b))


def math_equal(answer: Column, truth: Column) -> Column:
    """The native steps: equal texts, a choice letter (only against a capital A-E), numbers with the
    percent variants (which end the comparison either way), equal without brackets, and equal part
    by part in tuples."""
    return T.let(F.struct(answer.alias("a"), truth.alias("b")), lambda s: _steps(s["a"], s["b"], True))


def _steps(a: Column, b: Column, parts: bool) -> Column:
    held = F.struct(T.strip(a).alias("a"), T.strip(b).alias("b"), parse_digits(a).alias("x"), parse_digits(b).alias("y"), b.alias("raw"))
    return T.let(held, lambda s: _math_equal(s, parts))


def _choice(c: Column) -> Column:
    """The last choice letter of a text; a text without one is itself, without dots and slashes at its end."""
    return F.coalesce(T.last_match(F.upper(c), r"\b(A|B|C|D|E)\b"), F.regexp_replace(T.strip(c), "[./]+$", ""))


def _math_equal(s: Column, parts: bool) -> Column:
    a, b, x, y = s["a"], s["b"], s["x"], s["y"]
    round_or_square = lambda c, p, q: c.startswith(p) & c.endswith(q)
    outer = (round_or_square(a, "[", "]") & ~b.startswith("(")) | (round_or_square(a, "(", ")") & ~b.startswith("["))
    bare = lambda c: F.lower(F.regexp_replace(F.when(outer, F.regexp_replace(c, r"^[\[\]()]+|[\[\]()]+$", "")).otherwise(c), r"[{}()]", ""))
    near = numeric_equal(x, y / 100) | numeric_equal(x, y) | numeric_equal(x, y * 100)
    other = bare(a) == bare(b)
    if parts:
        own = lambda c: F.split(c.substr(F.lit(2), F.length(c) - 2), ",")
        tuples = a.rlike(r"^[(\[].+[)\]]") & b.rlike(r"^[(\[].+[)\]]") & (F.size(own(a)) == F.size(own(b)))
        other = other | F.when(tuples, F.forall(F.zip_with(own(a), own(b), lambda p, q: _steps(p, q, False)), lambda ok: ok)).otherwise(False)
    letter = s["raw"].isin(*"ABCDE") & (_choice(a) == s["raw"])
    return F.coalesce((F.lower(a) == F.lower(b)) | letter | F.when(x.isNotNull() & y.isNotNull(), near).otherwise(other), F.lit(False))


def math_metric(text: Column, truth: Column) -> Column:
    return score_if(math_equal(T.strip(F.substring_index(T.math_answer(text), "=", -1)), truth))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays; only words that both have are counted."""
    held = F.struct(F.filter(a, lambda x: F.array_contains(b, x)).alias("a"), F.filter(b, lambda x: F.array_contains(a, x)).alias("b"))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return T.let(held, lambda s: F.aggregate(F.array_distinct(s["b"]), F.lit(0), lambda n, x: n + F.least(count(s["a"], x), count(s["b"], x))))


def token_f1(a: Column, b: Column) -> Column:
    same = overlap(a, b).cast("double")
    return F.when(same > 0, 2 * same / (F.size(a) + F.size(b))).otherwise(0.0)


def qa_f1(text: Column, truth: Column) -> Column:
    cut = lambda c: F.filter(F.split(T.normalize_english(c), " "), lambda x: x != "")
    return token_f1(cut(text), cut(truth))


def _shared_words(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(f1, meteor) of each row of two arrays of word lists."""
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b)]
    words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode(null_encoding="encode")
    codes, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    own = [np.repeat(np.arange(len(a)), size) for size in sizes]
    keys = [row * n + code for row, code in zip(own, np.split(codes, [len(own[0])]), strict=True)]  # a word of a row
    (x, times), (y, others) = (np.unique(k, return_counts=True) for k in keys)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    same = np.bincount(both // n, np.minimum(times[i], others[j]), len(a))
    distinct = np.bincount(both // n, minlength=len(a))

    def runs(row: np.ndarray, key: np.ndarray) -> np.ndarray:
        inside = np.isin(key, both)
        goes_on = np.append(False, inside[:-1] & (row[1:] == row[:-1]))[: len(inside)]
        return np.bincount(row[inside & ~goes_on], minlength=len(a))

    chunks = np.minimum(*(runs(*x) for x in zip(own, keys, strict=True)))
    f1 = np.where(same > 0, 2.0 * same / np.maximum(sizes[0] + sizes[1], 1), 0.0)
    return f1, f1 * (1 - np.where(chunks == distinct, 0.0, 0.5 * (chunks / np.maximum(distinct, 1)) ** 2))


#: Rows whose words are counted at once.
_ROWS = 512


def overlap_by_count(rows, key: str, a: str, b: str):
    """For each row of ``rows`` (a table with ``key`` and word arrays ``a`` and ``b``): key, f1 and meteor. Words are counted
    within the row, so the work grows with the number of words, not with the product of the two arrays'
    lengths, and no word is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, _shared_words(part.column(1), part.column(2)))], [key, "f1", "meteor"])

    own = rows.select(key, a, b)
    return own.mapInArrow(run, StructType([own.schema[key], StructField("f1", DoubleType()), StructField("meteor", DoubleType())]))


def meteor_of(answer: Column, truth: Column) -> Column:
    return T.let(F.struct(T.tokens(answer).alias("a"), T.tokens(truth).alias("b")), lambda s: meteor_words(s["a"], s["b"]))


def meteor(text: Column, truth: Column) -> Column:
    return meteor_of(T.answer(text), truth)


def meteor_words(a: Column, b: Column) -> Column:
    """Plain F1 of the multisets times one less the fragmentation penalty; can be negative."""
    distinct = F.size(F.array_intersect(a, b))
    runs = lambda arr, other: F.aggregate(
        arr,
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")),
        lambda s, x: F.struct((s["n"] + F.when(F.array_contains(other, x) & ~s["inside"], 1).otherwise(0)).alias("n"), F.array_contains(other, x).alias("inside")),
    )["n"]
    chunks = F.least(runs(a, b), runs(b, a))
    penalty = F.when(chunks == distinct, 0.0).otherwise(0.5 * F.pow(chunks / distinct, F.lit(2.0)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (distinct == 0), 0.0).otherwise(token_f1(a, b) * (1 - penalty))


def count_score(text: Column, truth: Column) -> Column:
    """Share of the text's numbers that equal the truth."""
    own = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda x: x == truth)) / F.size(own))


def retrieval_score(text: Column, truth: Column, mark: str = "Paragraph ") -> Column:
    want = F.regexp_extract(truth, mark + r"(\d+)", 1)
    return count_score(text, want)


def class_score(text: Column, truth: Column, classes: Column) -> Column:
    """1 / number of named classes if the truth is among them. Names within the truth that are not the
    truth do not count, but of such names in a row every second one does."""
    named = F.filter(classes, lambda c: F.contains(text, c))
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("gone"))

    def step(s: Column, c: Column) -> Column:
        gone = ~s["gone"] & F.contains(truth, c) & (c != truth)
        return F.struct((s["n"] + F.when(gone, 0).otherwise(1)).alias("n"), gone.alias("gone"))

    return F.when(F.array_contains(named, truth), 1.0 / F.aggregate(named, state, step)["n"]).otherwise(0.0)


#: Bits of a row that one long holds, so that a sum of two and a carry can't overflow.
_WORD = 62
_ONES = (1 << _WORD) - 1


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays.

    One row of the table of lengths is a row of bits, a 0 where the length rises; a value of the longer array
    changes all of them by one addition (Hyyrö): V becomes (V + (V and M)) or (V and not M), M marking
    the value's places in the shorter array. Rows of over 62 bits are arrays of longs, added with carry."""
    return F.coalesce(T.let(F.struct(a.alias("a"), b.alias("b")), lambda x: _common(x["a"], x["b"])), F.lit(0))


def _common(a: Column, b: Column) -> Column:
    """:func:`common` of columns that are at hand, so that naming them costs nothing."""
    held = F.struct(F.when(F.size(a) < F.size(b), a).otherwise(b).alias("s"), F.when(F.size(a) < F.size(b), b).otherwise(a).alias("l"))
    placed = T.let(held, lambda x: F.struct(F.size(x["s"]).alias("n"), _marks(x["s"]).alias("marks"), _places(x["s"], x["l"]).alias("at")))
    return T.let(placed, lambda x: F.when(x["n"] == 0, 0).when(x["n"] <= _WORD, _one_word(x)).otherwise(_many_words(x)))


def _marks(s: Column) -> Column:
    """For each different value, the words of its places."""
    bits = lambda part, y: F.aggregate(F.transform(part, lambda z, i: F.when(z == y, _bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda n, z: n + z)
    words = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _WORD).cast("int"))
    return F.when(F.size(s) > 0, F.transform(F.array_distinct(s), lambda y: F.transform(words, lambda w: bits(F.slice(s, w * _WORD + 1, _WORD), y))))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _places(s: Column, l: Column) -> Column:
    """The number of each value of ``l`` that ``s`` has, among its different values."""
    return T.let(F.array_distinct(s), lambda d: F.filter(F.transform(l, lambda x: F.array_position(d, x)), lambda i: i > 0))


def _after(v: Column, m: Column, carry: Column) -> tuple[Column, Column]:
    """(the word after an addition, its carry)."""
    total = v + v.bitwiseAND(m) + carry
    return total.bitwiseAND(F.lit(_ONES)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))), F.shiftright(total, _WORD)


def _one_word(x: Column) -> Column:
    full = _bit(x["n"]) - 1
    row = F.aggregate(x["at"], full, lambda v, i: _after(v, F.get(F.get(x["marks"], i.cast("int") - 1), F.lit(0)), F.lit(0).cast("long"))[0])
    return x["n"] - F.bit_count(row.bitwiseAND(full))


def _many_words(x: Column) -> Column:
    words = F.sequence(F.lit(0), F.floor((x["n"] - 1) / _WORD).cast("int"))
    full = F.transform(words, lambda w: _bit(F.least(F.lit(_WORD), x["n"] - w * _WORD)) - 1)

    def step(row: Column, i: Column) -> Column:
        def word(s: Column, w: Column) -> Column:
            return T.let(F.struct(F.get(row, w).alias("v"), F.get(F.get(x["marks"], i.cast("int") - 1), w).alias("m")), lambda y: F.struct(_after(y["v"], y["m"], s["carry"])[1].alias("carry"), F.concat(s["row"], F.array(_after(y["v"], y["m"], s["carry"])[0])).alias("row")))

        start = F.struct(F.lit(0).cast("long").alias("carry"), F.expr("cast(array() as array<bigint>)").alias("row"))
        return F.aggregate(words, start, word)["row"]

    last = F.aggregate(x["at"], full, step)
    ones = F.aggregate(F.zip_with(last, full, lambda v, f: F.bit_count(v.bitwiseAND(f))), F.lit(0), lambda n, k: n + k)
    return x["n"] - ones


def rouge_l(a: Column, b: Column) -> Column:
    """F measure of the longest common subsequence of two word arrays."""
    return T.let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), 2.0 * _common(x["a"], x["b"]) / (F.size(x["a"]) + F.size(x["b"]))).otherwise(0.0))


def code_similarity(text: Column, truth: Column) -> Column:
    """Similarity of an answer's first line without a comment or mark to the truth, in hundredths: twice
    the longest common subsequence of characters by the sum of the lengths. Two empty texts are equal."""
    lines = F.filter(F.split(F.regexp_replace(text, r"^\n+", ""), "\n"), lambda x: ~F.contains(x, F.lit("`")) & ~F.contains(x, F.lit("#")) & ~F.contains(x, F.lit("//")))
    line = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.when((line == "") & (truth == ""), 1.0).otherwise(F.bround(rouge_l(letters(line), letters(truth)), 2))
