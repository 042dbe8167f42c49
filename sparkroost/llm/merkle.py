"""Merkle manifest of a data set: a radix-ranked trie, built and proved with DataFrame functions alone.

1. A leaf is the digest of a row's fields. Rows alike in source, id and leaf become one row with a count.
2. **Ranks without a global sort.** The digits of doc_id (base ``RADIX``, most significant first) make a
   hierarchy of histograms for each source: counts by all digits but the last, summed digit by digit towards
   the top. Going down again, a prefix's first rank is its parent's plus the counts of its smaller siblings; no
   window holds over ``RADIX`` rows. The last digit's rows are numbered within their prefix. A prefix with more than
   ``CELL_ROWS`` different rows (one id, or null, in very many rows) is cut on by digits of the leaves.
3. **Trie.** A node's key is its source and a prefix of its rank in base ``FANOUT``. ``LEVELS`` digits go in one
   step: the at most ``FANOUT ** LEVELS`` nodes with one prefix meet in one row, whose levels are
   folded there, the longest prefixes first. A hot source is as many such rows as it needs.
4. The subroots, numbered in order of source, are the leaves of the same trie once more; it gives the root.
5. Proofs go down the same steps: a row of nodes gets its parent's proof, and puts its own levels before it.

Defined results: a null doc_id comes before all others; rows alike in source and id are ordered by their leaf;
rows alike in all fields are neighbours, each with its own proof; null texts and ids are never tampered with; an
empty table gives an empty table. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 3, 5
RADIX_BITS = 8
RADIX = 1 << RADIX_BITS
#: Different rows of one prefix that are numbered together.
CELL_ROWS = 1 << 16


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The leaf of a row: each value as its length in bytes, a colon and itself, or ``-`` if it is null."""
    said = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return digest(*said)


def _ids(docs: DataFrame, id_col: str, tampered: Column | None) -> DataFrame:
    """(g, id, leaf, other, copies): different rows. ``g`` orders as the source does, null first, and is
    never null; ``other`` is the leaf after tampering, null if it is as before."""
    fields = [docs[c] for c in FIELDS]
    own = leaf(*fields)
    other = F.lit(None).cast("string") if tampered is None else leaf(*fields[:-1], tampered)
    g = F.coalesce(F.concat(F.lit("+"), docs["source"].cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), docs[id_col].cast("long").alias("id"), own.alias("leaf"), other.alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other")))
    return rows.groupBy("g", "id", "leaf").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("copies"))


def _first_ranks(counts: DataFrame, digits: list[str], base: DataFrame | None = None, known: int = 0) -> DataFrame:
    """``counts`` (g, digits, n) with the rank ``first`` of each row's first leaf. ``base`` has it for the
    first ``known`` digits already."""
    levels = [counts]
    for k in range(len(digits) - 1, known, -1):
        levels.append(levels[-1].groupBy("g", *digits[:k]).agg(F.sum("n").alias("n")))
    for k, level in zip(range(known + 1, len(digits) + 1), reversed(levels), strict=True):
        up = ["g", *digits[: k - 1]]
        before = Window.partitionBy(*up).orderBy(digits[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("n").over(before), F.lit(0))
        if base is None:
            base = level.withColumn("first", inside)
        else:
            base = level.withColumn("inside", inside).join(base.select(*up, "first"), up).withColumn("first", F.col("first") + F.col("inside")).drop("inside")
    return base


def ranked(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (a stored table of g, id, leaf, other, copies) with ``rank``: how many leaves of the
    source come before the row's first."""
    flipped = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order is the ids' order
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    bits = 0 if lo is None else (lo ^ hi).bit_length() if lo ^ hi >= 0 else 64
    shifts = range(-(-bits // RADIX_BITS) * RADIX_BITS - RADIX_BITS, 0, -RADIX_BITS)
    digits = ["z", *(f"d{s}" for s in shifts)]
    digit = lambda s: F.coalesce(F.shiftrightunsigned(flipped, s).bitwiseAND(F.lit(RADIX - 1)), F.lit(0)).cast("int")
    rows = rows.withColumns({"z": F.col("id").isNotNull().cast("int")} | {f"d{s}": digit(s) for s in shifts})
    counts = _shared.keep(rows.groupBy("g", *digits).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("different")), "digits")
    first = _first_ranks(counts.drop("different"), digits).drop("n")

    def numbered(part: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
        before = Window.partitionBy("g", *keys).orderBy("id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
        at = part.withColumn("inside", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        return at.join(base, ["g", *keys]).select("g", "id", "leaf", "other", "copies", (F.col("first") + F.col("inside")).alias("rank"))

    crowded = counts.where(F.col("different") > cell_rows).select("g", *digits)
    if crowded.isEmpty():
        return numbered(rows, first, digits)
    cut = lambda at: F.conv(F.substring("leaf", at, 2), 16, 10).cast("int")  # noqa: E731  two hex digits are one of base 256
    finer = [*digits, "last", "e1", "e2", "e3"]
    of = rows.join(crowded, ["g", *digits], "left_semi").withColumns({"last": digit(0), "e1": cut(1), "e2": cut(3), "e3": cut(5)})
    inner = _first_ranks(of.groupBy("g", *finer).agg(F.sum("copies").alias("n")), finer, first, len(digits)).drop("n")
    return numbered(rows.join(crowded, ["g", *digits], "left_anti"), first, digits).unionByName(numbered(of, inner, finer))


def _depth(n: str) -> Column:
    """Levels above ``n`` leaves: how many powers of the fan-out are below ``n``."""
    powers = ", ".join(f"{FANOUT**j}L" for j in range(39))
    return F.expr(f"size(filter(array({powers}), p -> p < {n}))")


def _up(nodes: Column) -> Column:
    """The next level: the digest of every ``FANOUT`` neighbours."""
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * FANOUT + 1, FANOUT)).cast("binary"), 256))


def _folded(cells: DataFrame, step: int) -> DataFrame:
    """``cells`` (g, depth, at, held: nodes in order) with the levels ``l0`` to ``lk`` above the nodes;
    ``todo`` of them are the source's own in this step, the others repeat the last."""
    out = cells.withColumn("todo", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("depth") - step * LEVELS)))
    out = out.withColumn("l0", F.transform("held", lambda x: x["node"]))
    for k in range(LEVELS):
        out = out.withColumn(f"l{k + 1}", F.when(F.lit(k) < F.col("todo"), _up(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return out


def _path(i: Column) -> Column:
    """The proof of the node at place ``i`` of its cell: for each level what stands before it in its
    run, and what stands after it."""
    steps = []
    for k in range(LEVELS):
        place = F.floor(i / FANOUT**k).cast("int")
        run = F.slice(F.col(f"l{k}"), F.floor(place / FANOUT).cast("int") * FANOUT + 1, FANOUT)
        before, after = F.slice(run, F.lit(1), place % FANOUT), F.slice(run, place % FANOUT + 2, FANOUT)
        steps.append(F.when(F.lit(k) < F.col("todo"), F.struct(F.concat_ws("", before).alias("before"), F.concat_ws("", after).alias("after"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


class Trie:
    """The tries of all groups ``g`` over ``nodes`` (g, depth, rank, node, and what ``carried`` names)."""

    def __init__(self, nodes: DataFrame, carried: list[str], deepest: int):
        self.cells = []
        for step in range(max(1, -(-deepest // LEVELS))):
            held = F.array_sort(F.collect_list(F.struct("rank", "node", *(carried if not step else []))))
            at = F.floor(F.col("rank") / FANOUT**LEVELS).cast("long")
            cells = nodes.withColumn("at", at).groupBy("g", "depth", "at").agg(held.alias("held"))
            self.cells.append(_shared.keep(cells, f"cells{step}"))
            top = F.element_at(F.col(f"l{LEVELS}"), 1)
            nodes = _folded(self.cells[-1], step).select("g", "depth", F.col("at").alias("rank"), top.alias("node"))
        self.roots = nodes.select("g", F.col("node").alias("root"))

    def proved(self, above: DataFrame, kept: list[str], of: list[tuple[str, object]]) -> DataFrame:
        """A row for each node at the bottom: the columns ``kept`` of ``above`` (g, path, ...), and ``of``: named
        functions of (carried struct, whole path), worked out before rows are cut from their cell."""
        for step in range(len(self.cells) - 1, -1, -1):
            keys = ["g"] if step == len(self.cells) - 1 else ["g", "at"]
            cells = _folded(self.cells[step], step).join(above, keys)
            whole = lambda i: F.concat(_path(i), F.col("path"))
            if step:
                rows = F.transform("held", lambda x, i: F.struct(x["rank"].alias("at"), whole(i).alias("path")))
            else:
                # a one-element transform names the path once, so that it is worked out once
                rows = F.transform("held", lambda x, i: F.transform(F.array(whole(i)), lambda p: F.struct(*(f(x, p).alias(name) for name, f in of)))[0])
            above = cells.select("g", *kept, F.inline(rows))
        return above


def _in_order(subroots: DataFrame) -> DataFrame:
    """Subroots (g, root) with their ``rank`` in order of ``g``: ranges are numbered within themselves and stored, then
    the counts of the ranges before are added."""
    n = int(subroots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = subroots.repartitionByRange(n, "g").sortWithinPartitions("g")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = _shared.keep(ranges.select("g", "root", F.spark_partition_id().alias("range"), inside.alias("inside")), "subroots")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition
    base = held.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.join(base, "range").select("g", "root", (F.col("base") + F.col("inside")).alias("rank"))


def manifest(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(source, doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified) for each row. ``path``: the
    proof, (before, after) for each level from the leaf up. ``tampered`` is the text whose
    leaf is checked in place of the row's own; the path is always that of the true rows."""
    rows = _shared.keep(_ids(docs, id_col, tampered), "leaves")
    sizes = rows.groupBy("g").agg(F.sum("copies").alias("n"))
    sizes = _shared.keep(sizes.select("g", _depth("n").alias("depth")), "sizes")
    deepest, sources = sizes.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count(F.lit(1))).first()
    placed = ranked(rows, cell_rows)
    one = F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1)).alias("rank")
    leaves = placed.select("g", "id", F.col("leaf").alias("node"), "other", one).join(_shared.small(sizes), "g")
    trie = Trie(leaves, ["id", "other"], deepest)
    subroots = _shared.keep(_in_order(trie.roots), "ranked")
    all_of = F.lit(0).alias("g")
    top = Trie(subroots.select(all_of, F.lit(_levels(sources)).alias("depth"), "rank", F.col("root").alias("node"), F.col("g").alias("name")), ["name"], _levels(sources))
    found = top.roots.first()
    root = F.lit(found["root"] if found else None).cast("string")
    start = subroots.sparkSession.createDataFrame([(0, [])], "g int, path array<struct<before:string,after:string>>")
    paths = top.proved(start, [], [("name", lambda x, p: x["name"]), ("subroot", lambda x, p: x["node"]), ("path", lambda x, p: p)])
    above = paths.select(F.col("name").alias("g"), "subroot", "path")
    said = lambda p: F.concat_ws("", F.transform(p, lambda s: F.concat(s["before"], s["after"])))
    out = trie.proved(above, ["subroot"], [
        ("doc_id", lambda x, p: x["id"]),
        ("leaf", lambda x, p: x["node"]),
        ("path", lambda x, p: p),
        ("proof_sha256", lambda x, p: F.sha2(said(p).cast("binary"), 256)),
        ("folded_root", lambda x, p: _fold(F.coalesce(x["other"], x["node"]), p)),
    ])
    source = F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("source")
    return out.select(source, "doc_id", "leaf", "subroot", root.alias("root"), "path", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _levels(n: int) -> int:
    k = 0
    while FANOUT**k < n:
        k += 1
    return k


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    tampered = F.when(chosen, F.translate(docs["text"], "\n", "")).otherwise(docs["text"])
    return manifest(docs, tampered).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The levels are folded by recursion; crc32 is worked out bit by bit.
OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), [3988292384::BIGINT for k in range(8)]), lambda x, p: CASE WHEN x & 1 = 1 THEN xor(x >> 1, p) ELSE x >> 1 END)) AS state
  FROM documents),
said AS (
  SELECT r, doc_id, source, CASE WHEN xor(state, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text
  FROM docs),
leaves AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS other FROM said),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT 0 AS lvl, source, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lvl, source, i // 3, n),
subroots AS (
  SELECT source, h, lvl AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 3, n),
runs AS (
  SELECT p.r, s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i // (3 ** s.lvl)::BIGINT), '') AS a, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i // (3 ** s.lvl)::BIGINT), '') AS b
  FROM placed p JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.n > 1 AND s.i // 3 = p.i // (3 ** (s.lvl + 1))::BIGINT GROUP BY p.r, s.lvl
  UNION ALL
  SELECT p.r, u.depth + s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < u.i // (3 ** s.lvl)::BIGINT), ''), coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > u.i // (3 ** s.lvl)::BIGINT), '')
  FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source JOIN tops s ON s.n > 1 AND s.i // 3 = u.i // (3 ** (s.lvl + 1))::BIGINT GROUP BY p.r, u.depth + s.lvl),
folds AS (
  SELECT r, 0 AS lvl, other AS h FROM placed
  UNION ALL
  SELECT f.r, f.lvl + 1, sha256(x.a || f.h || x.b) FROM folds f JOIN runs x ON x.r = f.r AND x.lvl = f.lvl),
proofs AS (SELECT r, count(*) AS k, string_agg(a || b, '' ORDER BY lvl) AS said FROM runs GROUP BY r)
SELECT p.doc_id, p.leaf, u.h AS subroot, t.h AS root, sha256(coalesce(q.said, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source JOIN tops t ON t.n = 1
LEFT JOIN proofs q ON q.r = p.r JOIN folds f ON f.r = p.r AND f.lvl = coalesce(q.k, 0)
"""
