"""Operator 13: source divergence audit over the group-term count matrix as k²-trees.

Rows of a language's matrix are its sources, columns its kept terms (in at least ``min_docs``
of its documents), cells the counts.  A count is priced p = 1 + floor(S(c + 2) / (N + 2V)) with
S = ``SCALE``, N the row's kept occurrences and V the number of kept terms, and two prices differ by
f(p, q) = floor((p - q)² / (p + q)).  All of it is integer arithmetic.

``pair``: every two sources of a language, f summed over all kept terms.  A term that neither
source holds costs f(z, z'), z the price of a zero; so V * f(z, z') prices the whole matrix as
one all-zero quadrant, and only cells that one of the two holds correct it, by f(p, q) - f(z, z').
Terms are dealt by hash into tiles of about ``tile_cells`` cells, rows into blocks of ``block_rows``.  Each
task has one tile and two row blocks: it sorts the tile's terms by how many rows hold them, cuts them
into squares of ``block_rows`` columns and stores each square as a k²-tree (one bit per quadrant, children
found by rank).  It then walks the trees of both blocks together, one level after another for all squares
and row pairs at once: a pair of quadrants over the same columns goes on if one of them is not empty, an empty one
standing for its rows' zero prices; all-zero pairs are dropped, since they are priced already.  Corrections
are summed per row pair in the task and then over tiles.

``term``: the ``top`` kept terms of a source whose price is above the language's, by f.

Counting reads every text once in blocks, and sums by (language, source, term) before and after the shuffle, so
a hot source or term adds one row per task.  No task holds more than a tile of two row blocks, whatever the
vocabulary and however the rows fall to sources.

Defined results: null text, language and source count as ''; a language without kept terms gives pairs of
value 0 and no terms; ties are ordered by the item's UTF-8 bytes; repeated rows are documents of their own; null or
repeated ids are of no account (``doc_id`` is not read); extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import written
from fleetspark.llm.token_files import text_blocks

SCALE = 1_000_000_000
BLOCK = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OF_TERM = np.zeros(256, dtype=bool)
_OF_TERM[97:123] = _OF_TERM[128:] = True


# Counting -----------------------------------------------------------------------------------------

def terms_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of the texts (no nulls) in a row, and the text each stands in."""
    ended = pc.binary_join_element_wise(texts, "", " ")  # so no term goes on in the next text
    offsets = np.frombuffer(ended.buffers()[1], dtype=np.int32)[ended.offset:ended.offset + len(ended) + 1]
    data = _LOWER[np.frombuffer(ended.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]]
    inside = _OF_TERM[data]
    turns = np.flatnonzero(np.diff(inside, prepend=False)).astype(np.int32)  # begin and end of each term
    begins, ends = turns[::2], turns[1::2]
    cuts = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begins), pa.py_buffer(cuts), pa.py_buffer(data[inside]))
    return terms, np.searchsorted(offsets - offsets[0], begins, side="right") - 1


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their values, and how often they stand there."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1))
    if not len(first):
        return keys, values, values
    return sorted_keys[first], np.add.reduceat(values[order], first), np.diff(first, append=len(keys))


def _count(batches):
    for batch in batches:
        lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        n_sources = max(len(source.dictionary), 1)
        groups, group_of = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(),
                                     return_inverse=True)
        out = []
        for first, texts in text_blocks(batch.column("text"), BLOCK):
            terms, doc = terms_of(texts)
            coded = terms.dictionary_encode()
            size = max(len(coded.dictionary), 1)
            in_doc, n, _ = _sums(doc.astype(np.int64) * size + coded.indices.to_numpy(),
                                 np.ones(len(terms), dtype=np.int64))
            key, n, docs = _sums(group_of[first + in_doc // size] * size + in_doc % size, n)
            out.append((key // size, coded.dictionary.take(pa.array(key % size)), n, docs))
        # every group of the batch has a row, also where no text has a term
        out.append((np.arange(len(groups)), pa.array([""] * len(groups)), *[np.zeros(len(groups), dtype=np.int64)] * 2))
        for group, term, n, docs in out:
            pair = groups[group]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(pair // n_sources)), source.dictionary.take(pa.array(pair % n_sources)),
                 term, pa.array(n), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it; term '' (n = 0) for each group."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# Prices -------------------------------------------------------------------------------------------

def price(count: Column, total: Column, kept_terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept_terms)); null without kept terms."""
    # decimals: SCALE * count passes 64 bits
    scaled = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", scaled, F.nullif(total + 2 * kept_terms, F.lit(0).cast("long")).cast("decimal(19,0)"))
    return whole + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Matrix:
    """The kept cells and the rows of every language's matrix, written once."""

    def __init__(self, docs: DataFrame, min_docs: int):
        per_term = Window.partitionBy("lang", "term")
        counts = written(term_counts(docs), "term-counts")
        numbered = (counts.where("term <> ''")
                    .withColumn("docs_in_lang", F.sum("docs").over(per_term))
                    .withColumn("n_in_lang", F.sum("n").over(per_term))
                    .withColumn("place", F.row_number().over(per_term.orderBy("source")))
                    .where(F.col("docs_in_lang") >= min_docs))
        kept = written(numbered.select("lang", "source", "term", "n", "n_in_lang", "place"), "kept-terms")
        sizes = kept.groupBy("lang", "source").agg(
            F.sum("n").alias("total"), F.sum((F.col("place") == 1).cast("long")).alias("first_here"),
            F.count("*").alias("cells"))
        groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left")
        of_lang = Window.partitionBy("lang")

        def held(name):
            return F.coalesce(F.col(name), F.lit(0).cast("long"))

        rows = (groups.withColumn("total", held("total"))
                .withColumn("kept_terms", F.sum(held("first_here")).over(of_lang))
                .withColumn("lang_total", F.sum("total").over(of_lang))
                .withColumn("lang_cells", F.sum(held("cells")).over(of_lang))
                .withColumn("n_rows", F.count("*").over(of_lang))
                .withColumn("row", F.row_number().over(of_lang.orderBy("source")) - 1))
        zero = price(F.lit(0).cast("long"), F.col("total"), F.col("kept_terms"))
        self.rows = written(rows.withColumn("zero", zero).drop("first_here", "cells"), "group-rows")
        facts = self.rows.select("lang", "source", "row", "total", "kept_terms", "lang_total", "lang_cells", "n_rows")
        self.cells = kept.join(facts, ["lang", "source"]).withColumn(
            "p", price(F.col("n"), F.col("total"), F.col("kept_terms")))


# Pairs --------------------------------------------------------------------------------------------

class Tree:
    """k²-trees of side ``k ** levels`` over squares of a sparse matrix; ``values`` are the cells in the trees' order."""

    def __init__(self, square: np.ndarray, row: np.ndarray, col: np.ndarray, values: np.ndarray, k: int, levels: int):
        self.bits: list[np.ndarray] = []  # per level [node * k * k + quadrant]: whether the quadrant holds a cell
        self.rank: list[np.ndarray] = []  # how many quadrants before it do: its node in the next level
        self.k2 = k * k
        self.roots, parent = np.unique(square, return_inverse=True)
        for level in range(levels):
            part = k ** (levels - 1 - level)
            quadrant = row // part % k * k + col // part % k
            slots = (int(parent.max()) + 1 if len(parent) else 0) * k * k
            bits = np.zeros(slots, dtype=bool)
            place = parent * k * k + quadrant
            bits[place] = True
            rank = np.cumsum(bits) - bits
            self.bits.append(bits)
            self.rank.append(rank)
            parent = rank[place]
        self.values = np.zeros(len(values), dtype=np.int64)
        self.values[parent] = values


def _children(tree: Tree, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
    """Nodes of the next level, -1 for empty quadrants (and those of empty nodes)."""
    if not len(tree.bits[level]):
        return np.full(len(node), -1)
    place = np.maximum(node, 0) * tree.k2 + quadrant
    return np.where((node >= 0) & tree.bits[level][place], tree.rank[level][place], -1)


def corrections(a: Tree, b: Tree, zeros_a: np.ndarray, zeros_b: np.ndarray, same: bool, k: int, levels: int,
                limit: int = 1 << 20) -> np.ndarray:
    """[row of a, row of b]: the sum of f(p, q) - f(z, z') over columns where either row holds a cell.

    Rows are those of ``zeros_a`` and ``zeros_b``; with ``same`` (one block with itself) only pairs
    a < b are walked.  At most ``limit`` quadrant pairs go down a level at once.
    """
    sums = np.zeros((len(zeros_a), len(zeros_b)), dtype=np.int64)
    squares = np.union1d(a.roots, b.roots)

    def roots(tree):
        at = np.searchsorted(tree.roots, squares)
        there = np.zeros(len(squares), dtype=bool)
        inner = at < len(tree.roots)
        there[inner] = tree.roots[at[inner]] == squares[inner]
        return np.where(there, at, -1)

    zero_row = np.zeros(len(squares), dtype=np.int64)
    stack = [(0, roots(a), roots(b), zero_row, zero_row)]
    parts = [(r1, r2, c) for r1 in range(k) for r2 in range(k) for c in range(k)]
    while stack:
        level, na, nb, ra, rb = stack.pop()
        if level == levels:
            za, zb = zeros_a[ra], zeros_b[rb]
            p = np.where(na >= 0, a.values[np.maximum(na, 0)] if len(a.values) else 0, za)
            q = np.where(nb >= 0, b.values[np.maximum(nb, 0)] if len(b.values) else 0, zb)
            np.add.at(sums, (ra, rb), (p - q) ** 2 // (p + q) - (za - zb) ** 2 // (za + zb))
            continue
        if len(na) > limit:
            half = len(na) // 2
            stack += [(level, na[half:], nb[half:], ra[half:], rb[half:]),
                      (level, na[:half], nb[:half], ra[:half], rb[:half])]
            continue
        span = k ** (levels - 1 - level)
        found = []
        for r1, r2, c in parts:
            ca, cb = (_children(t, level, n, np.int64(r * k + c)) for t, n, r in ((a, na, r1), (b, nb, r2)))
            da, db = ra * k + r1, rb * k + r2
            go = ((ca >= 0) | (cb >= 0)) & (da * span < len(zeros_a)) & (db * span < len(zeros_b))
            if same:  # at the last level a row with itself differs by nothing
                go &= da < db if span == 1 else da <= db
            found.append((ca[go], cb[go], da[go], db[go]))
        stack.append((level + 1, *[np.concatenate(x) for x in zip(*found, strict=True)]))
    return sums


def _tile_corrections(k: int, levels: int):
    side = k ** levels

    def of_tile(key, table):
        lang, block_a, block_b = key[0], key[1].as_py(), key[2].as_py()
        row, p = table["row"].to_numpy(), table["p"].to_numpy()
        terms = table["term"].combine_chunks().dictionary_encode()
        is_zero = pc.is_null(table["term"]).to_numpy()
        # columns by falling number of rows, so that empty quadrants come together
        codes = terms.indices.filter(pa.array(~is_zero)).to_numpy().astype(np.int64)
        column = np.empty(len(terms.dictionary), dtype=np.int64)
        column[np.argsort(-np.bincount(codes, minlength=len(column)), kind="stable")] = np.arange(len(column))
        column = column[codes]

        def block(number):
            mine = is_zero & (row // side == number)
            zeros = np.zeros(int(mine.sum()), dtype=np.int64)
            zeros[row[mine] % side] = p[mine]
            held = row[~is_zero] // side == number
            tree = Tree(column[held] // side, row[~is_zero][held] % side, column[held] % side, p[~is_zero][held], k, levels)
            return tree, zeros

        a = block(block_a)
        b = a if block_a == block_b else block(block_b)
        sums = corrections(a[0], b[0], a[1], b[1], block_a == block_b, k, levels)
        i, j = np.nonzero(sums)
        return pa.table({"lang": pa.array([lang.as_py()] * len(i), type=pa.string()), "low": pa.array(i + block_a * side),
                         "high": pa.array(j + block_b * side), "more": pa.array(sums[i, j])})

    return of_tile


def pair_corrections(matrix: Matrix, tile_cells: int, k: int, levels: int) -> DataFrame:
    """(lang, low, high, more): what the cells of two rows (``low`` < ``high``) add to their all-zero price."""
    side = k ** levels
    n_tiles = F.ceil(F.col("lang_cells") / tile_cells).cast("long")
    n_blocks = F.ceil(F.col("n_rows") / side).cast("long")
    own = F.floor(F.col("row") / side).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1),
                        lambda x: F.named_struct(F.lit("a"), F.least(x, own), F.lit("b"), F.greatest(x, own)))
    cells = matrix.cells.select("lang", "row", "term", "p", F.pmod(F.xxhash64("term"), n_tiles).alias("tile"),
                                F.explode(pairs).alias("of"))
    every_tile = matrix.rows.where("kept_terms > 0").select(
        "lang", "row", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), pairs.alias("pairs"),
        F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)).alias("tile"))
    zeros = every_tile.select("lang", "row", "term", "p", "tile", F.explode("pairs").alias("of"))
    work = cells.unionByName(zeros).select("lang", "of.a", "of.b", "tile", "row", "term", "p")
    return (work.groupBy("lang", "a", "b", "tile")
            .applyInArrow(_tile_corrections(k, levels), "lang string, low long, high long, more long")
            .groupBy("lang", "low", "high").agg(F.sum("more").alias("more")))


def pair_values(matrix: Matrix, tile_cells: int = 200_000, k: int = 4, levels: int = 4) -> DataFrame:
    """(lang, source, item, value) for every source and every other source of its language."""
    more = written(pair_corrections(matrix, tile_cells, k, levels), "corrections")
    one = matrix.rows.select("lang", "source", "row", "zero", "kept_terms", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("other")).where("row <> other")
    other = matrix.rows.select("lang", F.col("row").cast("long").alias("other"), F.col("source").alias("item"),
                               F.col("zero").alias("other_zero"))
    both = (one.join(other, ["lang", "other"])
            .withColumns({"low": F.least("row", "other"), "high": F.greatest("row", "other")})
            .join(more, ["lang", "low", "high"], "left"))
    empty = F.col("kept_terms") * difference(F.col("zero"), F.col("other_zero"))
    return both.select("lang", "source", "item", F.coalesce(empty + F.coalesce("more", F.lit(0)), F.lit(0)).alias("value"))


def term_values(matrix: Matrix) -> DataFrame:
    """(lang, source, item, value) for the kept terms a source prices above its language."""
    q = price(F.col("n_in_lang"), F.col("lang_total"), F.col("kept_terms"))
    return matrix.cells.withColumn("q", q).where("p > q").select(
        "lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, **params) -> DataFrame:
    """lang, source, part, item, value and rank of ``docs`` (``text``, ``lang``, ``source``)."""
    matrix = Matrix(docs, min_docs)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(matrix, **params).withColumn("part", F.lit("pair")).withColumn("rank", place)
    terms = (term_values(matrix).withColumn("part", F.lit("term")).withColumn("rank", place)
             .where(F.col("rank") <= top))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
