"""Operator 2: language identification by prediction by partial matching (PPM).

Per language a variable-order tree of byte contexts (order 0 to ``order``) holds
how often each byte followed each context.  Escape probabilities follow method C:
a context seen ``N`` times before ``D`` different bytes gives a byte seen ``n``
times there n/(N+D), and D/(N+D) escapes to the next shorter context, whose
probabilities are renormalised over the bytes not yet excluded; the end of the
chain is uniform over the 256 bytes.  So each context's probabilities add up to
one and a text's code length (in bits) is exact under the frozen counts.  The
language with the shortest code wins.

The trees of all languages share their nodes.  Because the counts are frozen, the
code length of every (context, byte, language) is tabulated once, as integers of
1/1024 bit, and scoring is a few array look-ups a byte (numpy inside Spark tasks;
sums of integers, so batches and retries agree exactly).

Fitting reads a bounded sample: about ``train_docs`` documents a language, those
with the smallest hash of their id, which bounds the trees' size; contexts seen
fewer than ``min_context`` times in every language are left to their shorter context.  Scoring reads
every text whole.

Texts are lower-cased, and runs of ASCII characters other than letters count as
one blank.  Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language that sorts first; with no labelled row at all every text
is ``und``; languages are the non-null labels; a null ``doc_id`` counts as held
out (it is scored, never learned from); repeated rows and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1024  # code lengths are integers of 1/1024 bit
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each led by a blank, and where each text begins."""
    parts = [b" " + t.encode().translate(_FOLD) if t else b" " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    space = data == 32
    drop = np.zeros(len(data), dtype=bool)
    drop[1:] = space[1:] & space[:-1]
    drop[starts[:-1]] = False
    kept_before = np.concatenate([[0], np.cumsum(~drop)])
    return data[~drop], kept_before[starts]


def _blocks(column: pa.Array, max_chars: int = 1 << 20):
    first, texts, size = 0, [], 0
    for i, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= max_chars:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def _positions(starts: np.ndarray, total: int, order: int) -> np.ndarray:
    """For each byte, how many bytes of its text stand before it, at most ``order``."""
    at = np.full(total, order, dtype=np.int64)
    for k in range(order):
        i = starts[:-1] + k
        i = i[i < starts[1:]]
        at[i] = k
    return at


def gram_counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, depth, gram, n): how often each byte string of ``depth`` + 1 bytes ends a context.

    ``depth`` is ``order`` but for the first bytes of a text, which have less context.
    """
    def count(batches):
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            out: list[tuple[str, int, np.ndarray, np.ndarray]] = []
            for first, texts in _blocks(batch.column("text")):
                labels = langs[first:first + len(texts)]
                for lang in sorted(set(labels)):
                    data, starts = _folded([t for t, x in zip(texts, labels, strict=True) if x == lang])
                    depth = _positions(starts, len(data), order)
                    gram = data.astype(np.int64)
                    for k in range(1, order + 1):
                        before = np.zeros(len(data), dtype=np.int64)
                        before[k:] = data[:-k]
                        gram = np.where(depth >= k, gram + (before << (8 * k)), gram)
                    for d in range(order + 1):
                        g, n = np.unique(gram[depth == d], return_counts=True)
                        if len(g):
                            out.append((lang, d, g, n))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for lang, _, g, _ in out for x in [lang] * len(g)]),
                     pa.array(np.concatenate([np.full(len(g), d, dtype=np.int32) for _, d, g, _ in out])),
                     pa.array(np.concatenate([g for _, _, g, _ in out])),
                     pa.array(np.concatenate([n for _, _, _, n in out]).astype(np.int64))],
                    names=["lang", "depth", "gram", "n"])

    return (sample.select("lang", F.lower("text").alias("text"))
            .mapInArrow(count, "lang string, depth int, gram long, n long")
            .groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    """Frozen code lengths: ``children[k][node, symbol]`` leads to a context one byte longer, 0 if none."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for bytes never seen
    children: list[np.ndarray]
    cost: np.ndarray  # [node * symbols + symbol, language] in 1/BITS bit
    n_symbols: int

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each text under each language, in 1/BITS bit."""
        data, starts = _folded(texts)
        sym = self.symbol[data]
        depth = _positions(starts, len(data), len(self.children))
        node = np.zeros(len(data), dtype=np.int32)
        live = np.ones(len(data), dtype=bool)
        for k, child in enumerate(self.children, 1):
            before = np.zeros(len(data), dtype=sym.dtype)
            before[k:] = sym[:-k]
            longer = child[node, before]
            live &= (depth >= k) & (longer > 0)
            node = np.where(live, longer, node)
        bits = self.cost[node.astype(np.int64) * self.n_symbols + sym].astype(np.int64)
        sums = np.add.reduceat(bits, starts[:-1], axis=0)
        return sums


def build(langs: list[str], rows: dict[str, np.ndarray], order: int, min_context: int) -> Model:
    """The model from the columns of ``gram_counts`` (``lang`` as index into ``langs``).

    A context is a node if some language saw it ``min_context`` times or more.
    """
    byte = rows["gram"] & 255
    seen = np.unique(byte)
    symbol = np.zeros(256, dtype=np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    A, L = len(seen) + 1, len(langs)

    # counts[k]: (context of k bytes, symbol, language) -> n, for all bytes with that much context
    def level(k: int):
        has = rows["depth"] >= k
        context = (rows["gram"][has] >> 8) & ((1 << (8 * k)) - 1)
        return context, symbol[byte[has]], rows["lang"][has], rows["n"][has]

    cost_p = []
    context, sym, lang, n = level(0)
    base = np.zeros((1, A, L))
    np.add.at(base, (np.zeros(len(sym), dtype=int), sym, lang), n)
    uniform = np.full((1, A, L), 1 / 256)

    def mixed(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probabilities of one order from its counts and those of the next shorter context."""
        total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        taken = np.where(counts > 0, parent, 0).sum(axis=1, keepdims=True)
        left = np.maximum(1 - taken, 1e-12)
        down = kinds / np.maximum(total + kinds, 1) * parent / left
        return np.where(total > 0, np.where(counts > 0, counts / np.maximum(total + kinds, 1), down), parent)

    # symbol 0 stands for each of the bytes never seen; its mass counts 256 - (A - 1) times elsewhere
    probs = mixed(base, uniform)
    cost_p.append(probs[0][None])
    nodes = {0: 0}  # context value -> node, of the previous order
    children: list[np.ndarray] = []
    all_probs = [probs]
    total_nodes = 1
    for k in range(1, order + 1):
        context, sym, lang, n = level(k)
        values, inverse = np.unique(context, return_inverse=True)
        weight = np.zeros((len(values), L), dtype=np.int64)
        np.add.at(weight, (inverse, lang), n)
        parent_value = values & ((1 << (8 * (k - 1))) - 1)
        often = weight.max(axis=1, initial=0) >= min_context  # in one language, however many others there are
        keep = often & np.asarray([v in nodes for v in parent_value.tolist()], dtype=bool)
        index = np.full(len(values), -1)
        index[keep] = np.arange(keep.sum())
        counts = np.zeros((int(keep.sum()), A, L))
        rows_kept = index[inverse] >= 0
        np.add.at(counts, (index[inverse][rows_kept], sym[rows_kept], lang[rows_kept]), n[rows_kept])
        kept_values = values[keep]
        parents = np.asarray([nodes[v] for v in parent_value[keep].tolist()], dtype=np.int64)
        flat = np.concatenate(all_probs)
        child = np.zeros((total_nodes, A), dtype=np.int32)
        ids = np.arange(total_nodes, total_nodes + len(kept_values))
        child[parents, symbol[(kept_values >> (8 * (k - 1))) & 255]] = ids
        children.append(child)
        all_probs.append(mixed(counts, flat[parents]) if len(ids) else counts)
        nodes = dict(zip(kept_values.tolist(), ids.tolist(), strict=True))
        total_nodes += len(ids)
    for k, child in enumerate(children):  # every level is looked up with any node's number
        children[k] = np.vstack([child, np.zeros((total_nodes - len(child), A), dtype=np.int32)])
    cost = np.rint(-np.log2(np.concatenate(all_probs)) * BITS).astype(np.uint32)  # a byte may cost far over 64 bits
    return Model(langs, symbol, children, cost.reshape(total_nodes * A, L), A)


def fit(docs: DataFrame, learn: Column, order: int = 3, train_docs: int = 1500, min_context: int = 16) -> Model | None:
    """Fit on the rows where ``learn`` holds and ``lang`` is not null; None if there are none.

    ``train_docs`` bounds the sample: a document is used if its id's hash falls
    below the share that makes about so many documents of its language.  That sample is
    the only bound on the tree: no number of contexts is cut off.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1 << 30))
    bound = F.lit(0)
    for lang in langs:
        bound = F.when(F.col("lang") == lang, int(min(1, train_docs / counts[lang]) * (1 << 30))).otherwise(bound)
    grams = gram_counts(labelled.where(place < bound), order).toPandas()
    if not len(grams):
        return None
    index = {x: i for i, x in enumerate(langs)}
    rows = {"gram": grams["gram"].to_numpy(), "depth": grams["depth"].to_numpy(), "n": grams["n"].to_numpy(),
            "lang": grams["lang"].map(index).to_numpy()}
    return build(langs, rows, order, min_context)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (not used by the prediction), ``lang_pred`` and ``score`` of every text."""
    names = [f"__keep_{i}" for i in range(len(keep))]
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
                       F.lower("text").alias("__text"), has_letter.alias("__letter"))
    if model is None:
        out = rows.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        kept_fields = [f for f in rows.schema.fields if f.name in names]
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept_fields]
                           + ["lang_pred string", "score double"])

        def score(batches):
            m = shared.value
            labels = np.asarray([*m.langs, "und"], dtype=object)
            for batch in batches:
                best_of, score_of = [], []
                for _, texts in _blocks(batch.column("__text")):
                    bits = m.code_lengths(texts)
                    best = bits.argmin(axis=1)
                    lead = np.exp2(-np.minimum((bits - bits.min(axis=1, keepdims=True)) / BITS, 1000.0))
                    best_of.append(best)
                    score_of.append(1 / lead.sum(axis=1))
                letter = batch.column("__letter").to_numpy(zero_copy_only=False)
                best = np.where(letter, np.concatenate(best_of) if best_of else [], len(m.langs)).astype(int)
                points = np.where(letter, np.concatenate(score_of) if score_of else [], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], pa.array(labels[best].tolist(), type=pa.string()),
                     pa.array(points)], names=[*names, "lang_pred", "score"])

        out = rows.mapInArrow(score, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")


def identify(docs: DataFrame, held_out: Column, **params) -> DataFrame:
    """Learn from the rows outside ``held_out`` and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs, ~held_out, **params)
    return predict(docs.withColumn("__held_out", held_out), model, ["doc_id", "__held_out"]).withColumnRenamed(
        "__held_out", "held_out")
