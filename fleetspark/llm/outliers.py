"""Operator 4: quality rules and robust multivariate outliers.

``text_statistics`` computes word, symbol, line and repetition counts of each
whole text and a vector of transformed rates.  ``fit`` estimates centre and scatter
of the vectors per language and source by the minimum covariance determinant
(MCD): deterministic starts from medians and MADs (plain, and with the
correlations of tanh scores), then concentration steps that keep the ``support``
share of rows with the smallest Mahalanobis distances, at last the start with the
smaller determinant, a consistency factor from the median distance, and one
reweighting.  ``judge`` rejects rows whose squared robust distance exceeds the
chi-square quantile of ``tail``.

Every step is one aggregation over all rows: moments are summed by (group,
distance bucket), so the rows of a concentration step are those of the buckets up
to the quantile, and a hot group costs no more than its rows.  Buckets are
logarithmic (1/32 of a power of two), which makes the kept share exact to a bucket.
The spread is each group's own where it is above ``FLOOR`` (standard deviations);
below it, the floor stands in, as for a rate that is zero in most rows. The README
says which shares of digits, capitals, symbols and duplicate lines still pass.

Defined results: a null text has no words, so it fails the base rule; null
languages and sources are groups of their own; a group with fewer than
``min_group`` rows past the base rule is judged by a pooled estimate, that of its
language over all sources, else (fewer than ``min_group`` there too) of its source
over all languages, else of all rows, however few; so every row past the base rule
has a distance, and so have base-failed rows of a group that holds one; repeated
rows count each; extra columns pass through ``judge``; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.common import written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_other"]
#: transformed rates: log mean word length, then square roots of shares
VECTOR = ["x_word_len", "x_symbols", "x_dup_lines", "x_repeat", "x_upper", "x_other"]
FLOOR = [0.05, 0.15, 0.10, 0.10, 0.08, 0.08]
P = len(VECTOR)
GRID = 64  # medians are taken on a grid of 1/64
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PLAIN = bytes(c for c in range(256) if c >= 128 or 97 <= c <= 122 or 65 <= c <= 90 or c in b" \t\n\r\x0b\x0c")


def count_text(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    raw = (text or "").encode()
    words = raw.split()  # ASCII white space only, as bytes
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    points = len(text or "") - spaces
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = raw.split(b"\n")
    with_word = [ln for ln in lines if ln and not ln.isspace()]
    repeat = 0
    if n >= 6:
        ids: dict[bytes, int] = {}
        seq = [ids.setdefault(w, len(ids)) for w in words]
        windows = list(zip(seq, seq[1:], seq[2:], seq[3:], seq[4:], strict=False))
        if len(set(windows)) < len(windows):
            found = Counter(windows)
            covered = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(np.fromiter((found[w] > 1 for w in windows), dtype=bool, count=len(windows)))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + 5, -1)
            repeat = int((np.cumsum(covered) > 0).sum())
    upper = len(raw) - len(raw.translate(None, _UPPER))
    other = len(raw.translate(None, _PLAIN))
    return n, points, symbols, len(with_word) - len(set(with_word)), repeat, len(with_word), upper, other


def _count_batches(batches):
    for batch in batches:
        rows = np.asarray([count_text(t.as_py()) for t in batch.column("text")], dtype=np.int64).reshape(-1, len(COUNTS))
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], *[pa.array(rows[:, i]) for i in range(len(COUNTS))]],
            names=[*[batch.schema.names[i] for i in keep], *COUNTS])


def text_statistics(docs: DataFrame, min_words: int = 10, max_repeat_pct: int = 20,
                    carry: list[str] | None = None) -> DataFrame:
    """doc_id, the group key, the counts, ``base_failed`` and the vector of each row of ``docs``.

    ``carry`` names columns (``text`` may be one) that come along as ``carry_<name>``.
    """
    carry = carry or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.to_json(F.struct("lang", "source")).alias("gkey"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    counted = rows.mapInArrow(_count_batches, ", ".join(
        ["doc_id long", "gkey string", *[f"`carry_{c}` {kinds[f'carry_{c}']}" for c in carry],
         *[f"{c} long" for c in COUNTS]]))
    c = F.col
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return (counted.withColumn("base_failed", (c("n_words") < min_words)
                               | (100 * c("n_repeat_words") > max_repeat_pct * c("n_words")))
            .withColumn("x_word_len", F.log(F.greatest(c("word_chars"), F.lit(1)) / F.greatest(c("n_words"), F.lit(1))))
            .withColumn("x_symbols", share("n_symbols", "n_words")).withColumn("x_dup_lines", share("n_dup_lines", "n_lines"))
            .withColumn("x_repeat", share("n_repeat_words", "n_words")).withColumn("x_upper", share("n_upper", "word_chars"))
            .withColumn("x_other", share("n_other", "word_chars")))


def chi2_quantile(p: int, tail: float) -> float:
    """Wilson-Hilferty approximation of the chi-square quantile with upper tail ``tail``."""
    t = math.sqrt(-2 * math.log(min(tail, 1 - tail)))  # normal quantile by a rational approximation
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
    z = z if tail < 0.5 else -z
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _median(hist: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Lower median of ``at`` (an integer) under counts ``n``, by ``keys``."""
    w = Window.partitionBy(*keys)
    ranked = hist.withColumn("upto", F.sum("n").over(w.orderBy(at))).withColumn("all", F.sum("n").over(w))
    return ranked.where("2 * upto >= all").groupBy(*keys).agg(F.min(at).alias(name))


def _centres(vectors: DataFrame) -> DataFrame:
    """gkey -> medians and scales (arrays in the order of VECTOR), from histograms on a grid."""
    long = vectors.select("gkey", F.posexplode(F.array(*VECTOR)).alias("dim", "x"))
    hist = written(long.groupBy("gkey", "dim", F.round(F.col("x") * GRID).cast("long").alias("at"))
                   .agg(F.count("*").alias("n")), "grid")
    med = _median(hist, ["gkey", "dim"], "at", "med")
    away = (hist.join(med, ["gkey", "dim"]).withColumn("away", F.abs(F.col("at") - F.col("med")))
            .groupBy("gkey", "dim", "med", "away").agg(F.sum("n").alias("n")))
    mad = _median(away, ["gkey", "dim", "med"], "away", "mad")
    listed = F.array_sort(F.collect_list(F.struct("dim", "med", "mad")))
    floor = F.array(*[F.lit(x) for x in FLOOR])
    return written(mad.groupBy("gkey").agg(listed.alias("d")).select(
        "gkey", F.transform("d", lambda d: d["med"] / GRID).alias("med"),
        F.zip_with(F.transform("d", lambda d: d["mad"] * (1.4826 / GRID)), floor,
                   lambda a, b: F.greatest(a, b)).alias("scale")), "centres")


_PARAMS = "gkey string, start int, centre array<double>, inverse array<double>, log_det double"


def _pairs():
    return [(i, j) for i in range(P) for j in range(i, P)]


def _regular(scatter: np.ndarray) -> np.ndarray:
    """No spread under its floor, no correlation of quite 1."""
    spread = np.maximum(np.diag(scatter), np.square(FLOOR))
    regular = 0.98 * scatter
    np.fill_diagonal(regular, spread)
    return regular


def _inverted(frames):
    """Rows with ``n``, sums and cross sums, or centre and scatter, to params."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            m = np.asarray(r.sums, dtype=float) / r.n
            s = np.zeros((P, P))
            for (i, j), v in zip(_pairs(), r.cross, strict=True):
                s[i, j] = s[j, i] = v / r.n - m[i] * m[j]
            s = _regular(s) * r.factor
            _, log_det = np.linalg.slogdet(s)
            inv = np.linalg.inv(s)
            out.append((r.gkey, r.start, m.tolist(), [inv[i, j] * (1 if i == j else 2) for i, j in _pairs()], log_det))
        yield pd.DataFrame(out, columns=["gkey", "start", "centre", "inverse", "log_det"])


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector under the joined centre and inverse."""
    diff = [F.col(v) - F.col("centre")[i] for i, v in enumerate(VECTOR)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_pairs()):
        total = total + F.col("inverse")[k] * diff[i] * diff[j]
    return F.greatest(total, F.lit(0.0))


_BUCKET = 32  # distance buckets per power of two


def _bucketed(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """Counts and moments of the rows by (group, start, distance bucket)."""
    with_d = (vectors.join(params, "gkey").withColumn("bucket", F.floor(F.log2(1 + _distance()) * _BUCKET)))
    return with_d.groupBy("gkey", "start", "bucket").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)],
        *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"c{i}_{j}") for i, j in _pairs()])


def _summed(part: DataFrame, factor: Column) -> DataFrame:
    """Sums over a group's chosen buckets."""
    return (part.groupBy("gkey", "start").agg(
        F.sum("n").alias("n"), F.max(factor).alias("factor"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(P)],
        *[F.sum(f"c{i}_{j}").alias(f"c{i}_{j}") for i, j in _pairs()])
        .select("gkey", "start", "n", "factor", F.array(*[f"s{i}" for i in range(P)]).alias("sums"),
                F.array(*[f"c{i}_{j}" for i, j in _pairs()]).alias("cross")))


def _ranked(buckets: DataFrame) -> DataFrame:
    w = Window.partitionBy("gkey", "start")
    return (buckets.withColumn("below", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("below", F.coalesce("below", F.lit(0))).withColumn("all", F.sum("n").over(w)))


def _pools(vectors: DataFrame, min_group: int) -> DataFrame:
    """gkey -> lkey, skey (its language, its source) and ``judged_by``, the first of gkey, lkey, skey with
    ``min_group`` rows, else ``all``."""
    sized = written(vectors.groupBy("gkey").agg(F.count("*").alias("n")), "groups")
    of = F.from_json("gkey", "lang string, source string")
    sized = sized.select("gkey", "n", F.concat(F.lit("lang "), F.to_json(F.struct(of["lang"].alias("lang")))).alias("lkey"),
                         F.concat(F.lit("source "), F.to_json(F.struct(of["source"].alias("source")))).alias("skey"))
    for key, n in (("lkey", "n_lang"), ("skey", "n_source")):
        sized = sized.join(sized.groupBy(key).agg(F.sum("n").alias(n)), key)
    judged_by = (F.when(F.col("n") >= min_group, F.col("gkey")).when(F.col("n_lang") >= min_group, F.col("lkey"))
                 .when(F.col("n_source") >= min_group, F.col("skey")).otherwise("all"))
    return written(sized.select("gkey", "lkey", "skey", judged_by.alias("judged_by")), "pools")


def fit(vectors: DataFrame, support: float = 0.75, steps: int = 5, min_group: int = 30) -> DataFrame:
    """gkey -> centre, inverse scatter (upper triangle) of the rows' vectors, or of the pool that judges the group."""
    pools = _pools(vectors, min_group)
    estimates = pools.select("gkey", F.explode(F.array("gkey", "lkey", "skey", F.lit("all"))).alias("judged_by")).join(
        pools.select("judged_by").distinct(), "judged_by", "left_semi")
    # from here on gkey names an estimate: a row counts in its group's and in each pool that judges some group
    vectors = vectors.join(written(estimates, "estimates"), "gkey").drop("gkey").withColumnRenamed("judged_by", "gkey")
    centres = _centres(vectors)
    z = [F.tanh((F.col(v) - F.col("med")[i]) / F.col("scale")[i]) for i, v in enumerate(VECTOR)]
    scored = vectors.join(centres, "gkey").groupBy("gkey", "med", "scale").agg(
        F.count("*").alias("n"), F.array(*[F.sum(x) for x in z]).alias("sums"),
        F.array(*[F.sum(z[i] * z[j]) for i, j in _pairs()]).alias("cross"))

    def starts(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                m, scale = np.asarray(r.sums) / r.n, np.asarray(r.scale)
                s = np.zeros((P, P))
                for (i, j), v in zip(_pairs(), r.cross, strict=True):
                    s[i, j] = s[j, i] = v / r.n - m[i] * m[j]
                sd = np.sqrt(np.maximum(np.diag(s), 1e-12))
                corr = np.where(np.outer(sd, sd) > 1e-9, s / np.outer(sd, sd), 0.0)
                np.fill_diagonal(corr, 1.0)
                for k, c in enumerate((np.eye(P), 0.98 * corr + 0.02 * np.eye(P))):
                    scatter = c * np.outer(scale, scale)
                    inv = np.linalg.inv(scatter)
                    out.append((r.gkey, k, list(r.med), [inv[i, j] * (1 if i == j else 2) for i, j in _pairs()],
                                np.linalg.slogdet(scatter)[1]))
            yield pd.DataFrame(out, columns=["gkey", "start", "centre", "inverse", "log_det"])

    params = written(scored.mapInPandas(starts, _PARAMS), "start")
    for _ in range(steps):
        ranked = _ranked(_bucketed(vectors, params))
        kept = ranked.where(F.col("below") < F.ceil(F.col("all") * support))
        params = written(_summed(kept, F.lit(1.0)).mapInPandas(_inverted, _PARAMS), "step")
    best = params.withColumn("r", F.row_number().over(Window.partitionBy("gkey").orderBy("log_det", "start")))
    params = written(best.where("r = 1").drop("r"), "best")
    # consistency: the median squared distance should be the chi-square median; then one reweighting
    ranked = _ranked(_bucketed(vectors, params))
    middle = F.pow(F.lit(2.0), (F.col("bucket") + 0.5) / _BUCKET) - 1
    w = Window.partitionBy("gkey", "start")
    factor = F.greatest(F.max(F.when(2 * F.col("below") < F.col("all"), middle)).over(w)
                        / chi2_quantile(P, 0.5), F.lit(0.25))
    ranked = ranked.withColumn("factor", factor)
    kept = ranked.where((middle <= F.col("factor") * chi2_quantile(P, 0.025)) | (F.col("below") == 0))
    model = written(_summed(kept, F.greatest(F.lit(1.0), F.least(F.col("factor"), F.lit(4.0))))
                    .mapInPandas(_inverted, _PARAMS).drop("start", "log_det"), "mcd")
    return written(pools.select("gkey", "judged_by").join(model.withColumnRenamed("gkey", "judged_by"), "judged_by")
                   .drop("judged_by"), "models")


def judge(statistics: DataFrame, tail: float = 0.025, **params) -> DataFrame:
    """Adds ``distance`` (squared, robust; null where no row of the group is past the base rule) and ``kept``."""
    model = fit(statistics.where("NOT base_failed").select("gkey", *VECTOR), **params)
    distance = F.when(F.col("centre").isNotNull(), _distance())  # greatest() in it passes over nulls
    scored = statistics.join(model, "gkey", "left").withColumn("distance", distance).drop("centre", "inverse")
    out = F.coalesce(F.col("distance") > chi2_quantile(P, tail), F.lit(False))
    return scored.withColumn("kept", ~F.col("base_failed") & ~out)


def quality(docs: DataFrame, carry: list[str] | None = None, **params) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text, lang, source)."""
    return judge(written(text_statistics(docs, carry=carry), "statistics"), **params)


def kept_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules and the outlier test keep, with their columns."""
    names = docs.columns
    judged = quality(docs, carry=names, **params).where("kept")
    return judged.select(*[F.col(f"carry_{c}").alias(c) for c in names])
