"""Operator 11: fill-in-middle transformation as a pyarrow.compute pipeline.

A text is a run of units (code points, words with the blanks after them, or lines
with their line feed).  Two cuts drawn from the hash of the document's id divide it
into prefix, middle and suffix, and the pieces are written in the order psm (prefix,
suffix, middle) or spm (suffix, prefix, middle), each behind its marker.  Per block of
texts, all in Arrow arrays:

1. the units are a list array over the texts' own bytes (no unit is copied);
2. the lists are flattened beside their parent indices, and each unit's ordinal is its
   place less its parent's offset;
3. for each role the units whose ordinal lies within the role's bounds are filtered and
   the lists rebuilt from the counts per parent;
4. ``binary_join`` makes each list one piece, and ``binary_join_element_wise`` joins the
   markers and pieces.

``restore`` goes the other way from the output and its form alone.  A marker is found
at its first place: no piece holds one (such texts stay plain) and, since no marker begins
as another or it ends, none comes about where pieces meet (checked in ``Markers``).

The draws depend on ``seed`` and the id only, so reruns and retries agree.

Defined results: a null text counts as empty; an empty text, and one that contains a
marker, stays plain; a null ``doc_id`` is hashed as no digits; repeated rows are each
transformed (rows of one id draw the same numbers); extra columns are ignored unless
named in ``keep``; an empty table gives an empty result.  A text is worked on whole, in
blocks of about ``BLOCK`` bytes or one longer text: about 40 bytes of memory per byte of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.token_files import text_blocks

BLOCK = 1 << 20
UNITS = ("code points", "words", "lines")


@dataclass(frozen=True)
class Markers:
    """The strings before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        three = (self.prefix, self.suffix, self.middle)
        for a in three:
            for b in three:
                if not a or a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"markers {a!r} and {b!r} can run into each other")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def unit_lists(texts: pa.StringArray, unit: str) -> pa.ListArray:
    """The units of each text (no nulls), as slices of the texts' own bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    first, end = int(offsets[0]), int(offsets[-1])
    whole = texts.buffers()[2] if end else pa.py_buffer(b"")
    data = np.frombuffer(whole, dtype=np.uint8)[first:end]
    if unit == "code points":
        begins = (data & 0xC0) != 0x80
    else:
        ends = data == 10 if unit == "lines" else np.isin(data, np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = ends[:-1] if unit == "lines" else ends[:-1] & ~ends[1:]
    starts = offsets[:-1][np.diff(offsets) > 0] - first
    begins[starts] = True
    at = np.flatnonzero(begins).astype(np.int32)
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at + first, end).astype(np.int32)), whole)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, offsets - first).astype(np.int32)), units)


def _pieces(lists: pa.ListArray, bounds: list[np.ndarray]) -> list[pa.Array]:
    """The joined units of each role: those with an ordinal from ``bounds[i]`` to before ``bounds[i + 1]``."""
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    offsets = lists.offsets.to_numpy()
    ordinals = np.arange(len(units), dtype=np.int64) - offsets[parents]
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        chosen = units.filter(pa.array((ordinals >= low[parents]) & (ordinals < high[parents])))
        rebuilt = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)), chosen)
        out.append(pc.binary_join(rebuilt, ""))
    return out


def _transformer(unit: str, markers: Markers, keep: list[str], plain_percent: int, spm_percent: int):
    def one_block(texts: pa.Array, h: list[np.ndarray]) -> list[pa.Array]:
        lists = unit_lists(texts, unit)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [h[0] % (n + 1), h[1] % (n + 1)]
        prefix, middle, suffix = _pieces(lists, [np.zeros_like(n), np.minimum(*cuts), np.maximum(*cuts), n])
        plain = (n == 0) | (h[2] % 100 >= 100 - plain_percent)
        for m in (markers.prefix, markers.suffix, markers.middle):
            plain |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        spm = h[3] % 100 < spm_percent
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), type=pa.string())
        psm_text = pc.binary_join_element_wise(markers.prefix, prefix, markers.suffix, suffix, markers.middle, middle, "")
        spm_text = pc.binary_join_element_wise(markers.suffix, suffix, markers.prefix, prefix, markers.middle, middle, "")
        output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), spm_text, psm_text))
        lengths = [pc.if_else(pa.array(plain), None, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
        return [pa.array(n), form, *lengths, output]

    def transform(batches):
        for batch in batches:
            h = [batch.column(f"__h{i}").to_numpy() for i in range(4)]
            for first, texts in text_blocks(batch.column("__text"), BLOCK):
                here = slice(first, first + len(texts))
                kept = [batch.column(c).slice(first, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *one_block(texts, [x[here] for x in h])],
                                                 names=[*keep, "n", "form", "prefix_chars", "middle_chars", "output"])

    return transform


def transform(docs: DataFrame, keep: list[str] | None = None, unit: str = "code points", seed: int = 1,
              markers: Markers = Markers(), plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Columns ``keep`` (``doc_id``) of ``docs`` (``doc_id``, ``text``) with each text's fill-in-middle form.

    ``n`` (units of the text), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars``
    (code points, null if plain) and ``output``.  ``plain_percent`` of the documents stay plain,
    of the others ``spm_percent`` take spm.
    """
    if unit not in UNITS:
        raise ValueError(f"unit: {unit}")
    keep = ["doc_id"] if keep is None else keep
    names = [f"__keep_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
                       F.coalesce("text", F.lit("")).alias("__text"),
                       *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    kept = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    out = rows.mapInArrow(_transformer(unit, markers, names, plain_percent, spm_percent), ", ".join(
        [*kept, "n long, form string, prefix_chars long, middle_chars long, output string"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n", "form", "prefix_chars",
                      "middle_chars", "output")


def restored_texts(output: pa.Array, form: pa.Array, markers: Markers = Markers()) -> pa.Array:
    """The texts behind outputs and forms (no nulls)."""
    result = output.combine_chunks() if isinstance(output, pa.ChunkedArray) else output
    for name, first, second in (("psm", markers.prefix, markers.suffix), ("spm", markers.suffix, markers.prefix)):
        mine = pc.equal(form, name)
        bodies = pc.utf8_slice_codeunits(result.filter(mine), len(first))
        head, rest = _halves(bodies, second)
        other, middle = _halves(rest, markers.middle)
        prefix, suffix = (head, other) if name == "psm" else (other, head)
        whole = pc.binary_join_element_wise(prefix, middle, suffix, "")
        result = pc.replace_with_mask(result, mine, whole)
    return result


def _halves(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    both = pc.split_pattern(texts, marker, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def restore(transformed: DataFrame, column: str = "restored", markers: Markers = Markers()) -> DataFrame:
    """``transformed`` with the exact texts rebuilt from ``output`` and ``form`` alone."""
    names = transformed.columns

    def rebuild(batches):
        for batch in batches:
            texts, forms = batch.column("output"), batch.column("form")
            for first, block in text_blocks(texts, BLOCK):
                part = batch.slice(first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, restored_texts(block, forms.slice(first, len(block)), markers)], names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema.fields)
    return transformed.mapInArrow(rebuild, f"{fields}, {column} string")
