import contextlib
import io
import random

from pyspark.sql import functions as F

from fleetspark.functions.text import replace_first
from fleetspark.operators import folds, lines
from fleetspark.operators.drift import differing_files, text_drift
from fleetspark.sources import kv
from tests.conftest import rows


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file string, text string")


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def random_texts(spark, pieces, seed):
    rnd = random.Random(seed)
    out = [("empty", ""), ("null", None), ("newline", "\n"), ("two", "\n\n"), (None, "pat\nx.\npat")]
    out += [(f"f{i}", "\n".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 40)))) for i in range(60)]
    out.append(("long", "\n".join(rnd.choice(pieces) for _ in range(50_000))))
    return texts(spark, *out)


def test_edit_after_match_is_the_window_form(spark):
    t = random_texts(spark, ["pat", "a. pat", "b.c.", "", "x.", "é.\t"], 1)
    edit = lambda s: replace_first(s, ".", "!")
    got = folds.edit_after_match(t, "text", ["file"], "pat", edit)
    want = lines.edit_after_match(lines.to_lines(t, "text", ["file"]), ["file"], "pat", edit)
    cols = ("file", "line_no", "line", "edited")
    assert rows(got, *cols) == rows(want, *cols)
    assert "Window" not in plan(got) and "Exchange" not in plan(got)


def test_edit_after_match_by_a_loop(spark):
    text = ["hit", "hit.", "hit.", "a.", "hit", "b.", "c.", "hit"]
    want, taken = [], False
    for no, line in enumerate(text, 1):
        want.append((no, line.replace(".", "!") if taken else line, taken))
        taken = not taken and "hit" in line
    got = folds.edit_after_match(texts(spark, ("f", "\n".join(text))), "text", ["file"], "hit", lambda s: replace_first(s, ".", "!"))
    assert rows(got, "line_no", "line", "edited") == sorted(want, key=repr)


def test_segments(spark):
    t = texts(spark, ("f", "a\nH\nb\nc\nH\nH\nd"), ("none", "x"), ("first", "H"), ("null", None))
    got = rows(folds.segments(t, "text", ["file"], lambda x: x == "H"), "file", "segment", "head", "head_no", "body")
    assert got == sorted([("f", 0, None, 0, ["a"]), ("f", 1, "H", 2, ["b", "c"]), ("f", 2, "H", 5, []), ("f", 3, "H", 6, ["d"]),
                          ("none", 0, None, 0, ["x"]), ("first", 0, None, 0, []), ("first", 1, "H", 1, [])], key=repr)


def test_kv_rows_are_the_window_form(spark):
    t = random_texts(spark, ["[s]", " [t u] ", "k = v", "k='q'", "# c", "", "[", "a=b=c", "; k = 1"], 2)
    got = folds.kv_rows(t, "text")
    want = kv.parse_kv_lines(lines.to_lines(t, "text", ["file"]))
    # the window form puts texts of one key together; here the only such key is null and has one text
    assert rows(got, *want.columns) == rows(want, *want.columns) and got.columns == want.columns
    assert "Window" not in plan(got) and "Exchange" not in plan(got)


def test_block_rows_are_the_window_form(spark):
    t = random_texts(spark, ["if:", " if: ", "  a: 1", "  b: 2 ", "  a: 3", "  c: 4", "a: 5", ""], 3)
    got = folds.block_rows(t, "text", "if", ["a", "b"])
    want = kv.blocks(lines.to_lines(t, "text", ["file"]), "if", keys=["a", "b"])
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert "Window" not in plan(got) and "Exchange" not in plan(got)


def test_drift_splits_only_what_differs(spark):
    a = texts(spark, ("same", "x\ny\ny"), ("order", "x\ny"), ("more", "x\nx"), ("gone", "z"), ("parts", "p\nq"), ("null", None),
              (None, "n"), ("empty", ""), ("hot", "h\n" * 100_000))
    b = texts(spark, ("same", "x\ny\ny\n"), ("order", "y\nx"), ("more", "x"), ("new", "w"), ("parts", "q"), ("parts", "p"),
              (None, "m"), ("hot", "h\n" * 99_998))
    assert rows(differing_files(a, b, "text", ["file"]), "file") == sorted(
        [("more",), ("gone",), ("new",), (None,), ("empty",), ("hot",)], key=repr)
    got = text_drift(a, b, "text", ["file"])
    want = lines.line_drift(lines.to_lines(a, "text", ["file"]), lines.to_lines(b, "text", ["file"]), ["file"])
    assert rows(got, "file", "line", "side") == rows(want, "file", "line", "side")


def test_equal_trees_are_never_split(spark):
    a = spark.range(200).select(F.col("id").cast("string").alias("file"), F.concat_ws("\n", "id", F.lit("x")).alias("text"))
    keys = differing_files(a, a, "text", ["file"])
    assert keys.count() == 0 and text_drift(a, a, "text", ["file"]).count() == 0
    assert "posexplode" not in plan(keys).lower()  # digests come from the row itself
    none = texts(spark)
    assert text_drift(none, none, "text", ["file"]).count() == 0
