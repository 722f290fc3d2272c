import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgrain.operators import chunking


def fold(text):
    """Sections by a loop over lines."""
    stack, buffer, out = [], [], []

    def flush():
        if buffer:
            out.append((" > ".join(stack) or "General", "\n".join(buffer)))
            buffer.clear()

    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            flush()
            level = len(line) - len(line.lstrip("#"))
            if title := line[level:].strip():
                del stack[level - 1 :]
                stack.append(title)
        elif line:
            buffer.append(line)
    flush()
    return out or ([("General", text.strip())] if text.strip() else [])


LINE = st.sampled_from(["# A", "## B", "### C", "#### D", "#tag", "##", " # E ", "text", "more text", "", "  x  "])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(LINE, max_size=9).map("\n".join), min_size=1, max_size=20))
def test_sections_match_a_loop(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunking.section_blocks(F.col("text")).alias("b")).collect()
    assert {r.i: [tuple(b) for b in r.b] for r in rows} == {i: fold(t) for i, t in enumerate(texts)}


def test_windows(spark):
    for n, size, overlap in ((0, 5, 2), (1, 5, 2), (5, 5, 2), (6, 5, 2), (120, 50, 10), (350, 350, 80), (351, 350, 80), (9, 3, 0)):
        words = [f"w{i}" for i in range(n)]
        want, start = [], 0
        while start < n:
            want.append(" ".join(words[start : start + size]))
            if start + size >= n:
                break
            start += size - overlap
        row = spark.createDataFrame([(words,)], "w array<string>").select(chunking.windows(F.col("w"), size, overlap).alias("x")).first()
        assert row.x == want
    with pytest.raises(ValueError):
        chunking.windows(F.col("w"), 0, 0)
    with pytest.raises(ValueError):
        chunking.windows(F.col("w"), 5, 5)


def test_chunks(spark):
    docs = [("d", "t", "# HR\n## Leave\n" + " ".join(f"a{i}" for i in range(7)) + "\n## Overtime\nx y", "HR", "2024-01-01", "public"), ("e", "t", None, "HR", "x", "public"), ("f", "t", " ", "HR", "x", "public")]
    table = spark.createDataFrame(docs, "doc_id string, title string, text string, department string, updated_at string, access_level string")
    got = sorted(chunking.build_chunks(table, 5, 2).collect(), key=lambda r: r.chunk_id)
    want = [("HR > Leave", "a0 a1 a2 a3 a4"), ("HR > Leave", "a3 a4 a5 a6"), ("HR > Overtime", "x y")]
    assert [(r.section_path, r.text) for r in got] == want
    assert [r.chunk_id for r in got] == [f"d-{i}-{hashlib.md5(f'd:{i}:{t}'.encode()).hexdigest()[:8]}" for i, (_, t) in enumerate(want)]
    assert chunking.chunks_from_rows(table.toDF(*"abcdef"), 5, 2).count() == 3


def test_many_headings_are_folded_once(spark):
    """Paths of 4,000 headings of five levels, as a stack gives them, in seconds."""
    lines, stack, want = [], [], []
    for i in range(4000):
        level = (1, 2, 3, 2, 4, 4, 3, 1, 5, 2)[i % 10]
        lines += [f"{'#' * level} h{i}", f"text {i}"]
        stack = [*stack[: level - 1], f"h{i}"]
        want.append((" > ".join(stack), f"text {i}"))
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    began = time.time()
    got = docs.select(F.explode(chunking.section_blocks(F.col("text"))).alias("b")).select("b.*").collect()
    assert [(r.section_path, r.text) for r in got] == want
    assert time.time() - began < 10
