"""Sections and overlapping windows of documents, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

#: What documents may bring in place of markdown: an array as section_blocks() gives it.
SECTIONS = "sections"
CHUNK_COLUMNS = ("doc_id", "chunk_id", "text", "title", "section_path", "department", "updated_at", "access_level")


def section_blocks(text: Column) -> Column:
    """Array of structs (section_path, text) of a markdown text.

    A line that begins with # is a heading, its depth the number of #; it closes the block before it. A heading of
    depth n keeps the first n - 1 headings above it, however deep those were; one without a title closes a block
    and changes nothing else. A text of headings alone is one block, General.
    """

    def of(body: Column) -> Column:
        raw = F.regexp_extract_all(body, F.lit(r"(?md)^#[^\n]*"), F.lit(0))
        heads = F.transform(raw, lambda h: F.struct(F.length(F.regexp_extract(h, "^#+", 0)).alias("lv"), T.trim_space(F.regexp_replace(h, "^#+", "")).alias("t")))
        parts = F.split(body, r"(?md)^#[^\n]*\n?", -1)
        strings = F.array().cast("array<string>")

        def paths(hs: Column) -> Column:
            """The path after no heading, after the first one, and so on: one fold of the open headings."""

            def step(acc: Column, x: Column) -> Column:
                stack = F.when(x["t"] == "", acc["open"]).otherwise(F.concat(F.slice(acc["open"], F.lit(1), F.least(F.size(acc["open"]), x["lv"] - 1)), F.array(x["t"])))
                return T.let(stack, lambda s: F.struct(s.alias("open"), F.concat(acc["paths"], F.array(F.when(F.size(s) == 0, "General").otherwise(F.array_join(s, " > ")))).alias("paths")))

            return F.aggregate(hs, F.struct(strings.alias("open"), F.array(F.lit("General")).alias("paths")), step)["paths"]

        def build(of_part: Column) -> Column:
            found = F.transform(parts, lambda p, k: F.struct(F.get(of_part, k).alias("section_path"), T.trim_space(p).alias("text")))
            return F.filter(found, lambda x: x["text"] != "")

        return T.let(paths(heads), build)

    # lines without outer white space, and none that are blank
    gap, any_space = f"[ {fixed.GAPS}]", f"[ {fixed.GAPS}{fixed.BREAKS}]"
    stripped = F.regexp_replace(text, f"[{fixed.BREAKS}]{any_space}*+|(?={gap})(?<!{gap}){gap}++[{fixed.BREAKS}]{any_space}*+", "\n")
    body = T.trim_space(F.when(T.tidy(text), text).otherwise(stripped))
    whole = T.trim_space(text)
    alone = F.array(F.struct(F.lit("General").alias("section_path"), whole.alias("text")))
    return T.let(T.let(body, of), lambda b: F.when((F.size(b) == 0) & (whole != ""), alone).otherwise(b))


def windows(words: Column, size: int, overlap: int) -> Column:
    """Array of texts: windows of ``size`` words, each sharing ``overlap`` with the one before, the last reaching the end."""
    if size <= 0:
        raise ValueError("chunk_size must be > 0")
    if overlap >= size:
        raise ValueError("overlap must be smaller than chunk_size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step)) * step
    starts = F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(step).cast("int"))
    cut = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))
    return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws(":", doc_id, index.cast("string"), text).cast("binary"))
    return F.concat_ws("-", doc_id, index.cast("string"), F.substring(digest, 1, 8))


def build_chunks(docs: DataFrame, size: int = 350, overlap: int = 80) -> DataFrame:
    """Chunks of documents (doc_id, title, text, department, updated_at, access_level); the texts are normalized.

    Numbers run over the document. Null and blank texts give no chunks. Documents with a column SECTIONS are cut by that, and their texts aren't read.
    """
    blocks = F.col(SECTIONS) if SECTIONS in docs.columns else section_blocks(F.coalesce(F.col("text"), F.lit("")))
    texts = F.flatten(F.transform(blocks, lambda b: T.let(T.words_of(b["text"]), lambda w: F.transform(windows(w, size, overlap), lambda x: F.struct(b["section_path"].alias("section_path"), x.alias("text"))))))
    rows = docs.select("doc_id", "title", "department", "updated_at", "access_level", F.posexplode(texts).alias("index", "chunk"))
    rows = rows.select("*", F.col("chunk.section_path").alias("section_path"), F.col("chunk.text").alias("text"))
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("index"), F.col("text"))).select(*CHUNK_COLUMNS)


def chunks_from_rows(rows: DataFrame, size: int = 350, overlap: int = 80) -> DataFrame:
    """build_chunks() of rows whose first six columns are in that order, whatever their names."""
    return build_chunks(rows.toDF("doc_id", "title", "text", "department", "updated_at", "access_level", *rows.columns[6:]), size, overlap)
