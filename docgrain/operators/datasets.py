"""Evaluation items from chunks, and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import fixed
from ..functions import text as T

#: Fixed question templates; {s} is the section, {t} the title.
EASY = "Theo tài liệu '{t}', mục '{s}' quy định gì?"
MULTI = "Hãy tổng hợp yêu cầu chính ở mục '{s}' và '{s2}' trong tài liệu '{t}'."
#: By part of the department's name, the first that fits; two of each, taken in turn.
HARD = {
    "hr": ("Trong bối cảnh nhân sự, mục '{s}' trong tài liệu '{t}' áp dụng như thế nào?", "Nếu nhân viên cần tra cứu '{s}', nội dung cốt lõi cần tuân thủ là gì theo '{t}'?"),
    "engineering": ("Trong vận hành kỹ thuật, tài liệu '{t}' yêu cầu gì ở mục '{s}'?", "Theo chuẩn làm việc của đội kỹ thuật, mục '{s}' trong '{t}' được thực hiện ra sao?"),
    "security": ("Theo kiểm soát bảo mật nội bộ, mục '{s}' trong '{t}' quy định điều gì quan trọng nhất?", "Khi đánh giá tuân thủ an ninh, cần bám theo nội dung nào ở mục '{s}' của '{t}'?"),
    "operations": ("Trong quy trình vận hành, mục '{s}' của '{t}' hướng dẫn như thế nào?", "Để xử lý đúng nghiệp vụ vận hành, cần làm gì theo mục '{s}' trong '{t}'?"),
    "finance": ("Từ góc nhìn tài chính, mục '{s}' trong '{t}' đặt ra yêu cầu gì?", "Theo quy trình tài chính nội bộ, nội dung chính của mục '{s}' trong '{t}' là gì?"),
    "legal": ("Theo yêu cầu pháp lý nội bộ, mục '{s}' trong '{t}' cần tuân thủ điều gì?", "Khi rà soát hồ sơ pháp lý, mục '{s}' của '{t}' quy định ra sao?"),
    "general": ("Nội dung trọng tâm ở mục '{s}' trong tài liệu '{t}' là gì?", "Theo tài liệu '{t}', mục '{s}' hướng dẫn điều gì?"),
}


def _filled(template: str, title: Column, section: Column, second: Column | None = None) -> Column:
    parts: list[Column] = []
    rest = template
    values = {"{t}": title, "{s}": section, "{s2}": second}
    while rest:
        at, name = min(((rest.find(k), k) for k in values if k in rest), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) :]
    return F.concat(*parts)


def easy_question(title: Column, section_path: Column) -> Column:
    return _filled(EASY, title, T.last_section(section_path))


def hard_question(title: Column, section_path: Column, department: Column, index: Column) -> Column:
    """index: 0-based; alternates the department's two templates."""
    low, section = F.lower(F.coalesce(F.nullif(department, F.lit("")), F.lit("general"))), T.last_section(section_path)

    def pair(name: str) -> Column:
        first, second = (_filled(t, title, section) for t in HARD[name])
        return F.when(F.pmod(index, F.lit(2)) == 0, first).otherwise(second)

    out = F
    for name in HARD:
        if name != "general":
            out = out.when(F.contains(low, F.lit(name)), pair(name))
    return out.otherwise(pair("general"))


def item_columns(question: Column, gold: Column, reference: Column, difficulty: str, kind: str, domain: Column) -> list[Column]:
    return [question.alias("question"), gold.alias("gold"), reference.alias("reference_answer"), F.lit(difficulty).alias("difficulty"), F.lit(kind).alias("query_type"), domain.alias("domain")]


def easy_items(chunks: DataFrame) -> DataFrame:
    """One item a chunk, with ``place``, the chunk's id."""
    return chunks.select(F.col("chunk_id").alias("place"), *item_columns(easy_question(F.col("title"), F.col("section_path")), F.array("chunk_id"), T.first_sentence(F.col("text")), "easy", "positive_single", T.domain_from_department(F.col("department"))))


def hard_items(chunks: DataFrame, limit: int) -> DataFrame:
    """Of the first ``limit`` chunks by id."""
    first = chunks.orderBy("chunk_id").limit(limit)
    numbered = first.withColumn("index", F.row_number().over(Window.orderBy("chunk_id")) - 1)
    question = hard_question(F.col("title"), F.col("section_path"), F.col("department"), F.col("index"))
    return numbered.select(F.col("chunk_id").alias("place"), *item_columns(question, F.array("chunk_id"), T.first_sentence(F.col("text")), "hard", "positive_single", T.domain_from_department(F.col("department"))))


def multi_hop_pairs(chunks: DataFrame) -> DataFrame:
    """doc_id and its first two chunks by id (as text), of documents that have two."""
    wide = F.struct("chunk_id", "title", "section_path", "text", "department")
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    two = chunks.withColumn("n", F.row_number().over(order)).where("n <= 2")
    found = two.groupBy("doc_id").agg(F.array_sort(F.collect_list(wide)).alias("two")).where(F.size("two") == 2)
    return found.select("doc_id", F.col("two")[0].alias("first"), F.col("two")[1].alias("second"))


def multi_hop_items(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """One item for each of multi_hop_pairs(), of the first ``limit`` documents if that's given."""
    pairs = multi_hop_pairs(chunks)
    if limit is not None:
        pairs = pairs.orderBy("doc_id").limit(limit)
    question = _filled(MULTI, F.col("first.title"), T.last_section(F.col("first.section_path")), T.last_section(F.col("second.section_path")))
    reference = F.trim(F.concat_ws(" ", T.first_sentence(F.col("first.text")), T.first_sentence(F.col("second.text"))))
    return pairs.select(F.col("doc_id").alias("place"), *item_columns(question, F.array("first.chunk_id", "second.chunk_id"), reference, "hard", "positive_multi", T.domain_from_department(F.col("first.department"))))


def fixed_negatives(spark: SparkSession) -> DataFrame:
    """The fixed questions that must be refused, in their order."""
    return spark.createDataFrame([(f"{i:03d}", q) for i, q in enumerate(fixed.NEGATIVE_QUESTIONS)], "place string, question string")


def negative_items(questions: DataFrame) -> DataFrame:
    """Items that must be refused, from a table with ``question``, in order of ``place`` if it has that."""
    place = F.col("place") if "place" in questions.columns else F.col("question")
    return questions.select(place.alias("place"), *item_columns(F.col("question"), F.array().cast("array<string>"), F.lit("NOT_FOUND"), "hard", "negative", F.lit("General")))


def generate(chunks: DataFrame, negatives: DataFrame | None = None, hard: int = 24, multi: int = 12, target: int | None = None) -> DataFrame:
    """All items, numbered q001 and on: easy, hard, multi-hop, negative, each in order of chunk, document or question.

    ValueError if there are not ``target`` of them.
    """
    negatives = fixed_negatives(chunks.sparkSession) if negatives is None else negatives
    parts = [easy_items(chunks), hard_items(chunks, hard), multi_hop_items(chunks, multi), negative_items(negatives)]
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    numbered = with_numbers(out, "part", "place").select(F.format_string("q%03d", F.col("n")).alias("id"), "question", "gold", "reference_answer", "difficulty", "query_type", "domain")
    if target is not None and (found := numbered.count()) != target:
        raise ValueError(f"{found} items, not {target}")
    return numbered


def with_numbers(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``n``, from 1 in that order. Rows are sorted by ranges; only one count a range meets in one task."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("size"))
    before = sizes.select("__part", F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(before, "__part").withColumn("n", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def stratified_split(items: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``items`` with ``holdout``: of each (query_type, difficulty) the rounded share, one at least and not all; none of
    a single item. Which ones is by hash of id and seed."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    stratum = ["query_type", "difficulty"]
    keyed = items.withColumn("__key", F.md5(F.concat_ws(":", F.col("id"), F.lit(str(seed))).cast("binary"))).withColumn("__range", F.substring("__key", 1, 3))
    # places are counted by range of keys first, so that no task orders a stratum
    sizes = keyed.groupBy(*stratum, "__range").agg(F.count("*").alias("size"))
    whole = Window.partitionBy(*stratum)
    before = sizes.select(*stratum, "__range", F.sum("size").over(whole).alias("__n"), F.coalesce(F.sum("size").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    wanted = F.when(F.col("__n") <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.bround(F.col("__n") * ratio).cast("long"))))
    inside = F.row_number().over(Window.partitionBy(*stratum, "__range").orderBy("__key", "id"))
    same = [keyed[c].eqNullSafe(before[c]) for c in stratum]
    joined = keyed.join(before, [*same, keyed["__range"] == before["__range"]]).select(keyed["*"], "__n", "__before")
    return joined.withColumn("holdout", F.col("__before") + inside <= wanted).drop("__key", "__range", "__n", "__before")


def summarize(items: DataFrame) -> DataFrame:
    """Counts by query_type and difficulty."""
    return items.groupBy("query_type", "difficulty").agg(F.count("*").alias("n"))
