import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docgrain.functions import fixed
from docgrain.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def of(build, *texts):
        row = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return row.select(build(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first()["x"]

    return of


def test_normalize(value):
    raw = "  a\x00b\t c \r\n\n x y\x1cz "
    lines = [" ".join(line.split()) for line in raw.replace("\x00", " ").splitlines()]
    assert value(T.normalize_text, raw) == "\n".join(x for x in lines if x)
    assert value(T.normalize_text, "") == ""


def test_tidy_texts_are_told_from_others(value):
    """Most texts need one quick look at their white space; what fails it is worked on in full, to the same end."""
    for gap in fixed.SPACES:
        assert value(T.usual, f"a{gap}ñ") == (gap in " \n"), repr(gap)
    for text in ("a b\nc", "", " a\n", "x ỹ", "a  b", "a \nb", "a\n b", "a\n\nb", "a\tb", "a\x00b", "é😀 x", "a\u2028 \u2028b", "\x7f a"):
        lines = [" ".join(line.split()) for line in text.replace("\x00", " ").splitlines()]
        assert value(T.normalize_text, text) == "\n".join(x for x in lines if x), repr(text)
        assert value(T.words_of, text) == text.split(), repr(text)
        pairs = any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
        assert value(T.tidy, text) == (value(T.usual, text) and not pairs), repr(text)
    assert [value(f, None) for f in (T.normalize_text, T.words_of)] == [None, None]


def test_names(value):
    assert value(T.infer_department, "through_policy") == "HR" and value(T.infer_department, "a_challenge") == "Engineering"
    assert value(T.infer_department, "finance") == "General" and value(T.infer_department, "Security_eng") == "Security"
    assert value(T.infer_access_level, "x_internal_restricted") == "restricted" and value(T.infer_access_level, "x") == "public"
    assert value(T.infer_updated_at, "a_2024-09-25") == "2024-09-25" and value(T.infer_updated_at, "a_1999-09-25") == "1970-01-01"
    assert value(lambda c: T.infer_updated_at(c, False), "a_2024-09-25") == "1970-01-01"


def test_dates(value):
    for text, day in (("2024-1-5", "2024-01-05"), ("2024-13-01", "1970-01-01"), ("x", "1970-01-01"), ("", "1970-01-01")):
        assert str(value(T.parse_date, text)) == day


def test_accents(value):
    text = "Được định đang Nghỉ phép Ệ Ǖ é × Straße"
    assert value(T.strip_accents, text) == unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def test_tokens(value):
    assert value(T.index_tokens, "Branch nhánh_1 TEAM, thuật-thuat 日本") == ["nhanh", "nhánh_1", "nhom", "thuật", "engineering"]
    assert value(T.overlap_tokens, "branch nhánh được của a b1 Là") == ["nhanh", "nhanh", "đuoc", "b1"]
    assert value(T.overlap_tokens, "") == []


def test_overlap(value):
    def score(q, c):
        return T.overlap_score(T.token_set(q), T.token_set(c))

    assert value(score, "alpha beta gamma delta", "alpha x1 y1") == 0.25
    assert value(score, "alpha beta gamma delta", "alpha beta") == 1.0
    assert value(score, "alpha", "beta") == 0
    assert value(lambda p, t: T.phrase_score(T.token_set(p), T.token_set(t)), "leave policy", "the policy") == 0.5
    assert value(lambda p, t: T.phrase_score(T.token_set(p), T.token_set(t)), "", "policy") == 0


def test_dedup(value):
    assert value(lambda a, b, c, d: T.dedup_keep_order(F.array(a, b, c, d)), "Nghỉ ", "nghi", " ", "x") == ["Nghỉ ", "x"]


def targets(value, question):
    t = value(T.query_targets, question)
    return t.doc_titles, t.sections, t.quoted_phrases


def test_targets(value):
    assert targets(value, "Theo tài liệu 'hr leave policy', mục 'Leave' gì?") == (["hr leave policy"], ["Leave"], ["hr leave policy", "Leave"])
    assert targets(value, "mục 'Onboarding' trong 'engineering onboarding public'")[:2] == ([], ["Onboarding", "engineering onboarding public"])
    assert targets(value, "xem \"x policy\" và “y z w”")[:2] == (["x policy"], ["y z w"])
    assert targets(value, "xem 'one' và 'two words here' và 'x'")[:2] == (["two words here"], ["one", "x"])
    assert targets(value, "báo cáo '2024'")[:2] == (["2024"], [])
    assert targets(value, "no quotes") == ([], [], [])


def test_questions(value):
    assert value(T.is_yes_no, "Có được nghỉ không?") and not value(T.is_yes_no, "Có được nghỉ?")
    assert value(T.number_tokens, "từ 12,5 đến 3.1.4 và ٣") == re.findall(r"\d+(?:[.,]\d+)?", "từ 12,5 đến 3.1.4 và ٣")
    assert value(T.acronym_tokens, "SLA IT x AIé A B2B") == ["SLA", "IT"]

    def numbers(q, e):
        return T.numbers_supported(q, F.array(e))

    def acronyms(q, e):
        return T.acronyms_supported(q, F.array(e))

    assert value(numbers, "x", "") and value(numbers, "12 and 20", "in 20") and not value(numbers, "12", "120")
    assert not value(lambda q: T.numbers_supported(q, F.array().cast("array<string>")), "12")
    assert value(acronyms, "SLA IT", "the sla of it") and not value(acronyms, "AI", "said") and value(acronyms, "none", "")
    coverage = value(lambda q, e: T.token_coverage(q, F.array(e)), "drone flight rules abc", "drone rules")
    assert abs(coverage - 2 / 3) < 1e-12
    assert value(lambda q: T.token_coverage(q, F.array().cast("array<string>")), "abc") == 1.0


def test_sentences(value):
    text = " One. Two!  Three? Four "
    assert value(T.sentences, text) == ["One.", "Two!", "Three?", "Four"]
    assert value(T.snippet, text) == "- One. Two!" and value(T.first_sentence, "No end") == "No end." and value(T.first_sentence, "End? x") == "End?"
    assert len(value(T.snippet, "x" * 999)) == 322
    assert value(T.draft_bullet, "a b. c") == "- a b" and value(T.draft_bullet, ". c d") == "- . c d"
    assert value(T.signature, "A  b\nC" + "x" * 300) == ("a b c" + "x" * 300)[:160]
    assert value(T.domain_from_department, " ") == "General" and value(T.last_section, "A > B > C") == "C"
    assert value(T.clarifying_question, "q?").endswith("(Cau hoi goc: q?)")


def test_prompt(value):
    hit = F.array(F.struct(F.lit("t").alias("title"), F.lit("s").alias("section_path"), F.lit("c").alias("chunk_id"), F.lit("x").alias("text")))
    assert value(lambda q: T.build_prompt(q, hit), "why").endswith("QUESTION:\nwhy\n\nEVIDENCE:\n[1] title=t | section=s | chunk_id=c\nx\n")


def test_spelled_patterns_are_what_unicode_says(spark):
    """The spelled-out classes match the same characters as the shorter patterns that they stand for."""
    text = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x3100) if not 0xD800 <= i <= 0xDFFF], "id int, c string")
    assert text.where(F.regexp_like("c", F.lit(fixed.SPACE)) != F.regexp_like("c", F.lit(r"(?U)[\s\x1C-\x1F]"))).count() == 0
    assert text.where(F.regexp_like("c", F.lit(fixed.SPELLED)) != F.regexp_like("c", F.lit(fixed.TOKEN))).count() == 0
    assert sorted(fixed.SPACES) == sorted(r.c for r in text.where(F.regexp_like("c", F.lit(r"(?U)[\s\x1C-\x1F]"))).collect())
