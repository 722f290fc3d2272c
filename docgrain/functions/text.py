"""Text functions from Column to Column; all run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: A character beyond these ranges may not be in normal form C.
MAY_NEED_NFC = r"[^\x00-\x{02FF}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}]"
#: A text without any of these has no white space but blanks and line feeds. Their complement, written with ^, takes 18 CPU seconds for 25 MB, this 2.
UNUSUAL = r"[\x00-\x09\x0B-\x1F\x7F-\xA0\x{1680}-\x{10FFFF}]"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(text, fixed.LINE)


def usual(text: Column) -> Column:
    """Whether the only white space is blanks and line feeds, or false where that isn't sure: one look at each character."""
    return ~F.regexp_like(text, F.lit(UNUSUAL))


def tidy(text: Column) -> Column:
    """Whether a usual text has single blanks between words and single line feeds between lines, but for its ends."""
    out = usual(text)
    for pair in ("  ", " \n", "\n ", "\n\n"):
        out = out & ~F.contains(text, F.lit(pair))
    return out


def normalize_text(text: Column) -> Column:
    """NULs become spaces; each line's white space becomes single spaces, trimmed; empty lines go.

    Composition to normal form C is ingest's (see sources.files.compose); texts of safe ranges have it.
    """
    return squeeze(F.replace(text, F.lit("\x00"), F.lit(" ")))


def squeeze(text: Column) -> Column:
    """normalize_text() that leaves NULs as they are."""

    def of(t: Column) -> Column:
        # a blank between words is what it should be
        spaced = F.regexp_replace(t, rf" [ {fixed.GAPS}]++|[{fixed.GAPS}][ {fixed.GAPS}]*+", " ")
        return F.btrim(F.when(tidy(t), t).otherwise(F.regexp_replace(spaced, f" ?[{fixed.BREAKS}][ {fixed.BREAKS}]*+", "\n")), F.lit(" \n"))

    return let(text, of)


def words_of(text: Column) -> Column:
    """Runs between white space."""
    return let(text, lambda t: F.array_remove(F.when(usual(t), F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " ")).otherwise(F.split(t, fixed.SPACE)), ""))


def infer_department(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("hr")), "HR").when(F.contains(low, F.lit("security")), "Security").when(F.contains(low, F.lit("eng")), "Engineering").otherwise("General")


def infer_access_level(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("restricted")), "restricted").when(F.contains(low, F.lit("internal")), "internal").otherwise("public")


def infer_updated_at(name: Column, parse_dates: bool = True) -> Column:
    if not parse_dates:
        return F.lit("1970-01-01")
    found = F.regexp_extract(name, r"(20\d{2}-\d{2}-\d{2})", 1)
    return F.when(found != "", found).otherwise("1970-01-01")


def parse_date(value: Column) -> Column:
    return F.coalesce(F.try_to_date(value, "yyyy-M-d"), F.lit("1970-01-01").cast("date"))


def index_text(title: Column, section_path: Column, text: Column) -> Column:
    return F.concat_ws(" ", title, section_path, text)


def _aliased(tokens: Column) -> Column:
    def one(x: Column) -> Column:
        out = F
        for token, other in fixed.ALIASES.items():
            out = out.when(x == token, other)
        return out.otherwise(x)

    # few texts have any
    keys = F.array(*[F.lit(x) for x in fixed.ALIASES])
    return let(tokens, lambda t: F.when(F.arrays_overlap(t, keys), F.transform(t, one)).otherwise(t))


def index_tokens(text: Column) -> Column:
    """Lower-cased tokens with their accents, aliases applied."""
    return _aliased(F.regexp_extract_all(F.lower(text), F.lit(fixed.SPELLED), F.lit(0)))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters that are one other character without marks, and these."""
    source, target = [], []
    for code in range(0xC0, 0x30000):
        char = chr(code)
        if unicodedata.category(char) in ("Cn", "Co", "Cs", "Mn"):
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        bare = unicodedata.normalize("NFC", bare)
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


def strip_accents(text: Column) -> Column:
    """Without non-spacing marks, and otherwise composed, as far as single characters go; đ, which has none, stays."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", "")


def all_tokens(text: Column) -> Column:
    """Lower-cased tokens without accents, aliases applied."""
    found = F.regexp_extract_all(text, F.lit(fixed.SPELLED), F.lit(0))
    # tokens are stripped together: a space is no token character and has no accent
    return _aliased(F.array_remove(F.split(strip_accents(F.lower(F.array_join(found, " "))), " "), ""))


def overlap_tokens(text: Column) -> Column:
    """Content tokens: all_tokens() longer than one character that are no stop words; an array with repeats."""
    return F.filter(all_tokens(text), lambda x: (F.length(x) > 1) & ~x.isin(*fixed.STOP_WORDS))


def token_set(text: Column) -> Column:
    """The distinct overlap_tokens(), in order."""
    return F.filter(F.array_except(all_tokens(text), F.array(*[F.lit(w) for w in fixed.STOP_WORDS])), lambda x: F.length(x) > 1)


def overlap_score(query: Column, chunk: Column) -> Column:
    """Of two token sets: the share of the query's tokens, or of the chunk's if that's more and two are shared."""

    def of(n: Column) -> Column:
        share = n / F.size(query)
        return F.when(n == 0, 0.0).when(n < 2, share).otherwise(F.greatest(share, n / F.size(chunk)))

    return let(F.size(F.array_intersect(query, chunk)), of)


def phrase_score(phrase: Column, target: Column) -> Column:
    """Of two token sets: the share of the phrase's tokens that the target has."""
    return F.when((F.size(phrase) == 0) | (F.size(target) == 0), 0.0).otherwise(F.size(F.array_intersect(phrase, target)) / F.size(phrase))


def best_phrase_score(phrases: Column, target: Column) -> Column:
    """phrases: an array of token sets."""
    return F.coalesce(F.array_max(F.transform(phrases, lambda p: phrase_score(p, target))), F.lit(0.0))


def dedup_keep_order(values: Column) -> Column:
    """The first of values that are equal without case, accents and outer spaces; blank ones go."""
    keyed = F.transform(values, lambda x: F.struct(F.trim(strip_accents(F.lower(x))).alias("k"), x.alias("v")))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    kept = F.aggregate(keyed, empty, lambda acc, x: F.when((x["k"] == "") | F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.array_append(acc, x)))
    return F.transform(kept, lambda x: x["v"])


def _inner(quoted: Column) -> Column:
    return F.trim(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def quoted_phrases(text: Column) -> Column:
    return dedup_keep_order(F.transform(F.regexp_extract_all(text, F.lit(fixed.QUOTED), F.lit(0)), _inner))


def query_targets(question: Column) -> Column:
    """Struct of doc_titles, sections and quoted_phrases that a question names in quotes."""
    bare = strip_accents(F.lower(question))
    found = F.regexp_extract_all(question, F.lit(fixed.QUOTED), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<p:string,c:string>>").alias("x"))

    def step(acc: Column, match: Column) -> Column:
        place = F.call_function("locate", match, question, acc["at"])
        before = F.substring(bare, F.greatest(place - 40, F.lit(1)), F.least(place - 1, F.lit(40)))
        return F.struct((place + F.length(match)).alias("at"), F.array_append(acc["x"], F.struct(_inner(match).alias("p"), before.alias("c"))).alias("x"))

    def kind(x: Column) -> Column:
        p = strip_accents(F.lower(x["p"]))
        named = F.contains(p, F.lit("internal")) | F.contains(p, F.lit("public")) | F.contains(p, F.lit("policy")) | F.regexp_like(p, F.lit(r"(?U)\d{4}"))
        return (
            F.when(F.contains(x["c"], F.lit("muc")), "section")
            .when(F.contains(x["c"], F.lit("tai lieu")) | F.contains(x["c"], F.lit("trong")) | named, "title")
            .otherwise("unknown")
        )

    def split(items: Column) -> Column:
        def of(name: str) -> Column:
            return F.transform(F.filter(items, lambda x: x["k"] == name), lambda x: x["p"])

        titles, sections, unknown = of("title"), of("section"), of("unknown")
        longest = F.array_max(F.transform(unknown, lambda p, i: F.struct(F.size(overlap_tokens(p)).alias("n"), (-i).alias("i"), p.alias("p"))))
        first = -longest["i"]
        chosen = (F.size(titles) == 0) & (F.size(unknown) > 0)
        rest = F.transform(F.array_sort(F.transform(F.filter(F.transform(unknown, lambda p, i: F.struct((-F.size(overlap_tokens(p))).alias("n"), i.alias("i"), p.alias("p"))), lambda x: x["i"] != first), lambda x: x)), lambda x: x["p"])
        return F.struct(
            dedup_keep_order(F.when(chosen, F.array(longest["p"])).otherwise(titles)).alias("doc_titles"),
            dedup_keep_order(F.when(chosen, F.concat(sections, rest)).otherwise(F.concat(sections, unknown))).alias("sections"),
            quoted_phrases(question).alias("quoted_phrases"),
        )

    items = F.filter(F.aggregate(found, start, step, lambda acc: acc["x"]), lambda x: x["p"] != "")
    return let(F.transform(items, lambda x: F.struct(x["p"].alias("p"), kind(x).alias("k"))), split)


def is_yes_no(text: Column) -> Column:
    return let(all_tokens(text), lambda t: F.array_contains(t, "co") & F.array_contains(t, "khong"))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"(?U)\d+(?:[.,]\d+)?"), F.lit(0))


def acronym_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z]{2,}\b"), F.lit(0))


def numbers_supported(question: Column, evidence: Column) -> Column:
    """evidence: an array of texts. True without numbers; else whether any of them is in the evidence."""
    return let(number_tokens(question), lambda q: F.when(F.size(q) == 0, True).otherwise(F.arrays_overlap(q, F.flatten(F.transform(evidence, number_tokens)))))


def acronyms_supported(question: Column, evidence: Column) -> Column:
    there = F.regexp_extract_all(F.upper(F.array_join(evidence, " ")), F.lit(r"(?U)\b[A-Z0-9]{2,}\b"), F.lit(0))
    return let(acronym_tokens(question), lambda q: F.when(F.size(q) == 0, True).otherwise(F.arrays_overlap(q, there)))


def token_coverage(question: Column, evidence: Column, least: int = 5) -> Column:
    """Share of the question's content tokens of ``least`` characters and more that the evidence has."""
    there = F.flatten(F.transform(evidence, overlap_tokens))

    def of(q: Column) -> Column:
        return F.when(F.size(q) == 0, 1.0).when(F.size(evidence) == 0, 0.0).otherwise(F.size(F.array_intersect(q, there)) / F.size(q))

    return let(F.filter(token_set(question), lambda x: F.length(x) >= least), of)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(trim_space(text), r"(?U)(?<=[.!?])[\s\x1C-\x1F]+"), trim_space), lambda x: x != "")


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.SPACES))


def snippet(text: Column) -> Column:
    """A bullet of the first two sentences, 320 characters at the most."""
    body = let(sentences(text), lambda s: F.when(F.size(s) > 0, F.array_join(F.slice(s, 1, 2), " ")).otherwise(trim_space(text)))
    return F.concat(F.lit("- "), F.regexp_replace(F.substring(body, 1, 320), r"(?U)[\s\x1C-\x1F]+$", ""))


def draft_bullet(text: Column) -> Column:
    """A bullet of what precedes the first full stop, or of the first 200 characters if that is blank."""
    first = trim_space(F.substring_index(text, ".", 1))
    return F.concat(F.lit("- "), F.when(first != "", first).otherwise(trim_space(F.substring(text, 1, 200))))


def first_sentence(text: Column) -> Column:
    def of(s: Column) -> Column:
        one = s[0]
        return F.when(F.size(s) == 0, trim_space(text)).when(F.regexp_like(one, F.lit(r"[.!?]$")), one).otherwise(F.concat(one, F.lit(".")))

    return let(sentences(text), of)


def signature(text: Column) -> Column:
    """What citations are deduplicated by."""
    return F.substring(F.array_join(words_of(F.lower(text)), " "), 1, 160)


def search_snippet(text: Column) -> Column:
    return F.substring(text, 1, 250)


def clarifying_question(question: Column) -> Column:
    head, tail = fixed.CLARIFY.split("{}")
    return F.concat(F.lit(head), question, F.lit(tail))


def build_prompt(question: Column, hits: Column) -> Column:
    """hits: an array of structs with title, section_path, chunk_id and text."""
    lines = F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] title="), h["title"], F.lit(" | section="), h["section_path"], F.lit(" | chunk_id="), h["chunk_id"], F.lit("\n"), h["text"]))
    return F.concat(F.lit(fixed.PROMPT_HEAD + "QUESTION:\n"), question, F.lit("\n\nEVIDENCE:\n"), F.array_join(lines, "\n\n"), F.lit("\n"))


def domain_from_department(department: Column) -> Column:
    return F.coalesce(F.nullif(trim_space(department), F.lit("")), F.lit("General"))


def last_section(section_path: Column) -> Column:
    return F.substring_index(section_path, " > ", -1)
