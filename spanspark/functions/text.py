"""String, regex and array expressions (no UDFs). Letters are Unicode letters: a bare \\w would be ASCII here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"\p{L}\p{N}_"
EDGES = rf"^[^{WORD_CLASS}]+|[^{WORD_CLASS}]+$"
TAGS = r"\[MATH\]|\[/MATH\]"
# The three punctuation sets; they differ on purpose.
PUNCT_SCORE = r"^[,.!?;:]+$"
PUNCT_OUTSIDE = r"^[.,;!?]+$"
STRONG_PUNCT = (".", "?", "!", ";", ":")
SENTENCE_BREAK = "[.!?;]"
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RU_PUNCT = "«»„“”…—–"
# Prefixes of metadata lines.
METADATA_PREFIXES = ("title:", "yb_link:", "branch:", "level:", "timecode_start:", "timecode_end:", "text:", "si=", "http")
LEAK = r"(?iu)спан"
REGEX_CHARS = r"[\[\]\\()|+?*{}]"


def words(text: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def words_and_marks(text: Column) -> Column:
    """Runs of word characters, and every other visible character by itself."""
    return F.regexp_extract_all(text, F.lit(rf"[{WORD_CLASS}]+|[^{WORD_CLASS}\s]"), F.lit(0))


def clean_word(token: Column, lower: bool = True) -> Column:
    """The token without non-word characters at its ends; inner marks and ё stay."""
    out = F.regexp_replace(token, EDGES, "")
    return F.lower(out) if lower else out


def normal_text(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit("ё"), F.lit("е"))


def normal_token(token: Column) -> Column:
    """Normal text without any punctuation, inner marks included."""
    return F.translate(normal_text(token), ASCII_PUNCT + RU_PUNCT, "")


def phrase_tokens(phrase: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(phrase, F.lit(rf"[{WORD_CLASS}]+"), F.lit(0)), normal_token), lambda x: x != "")


def word_shape(token: Column) -> Column:
    """X upper, x lower, d digit; the order keeps placeholders from being rewritten."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{Nd}", "d")


def surface_flags(token: Column) -> dict[str, Column]:
    return {
        "is_digit": token.rlike(r"^[0-9]+$"),
        "is_latin": token.rlike(r"^[a-zA-Z]+$"),
        "is_upper": token.rlike(r"[\p{Lu}\p{Lt}]") & ~token.rlike(r"\p{Ll}"),
        "is_title": F.substring(token, 1, 1).rlike(r"\p{Lu}"),
        "length": F.length(token).cast("bigint"),
    }


def affixes(token: Column, n: int = 3) -> tuple[Column, Column]:
    return F.substring(token, 1, n), F.right(token, F.lit(n))


def math_likeness(token: Column, math_words: Sequence[str], zero_words: Sequence[str]) -> Column:
    """How likely a token belongs to a formula: a ladder from -10 to 5."""
    t = F.regexp_replace(token, "^[.,!?;:²³]+|[.,!?;:²³]+$", "")
    letters = "a-zA-Zа-яА-ЯёЁ"
    return (
        F.when(t == "", -10).when(t.rlike("^[0-9]+$"), 5).when(t.rlike("^[a-zA-Z][0-9]?$"), 5)
        .when(t.rlike(f"^[0-9]+[{letters}]{{1,2}}$") | t.rlike(f"^[{letters}]{{1,2}}[0-9]+$"), 4)
        .when(F.lower(t).isin(*math_words), 3).when((F.length(t) <= 2) & t.isin(*zero_words), 0).otherwise(-2)
    )


def is_metadata(text: Column) -> Column:
    """Null, or a text that begins (after quotes and blanks) with a metadata prefix."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', "")))
    hit = F.lit(False)
    for p in METADATA_PREFIXES:
        hit = hit | F.startswith(bare, F.lit(p))
    return F.coalesce(hit, F.lit(True))


def is_math_mark(name: Column, reference: Column) -> Column:
    """A named annotation, or a reference that speaks of an inception."""
    blank = ("_", "*", "")
    return ~name.isin(*blank) | (~reference.isin(*blank) & F.contains(reference, F.lit("inception")))


def tag_counts(text: Column) -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(r"\[MATH\]")), F.regexp_count(text, F.lit(r"\[/MATH\]"))


def tags_alternate(text: Column) -> Column:
    """Every opening tag is closed before the next one opens."""
    marks = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TAGS), F.lit(0)), lambda x: F.when(x == "[MATH]", "o").otherwise("c")), "")
    return marks.rlike("^(oc)*$")


def reject_reason(text: Column) -> Column:
    """First failed check of a tagged line: counts, nesting, leak; null: keep."""
    opened, closed = tag_counts(text)
    return F.when((opened != closed) | (opened == 0), "counts").when(~tags_alternate(text), "nesting").when(text.rlike(LEAK), "leak")


def strip_numbering(text: Column) -> Column:
    return F.regexp_replace(text, r"^[0-9]+[.)]\s*", "")


def safe_id(name: Column) -> Column:
    """A name usable as an id: other characters become one underscore; nothing left: input."""
    tidy = F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-zА-Яа-яЁё_-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(tidy, "^_+|_+$", ""), F.lit("")), F.lit("input"))


def alnum_chars(token: Column) -> Column:
    return F.filter(F.split(F.lower(token), ""), lambda c: c.rlike(r"^[\p{L}\p{N}]$"))


def resample_mask(n_words: Column, mask: Column) -> Column:
    """A 0/1 mask stretched or shrunk to n words: a word is 1 if more than half of its bits are; bounds round half to even."""
    m = F.length(mask)
    bound = lambda i: F.bround(i * m / n_words).cast("int")

    def one(i):
        part = F.substring(mask, bound(i) + 1, bound(i + 1) - bound(i))
        return F.when(2 * F.length(F.translate(part, "0", "")) > F.length(part), "1").otherwise("0")

    return F.when(n_words > 0, F.array_join(F.transform(F.sequence(F.lit(0), n_words - 1), one), "")).otherwise("")


def response_sentence(block: Column) -> Column:
    return F.trim(F.regexp_extract(block, r"SENTENCE:\s*([^\n]*)", 1))


def response_formulas(block: Column) -> Column:
    """(id, spoken, latex) of a response block by id; a formula without a latex line gets ???; the last line of an id counts."""
    sentence, pair, line = response_sentence(block), F.lit(r"<F(\d+)>(.*?)</F\1>"), F.lit(r"(?m)^F(\d+):[^\S\n]*(.*)$")
    found = lambda text, p, g: F.regexp_extract_all(text, p, F.lit(g))
    ids, spoken = found(sentence, pair, 1), found(sentence, pair, 2)
    latex = F.zip_with(found(block, line, 1), found(block, line, 2), lambda i, t: F.struct(i.cast("int").alias("id"), F.trim(F.replace(t, F.lit("`"), F.lit(""))).alias("latex")))

    def one(i, t):
        of_id = F.filter(latex, lambda x: (x["id"] == i.cast("int")) & (x["latex"] != ""))
        return F.struct(i.cast("int").alias("id"), F.trim(t).alias("spoken"), F.coalesce(F.get(of_id, F.size(of_id) - 1)["latex"], F.lit("???")).alias("latex"))

    return F.array_sort(F.zip_with(ids, spoken, one))


def response_tagged(sentence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sentence, r"<F[0-9]+>", "[MATH]"), r"</F[0-9]+>", "[/MATH]")


def f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is 0."""
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero)}
