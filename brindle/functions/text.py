"""Text expressions: whitespace, search terms, names and number formats, embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that separate words, as one regular-expression class.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters one by one.
WHITESPACE_CHARS = "".join(
    map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

# Name parts of a money column and of a duration column.
MONEY_TERMS = ("charge", "cost", "revenue", "price")
ANSWER_MONEY_TERMS = ("charge", "revenue", "cost")
DURATION_TERMS = ("tenure", "month")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def clean_whitespace(text: Column) -> Column:
    """One space between words, none at the ends; line ends of every kind count as space."""
    return strip(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITESPACE}+"), lambda w: w != "")


def question_terms(question: Column) -> Column:
    """Lower-cased words longer than two characters, repeats kept."""
    return F.filter(words(F.lower(question)), lambda w: F.length(w) > 2)


def like_score(text: Column, terms: Column) -> Column:
    """How many of the terms occur in the text, ignoring case."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def contains_any(low: Column, phrases) -> Column:
    """True when an already lower-cased text holds one of the literal phrases."""
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def matches(low: Column, phrases) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def label_of(column: str) -> str:
    return column.replace("_", " ").title()


def grouped(value: Column, digits: int) -> Column:
    """Thousands separators and a fixed number of decimals, rounded half up."""
    return F.format_number(F.round(value.try_cast("decimal(38,8)"), digits), digits)


def money_or_plain(name: str, value: Column) -> Column:
    text = grouped(value, 2)
    return F.concat(F.lit("$"), text) if any(t in name.lower() for t in MONEY_TERMS) else text


def answer_number(name: str, value: Column) -> Column:
    """Money, months or plain number, decided by the column name."""
    low = name.lower()
    if any(t in low for t in ANSWER_MONEY_TERMS):
        return F.concat(F.lit("$"), grouped(value, 2))
    if any(t in low for t in DURATION_TERMS):
        return F.concat(grouped(value, 1), F.lit(" months"))
    return grouped(value, 2)


def json_block(text: Column) -> Column:
    """First of: the whole text, a fenced block, the outermost braces - that parses as JSON; NULL if none."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    picks = [F.when(F.try_parse_json(c).isNotNull(), c) for c in (text, fenced, braces)]
    return strip(F.coalesce(*picks))


# Openings of paragraphs that are working notes, not answer text.
NOTE_MARKS = ("We need to answer:", "Let's gather")
NOTE_STARTS = ("We need", "Let's")
MIN_ANSWER_CHARS = 50


def response_text(body: Column) -> Column:
    """Answer text of a JSON response: chat choices or predictions, then summary parts, then text parts."""
    content = F.coalesce(
        F.get_json_object(body, "$.choices[0].message.content"),
        F.get_json_object(body, "$.predictions[0]"),
        body,
    )
    items = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    summaries = F.transform(
        items,
        lambda item: F.array_join(
            F.filter(
                F.transform(
                    F.try_variant_get(item, "$.summary", "array<variant>"),
                    lambda part: F.try_variant_get(part, "$.text", "string"),
                ),
                lambda t: t.isNotNull(),
            ),
            "\n\n",
        ),
    )
    texts = F.transform(items, lambda item: F.try_variant_get(item, "$.text", "string"))
    found = F.filter(
        F.transform(
            F.arrays_zip(summaries.alias("s"), texts.alias("t")),
            lambda z: F.coalesce(F.when(z["s"] != "", z["s"]), z["t"]),
        ),
        lambda t: t.isNotNull(),
    )
    full = F.try_element_at(found, F.lit(1))
    paragraphs = F.filter(
        F.split(full, "\n\n"),
        lambda p: ~F.startswith(p, F.lit(NOTE_STARTS[0]))
        & ~F.startswith(p, F.lit(NOTE_STARTS[1]))
        & (F.length(p) > MIN_ANSWER_CHARS),
    )
    noted = F.contains(full, F.lit(NOTE_MARKS[0])) | F.contains(full, F.lit(NOTE_MARKS[1]))
    answer = F.when(noted & (F.size(paragraphs) > 0), F.array_join(paragraphs, "\n\n")).otherwise(full)
    return F.coalesce(answer, content)
