"""Column functions on page and chunk texts. White space and letters follow Unicode, as in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
STRIP = rf"\A{BLANK}+|{BLANK}+\z"
#: The characters of BLANK, for trimming without a regex.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Abbreviations whose stop ends no sentence.
ABBREVIATIONS = (
    "al", "approx", "Capt", "cf", "Ch", "Co", "Col", "Corp", "Dept", "Dr", "e.g", "ed", "eds", "Eq", "Eqs", "Fig", "Figs", "Gen", "i.e", "Inc",
    "Jr", "Lt", "Ltd", "Mr", "Mrs", "Ms", "Mt", "pp", "Prof", "Rep", "Rev", "Sec", "Sen", "Sgt", "Sr", "St", "Univ", "Vol", "vs",
)
#: A character that stands in no text: a sentence's end.
END = "\uffff"
#: White space, apart from the stop mark and closing quotes or brackets before it.
_LONGEST = max(map(len, ABBREVIATIONS))
_AFTER_END = r"""([.!?]["')\]]*)(\s+)"""
#: Characters around a word that are no part of it.
AROUND = "\"'()[]{}<>“”„‘’«»"
_NUMBER = r"\p{Nd}{1,4}"
_RULE = r"[-\x{2013}\x{2014}.\s\p{Z}\x1c-\x1f\x85]*+"
#: A line that is a page number of one to four digits: alone or between rules, or with words that say so.
PAGE_NUMBER = rf"\A(?i)(?:{_RULE}{_NUMBER}{_RULE}|{BLANK}*+(?:page{BLANK}*+{_NUMBER}|p\.{BLANK}*+{_NUMBER}|{_NUMBER}{BLANK}*+of{BLANK}*+{_NUMBER}){BLANK}*+)\z"
CAPTION = rf"^(?i){BLANK}*(?:figure|fig\.|table){BLANK}+\p{{Nd}}+(?:\.\p{{Nd}}+)*[.:]?{BLANK}*$"
REFERENCE = r"^\s*\[1\]\s+\p{Lu}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def tokens(text: Column) -> Column:
    """Non-empty words between white space."""
    return F.filter(F.split(text, rf"{BLANK}+"), lambda x: x != "")


def letter_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return letters / F.greatest(F.length(text), F.lit(1))


def is_useful_page(text: Column, min_words: int = 40, min_letters: float = 0.4) -> Column:
    """Enough words, and enough of the characters are letters."""
    return (F.size(tokens(text)) >= min_words) & (letter_share(text) >= min_letters)


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def likely_has_tables(text: Column, short: int = 60, share: float = 0.4) -> Column:
    """Three lines or more, and more than ``share`` of them are short and hold a digit."""
    rows = lines(strip(text))
    hits = F.filter(rows, lambda x: (F.length(strip(x)) < short) & x.rlike(r"\p{Nd}"))
    return (F.size(rows) >= 3) & (F.size(hits) > share * F.size(rows))


def needs_table_fallback(text: Column) -> Column:
    return ~F.contains(text, F.lit("|")) & likely_has_tables(text)


def render_markdown_tables(tables: Column) -> Column:
    """Tables (array of rows of nullable cells) as Markdown; empty tables are left out."""

    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))

    def table(rows: Column) -> Column:
        rule = row(F.transform(rows[0], lambda c: F.lit("---")))
        body = F.transform(F.slice(rows, 2, F.size(rows)), row)
        return F.array_join(F.concat(F.array(row(rows[0]), rule), body, F.array(F.lit(""))), "\n")

    some = F.filter(tables, lambda t: F.size(t) > 0)
    return F.array_join(F.transform(some, table), "\n")


def with_tables(text: Column, tables: Column) -> Column:
    """Page text with its rendered tables behind a blank line."""
    shown = render_markdown_tables(tables)
    return F.when(F.coalesce(shown, F.lit("")) == "", text).otherwise(F.concat(text, F.lit("\n\n"), shown))


def is_scanned(text: Column, n_images: Column, least: int = 20) -> Column:
    return (F.length(strip(F.coalesce(text, F.lit("")))) < least) & (n_images > 0)


# Cleaning, in the order in which ``clean_pages`` applies it.


def rejoin_hyphens(text: Column) -> Column:
    # It begins with the hyphen, which is found fast. What stands before it must not belong to the match before (\G);
    # {1,2} lets the look behind reach a letter of two UTF-16 units.
    return F.regexp_replace(text, rf"-(?<=[\p{{L}}\p{{N}}_]{{1,2}}-)(?<!\G-){BLANK}*\n{BLANK}*([a-z])", "$1")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def strip_page_numbers(text: Column) -> Column:
    kept = F.filter(lines(text), lambda x: ~x.rlike(PAGE_NUMBER))
    return F.array_join(kept, "\n")


def normalize_whitespace(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?dm)[ \t]+$", "")
    return strip(F.regexp_replace(text, r"(\n\n)\n+|( ) +", "$1$2"))


def clean_text(text: Column) -> Column:
    """Cleaning of one string, without the stage for running headers."""
    return strip(normalize_whitespace(strip_page_numbers(strip_control(rejoin_hyphens(text)))))


def ascii_fold_symbols(text: Column) -> Column:
    return F.translate(text, "●▪•■◦─━–—“”‘’", "*****----\"\"''")


def strip_isolated_captions(text: Column) -> Column:
    """Drops lines that are only a figure or table number."""
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(CAPTION)), "\n")


def drop_references(text: Column) -> Column:
    """Cuts each section from the first line that starts a numbered reference list to the section's end, which is
    the next heading or the end of the text."""

    def without(section: Column) -> Column:
        rows = lines(section)
        at = F.array_position(F.transform(rows, lambda x: x.rlike(REFERENCE)), True).cast("int")
        return F.when(at > 0, F.slice(rows, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(rows)

    sections = F.split(text, r"\n(?=#{1,3}(?: |\n|\z))", -1)
    return F.array_join(F.flatten(F.transform(sections, without)), "\n")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def split_where(text: Column, goes_on: Callable[[Column, Column], Column]) -> Column:
    """Sentences in order, stripped, without blank ones. A piece ends at a stop mark, closing quotes or brackets, and
    white space; ``goes_on(piece, next)`` tells of two neighbouring pieces whether the sentence does not end there."""
    pieces = F.split(F.regexp_replace(text, _AFTER_END, f"$1{END}$2"), END)

    def joined(ps: Column) -> Column:
        last = F.size(ps) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda k: (k == last) | ~goes_on(ps[k], ps[k + 1]))

        def sentence(es: Column) -> Column:
            before = lambda n: F.when(n > 0, es[n - 1]).otherwise(F.lit(-1))
            return F.transform(es, lambda e, n: strip(F.array_join(F.slice(ps, before(n) + 2, e - before(n)), "")))

        return once(ends, sentence)

    return F.filter(once(pieces, joined), lambda s: s != "")


def _fixed_goes_on(piece: Column, following: Column) -> Column:
    """Behind an abbreviation or an initial, or before a word in lower case."""
    short = F.regexp_extract(F.right(piece, F.lit(_LONGEST + 2)), r"([\p{L}\p{N}_.]*)\.\z", 1)
    inner = piece.rlike(r"""\.["')\]]*\z""") & following.rlike(r"\A\s+\p{Ll}")
    return short.isin(*ABBREVIATIONS, *"ABCDEFGHJKLMNOPQRSTUVWXYZ") | inner


def split_sentences(text: Column) -> Column:
    """Sentences in order, stripped, without blank ones. One ends at a stop mark, closing quotes or brackets, and
    white space; but not at the stop of an abbreviation or an initial, nor before a word in lower case (decimals
    have no white space behind their point). ``operators.borders`` learns the abbreviations instead."""
    return split_where(text, _fixed_goes_on)


# Chunks.


def build_breadcrumb(section: Column, subsection: Column, subsubsection: Column) -> Column:
    return F.concat_ws(" > ", *[F.nullif(c, F.lit("")) for c in (section, subsection, subsubsection)])


def inject_breadcrumb(text: Column, breadcrumb: Column) -> Column:
    return F.when(breadcrumb != "", F.concat(breadcrumb, F.lit("\n"), text)).otherwise(text)


def chunk_id(source: Column, index: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("::chunk_"), index.cast("string")), 256)


def num_sentences(text: Column) -> Column:
    return F.size(F.split(text, r"\. ", -1))


def attach_doc_id(source: Column) -> Column:
    """A stable document id from the source's name (recomputed tasks agree)."""
    return F.substring(F.sha2(source, 256), 1, 9)
