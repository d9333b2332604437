"""Column expressions on log text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Character classes of the source formats, spelled out so that Java matches Unicode text.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
_LETTER, _BEFORE_DASH = r"[\p{L}_]", r"[\p{L}\p{N}_!\"'&.,?]"
# between two letters a hyphen ends a piece of a word, and a dash of several is a piece of its own
_PIECE_END = (
    rf"(?<={_LETTER}{{2}}-|{_LETTER}-{_LETTER}-)(?={_LETTER}-?{_LETTER})"
    rf"|(?<={_BEFORE_DASH})(?=-{{2,}}{WORD})|(?<={_BEFORE_DASH}-{{2,40}})(?={WORD})"
)
# every blank of the class above, as a set of characters to trim
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])) + "".join(
    map(chr, [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# a digit is looked for first: the look-behind is dear and would be tried at every character
_START, _END = rf"(?=\p{{Nd}})(?<!{WORD})", rf"(?!{WORD})"

# What counts as a volatile token, in the order it is replaced.
HEX = r"0x[0-9a-fA-F]+"
IPV4 = rf"{_START}\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}{{1,3}}){{3}}{_END}"
IPV4_LOOSE = r"\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+"
NUMBER = rf"{_START}\p{{Nd}}+{_END}"
CURRENT_MASKS = ((HEX, "TAG_HEX"), (IPV4, "TAG_IP"), (NUMBER, "TAG_NUM"))
LEGACY_MASKS = ((HEX, "<HEX>"), (IPV4_LOOSE, "<IP>"), (NUMBER, "<NUM>"))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def split_lines(text: Column) -> Column:
    """The physical lines of a text, split at LF, CRLF or CR."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(unix, "\n")


def split_tokens(text: Column) -> Column:
    """White-space separated tokens of stripped, non-blank text."""
    return F.split(text, rf"{SPACE}+")


def token_count(text: Column) -> Column:
    """Number of tokens of stripped, non-blank text."""
    return F.regexp_count(text, F.lit(rf"{SPACE}+")) + 1


def mask_volatile(text: Column, masks=CURRENT_MASKS) -> Column:
    """Replace hex literals, addresses and whole numbers by tags, case kept."""
    for pattern, tag in masks:
        text = F.regexp_replace(text, pattern, tag)
    return text


def mask_tokens(text: Column) -> Column:
    return F.lower(mask_volatile(text))


def mask_tokens_legacy(text: Column) -> Column:
    return F.lower(mask_volatile(text, LEGACY_MASKS))


def words(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}{{2,}}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by each pair of neighbours joined by a space."""
    firsts = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(
        firsts, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.concat(tokens, pairs)


def shorten(text: Column, width: int = 40, placeholder: str = "...") -> Column:
    """Fold white space and cut behind a word, or behind a hyphen inside one, so that the label fits ``width``."""
    folded = F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))
    room = width - len(placeholder)
    cut = F.rtrim(F.regexp_extract(folded, rf"^(.{{0,{room}}})(?:\s|$|{_PIECE_END})", 1))
    return F.when(F.length(folded) <= width, folded).otherwise(F.concat(cut, F.lit(placeholder)))


def template_parameters(line: Column, template: Column, wildcard: str = "<*>") -> Column:
    """Tokens of the line that stand where the template has the wildcard."""
    marked = F.zip_with(
        split_tokens(line), split_tokens(template), lambda tok, tpl: F.when(tpl == wildcard, tok)
    )
    return F.filter(marked, lambda tok: tok.isNotNull())
