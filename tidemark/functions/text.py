"""Text cleaning as native column expressions."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The styled alphabets are runs of consecutive code points.
_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_LOWER = _UPPER.lower()
_DIGITS = "0123456789"


def _run(first: int, n: int) -> str:
    return "".join(map(chr, range(first, first + n)))


BOLD = _run(0x1D5D4, 26) + _run(0x1D5EE, 26) + _run(0x1D7EC, 10)
BOLD_PLAIN = _UPPER + _LOWER + _DIGITS
ITALIC = _run(0x1D608, 26) + _run(0x1D622, 26)
ITALIC_PLAIN = _UPPER + _LOWER

# Emoticons, pictographs, transport, flags, three arrows.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2193}\x{21B3}\x{2192}]+"
# White space of the Unicode standard, spelled out so that no engine's own idea of it matters.
SPACE = "".join(
    chr(c)
    for c in (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# Where styled letters, emoji, arrows and typographic quotes lie; two ranges, which Java matches fast.
RARE = r"[\x{91}-\x{94}\x{2018}-\x{10FFFF}]"
URL = r"https?://[^\x{9}-\x{D}\x{1C}-\x{20}]+|www\.[^\x{9}-\x{D}\x{1C}-\x{20}]+"
# Typographic quotes, and the control characters that stand for them in Windows texts.
SINGLE_QUOTES = "[‘’‚‛′\\x{91}\\x{92}]"
DOUBLE_QUOTES = "[“”„‟″\\x{93}\\x{94}]"
BLANKS = r"[ \t\n\r\f]{2,}|[\t\n\r\f]"  # what squeezing has to touch; single spaces stay

COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header"
    r"|hr|html|li|link|main|meta|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
ANY_TAG = r"</?[a-zA-Z!][^>]*>"
# Every named character reference of HTML, by name; a no-break space counts as a blank.
NAMED = {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")} | {"nbsp": " "}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` (or a lambda in it) mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def _where(condition: Callable[[Column], Column], change: Callable[[Column], Column], text: Column) -> Column:
    """``change`` the texts that need it; a cheap test spares the others the work."""
    return let(text, lambda t: F.when(condition(t), change(t)).otherwise(t))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def unbold(text: Column | str) -> Column:
    styled = r"[\x{1D5D4}-\x{1D607}\x{1D7EC}-\x{1D7F5}]"
    return _where(lambda t: t.rlike(styled), lambda t: F.translate(t, BOLD, BOLD_PLAIN), _col(text))


def unitalic(text: Column | str) -> Column:
    styled = r"[\x{1D608}-\x{1D63B}]"
    return _where(lambda t: t.rlike(styled), lambda t: F.translate(t, ITALIC, ITALIC_PLAIN), _col(text))


def drop_emoji(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), EMOJI, " ")


def mask_urls(text: Column | str, placeholder: str = "[URL]") -> Column:
    return F.regexp_replace(_col(text), URL, placeholder)


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(SPACE))


def plain_quotes(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), SINGLE_QUOTES, "'"), DOUBLE_QUOTES, '"')


def ascii_only(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[^\x{0}-\x{7F}]", "")


def _code_point(code: Column) -> Column:
    """Character of a code point; unusable codes give the replacement character."""
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(usable, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decode_entities(text: Column | str) -> Column:
    """``&#8217;``, ``&#x2019;`` and ``&rsquo;`` to characters, in one pass, so that nothing is decoded twice. Unknown names
    stay as they are."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # folded into a constant

    def part(piece: Column, index: Column) -> Column:
        dec = F.regexp_extract(piece, r"^#0*([0-9]{1,7});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1)
        named = F.try_element_at(names, F.regexp_extract(piece, r"^([a-zA-Z][a-zA-Z0-9]*);", 1))
        rest = F.regexp_replace(piece, r"^[^;]*;", "")
        return (
            F.when(index == 0, piece)
            .when(dec != "", F.concat(_code_point(dec.try_cast("bigint")), rest))
            .when(hexa != "", F.concat(_code_point(F.conv(hexa, 16, 10).try_cast("bigint")), rest))
            .when(named.isNotNull(), F.concat(named, rest))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    return F.array_join(F.transform(F.split(_col(text), "&", -1), part), "")


def html_to_text(page: Column | str) -> Column:
    """Visible text; block elements are separated by one space, inline tags vanish."""
    out = _where(lambda t: F.contains(t, F.lit("<")), _drop_tags, _col(page))
    out = _where(lambda t: F.contains(t, F.lit("&")), decode_entities, out)
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def _drop_tags(page: Column) -> Column:
    for pattern, to in ((COMMENT, ""), (SCRIPT, " "), (STYLE, " "), (BLOCK_TAG, " "), (ANY_TAG, "")):
        page = F.regexp_replace(page, pattern, to)
    return page


def clean_all(text: Column | str) -> Column:
    """The whole chain, in its fixed order, as one expression. ASCII texts skip the steps that cannot touch them."""
    out = html_to_text(_where(lambda t: ~is_ascii(t), unbold, _col(text)))

    def beyond_ascii(t: Column) -> Column:
        plain = F.when(t.rlike(RARE), plain_quotes(strip(drop_emoji(unitalic(t))))).otherwise(strip(t))
        return ascii_only(plain)

    out = let(out, lambda t: F.when(is_ascii(t), strip(t)).otherwise(beyond_ascii(t)))
    return _where(lambda t: t.rlike(r"https?://|www\."), mask_urls, out)


def words(text: Column | str) -> Column:
    """Runs of letters a-z and digits of the lower-cased text."""
    # (a class of two ranges; Java's matcher is ten times slower on the three of a mixed-case class)
    return F.filter(F.split(F.lower(_col(text)), "[^a-z0-9]+"), lambda w: w != "")


def split_tokens(text: Column | str) -> Column:
    """Pieces between runs of white space."""
    return F.filter(F.split(_col(text), r"[ \t\n\r\f]+"), lambda w: w != "")


def characters(text: Column | str) -> Column:
    return F.split(_col(text), "")


def shorten(text: Column | str, n: int = 30) -> Column:
    return F.concat(F.substring(_col(text), 1, n), F.lit("..."))


def parse_symbols(text: Column | str) -> Column:
    """Comma list, upper case, stripped; an empty text gives an empty list, which filters nothing."""
    return F.filter(F.transform(F.split(F.upper(_col(text)), ","), lambda s: F.trim(s)), lambda s: s != "")
