"""Page markup to text, text normalisation and the text rendering of a job.

The regular expressions are Java's; the SQL that checks them has its own.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters Python's str.isspace accepts, as a regex class body.
SPACE = (
    r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Elements whose whole content is dropped.
RAW_TEXT_TAGS = ("script", "style", "noscript", "svg")
BOILERPLATE_TAGS = ("nav", "footer", "header", "form")
# The named character references that are decoded.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&#34;", '"'),
    ("&nbsp;", " "),
    ("&#160;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
    ("&middot;", "·"),
    ("&bull;", "•"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&euro;", "€"),
    ("&pound;", "£"),
    ("&deg;", "°"),
    ("&times;", "×"),
    ("&eacute;", "é"),
    ("&egrave;", "è"),
    ("&agrave;", "à"),
    ("&ccedil;", "ç"),
    ("&auml;", "ä"),
    ("&ouml;", "ö"),
    ("&uuml;", "ü"),
    ("&szlig;", "ß"),
    ("&ntilde;", "ñ"),
    ("&amp;", "&"),
)
NODE_BREAK = "\u0001"


# All white space and the node break, as characters to trim.
EDGE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + NODE_BREAK


# The rest of a tag: a quoted value may hold ``>``. Possessive, so a long tag needs no stack.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+"""


def _element(tag: str) -> str:
    return rf"{tag}(?:\s{ATTRIBUTES})?>.*?(?:</{tag}\s*>|\z)"


# Comments and elements are matched in one alternation each, so that whichever opens
# first in the page wins, as it does for a parser.
RAW_BLOCKS = "(?is)<(?:!--.*?-->|" + "|".join(_element(t) for t in RAW_TEXT_TAGS) + ")"
HEAD_BLOCKS = rf"(?is)<(?:head(?:\s{ATTRIBUTES})?>.*?</head\s*>|title(?:\s{ATTRIBUTES})?>.*?</title\s*>)"
BOILERPLATE_EDGE = r"(?i)(?=</?(?:" + "|".join(BOILERPLATE_TAGS) + r")[\s/>])"
BOILERPLATE_TAG = r"(?is)^<(/?(?:" + "|".join(BOILERPLATE_TAGS) + rf"))(?:[\s/]{ATTRIBUTES})?>"
MARKUP = rf"<(?:/?[a-zA-Z]|[!?]){ATTRIBUTES}>"
H1_CONTENT = rf"(?is)<h1(?:\s{ATTRIBUTES})?>(.*?)</h1\s*>"
TITLE_CONTENT = rf"(?is)<title(?:\s{ATTRIBUTES})?>(.*?)</title\s*>"


def _numeric_reference(digits: Column) -> Column:
    """The character of ``#233`` or ``#xE9``; null when there is no such character."""
    hexadecimal = F.upper(F.regexp_extract(digits, r"^#[xX]([0-9a-fA-F]{1,6})$", 1))
    decimal = F.hex(F.regexp_extract(digits, r"^#([0-9]{1,7})$", 1).try_cast("bigint"))
    point = F.coalesce(F.nullif(hexadecimal, F.lit("")), decimal)
    number = F.conv(point, 16, 10).try_cast("bigint")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Known and numeric character references decoded, once; others stay as they are."""
    known = F.create_map(*[F.lit(x) for name, char in ENTITIES for x in (name[1:-1], char)])

    def decode_part(part: Column, position: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        char = F.coalesce(
            F.try_element_at(known, name),
            F.when(F.startswith(name, F.lit("#")), _numeric_reference(name)),
        )
        is_reference = (position > 0) & F.contains(part, F.lit(";")) & char.isNotNull()
        plain = F.when(position > 0, F.concat(F.lit("&"), part)).otherwise(part)
        return F.when(is_reference, F.concat(char, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(plain)

    def decode(whole: Column) -> Column:
        decoded = F.array_join(F.transform(F.split(whole, "&"), decode_part), "")
        return F.when(F.contains(whole, F.lit("&")), decoded).otherwise(whole)

    # An item of its own, so that the steps that made the text run once, not once per mention.
    return F.transform(F.array(text), decode)[0]


def _without_raw_blocks(html: Column) -> Column:
    unix = F.when(F.contains(html, F.lit("\r")), F.replace(html, F.lit("\r\n"), F.lit("\n"))).otherwise(html)
    odd = F.contains(unix, F.lit("\r")) | F.contains(unix, F.lit(NODE_BREAK))  # few pages hold either
    plain = F.when(odd, F.translate(unix, "\r" + NODE_BREAK, "\n")).otherwise(unix)
    return F.regexp_replace(plain, RAW_BLOCKS, NODE_BREAK)


def _without_boilerplate(page: Column) -> Column:
    """The page without its dropped elements, however they nest.

    The page is cut before every tag of such an element, and the open ones are carried along:
    an end tag closes the last open element of its name with all inside; one that closes nothing
    is passed over. A piece stays where nothing is open, and only its flag is carried. The tags
    are taken out of the pieces once, before they are followed.
    """

    def tag(piece: Column) -> Column:
        return F.lower(F.regexp_extract(piece, BOILERPLATE_TAG, 1))

    def follow(state: Column, tag: Column) -> Column:
        kind = F.replace(tag, F.lit("/"), F.lit(""))
        closes = F.startswith(tag, F.lit("/"))
        opened = state["opened"]
        depth = F.array_position(F.reverse(opened), kind).cast("int")
        after = (
            F.when(kind == "", opened)
            .when(~closes, F.concat(opened, F.array(kind)))
            .when(depth > 0, F.slice(opened, 1, F.size(opened) - depth))
            .otherwise(opened)
        )
        flag = F.when(F.size(after) == 0, "1").otherwise("0")
        return F.struct(after.alias("opened"), F.concat(state["flags"], flag).alias("flags"))

    def kept(pieces: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("opened"), F.lit("").alias("flags"))
        flags = F.aggregate(F.transform(pieces, tag), start, follow, lambda state: state["flags"])
        shown = F.transform(F.array(flags), lambda f: F.filter(pieces, lambda _, i: F.substr(f, i + 1, F.lit(1)) == "1"))
        return F.array_join(shown[0], "")

    return F.transform(F.array(F.split(page, BOILERPLATE_EDGE)), kept)[0]


def _join_nodes(text: Column, separator: str) -> Column:
    """Text nodes stripped and joined; blank nodes add nothing."""
    edges = F.lit(EDGE_CHARS)
    stripped = F.transform(F.split(text, NODE_BREAK), lambda node: F.btrim(node, edges))
    return F.array_join(F.filter(stripped, lambda node: node != ""), separator)


def html_to_text(html: Column, max_chars: int | None = None) -> Column:
    """Readable text of a page: boilerplate out, one line per text node, spaces collapsed.

    The whole page is cleaned; ``max_chars`` only bounds what is handed on (``None``
    hands on everything).
    """
    text = _without_raw_blocks(html)
    text = F.regexp_replace(text, HEAD_BLOCKS, NODE_BREAK)
    text = _without_boilerplate(text)
    text = F.regexp_replace(text, MARKUP, NODE_BREAK)
    text = _join_nodes(decode_entities(text), "\n")
    # A single space stays as it is, so only longer runs and tabs are looked for.
    text = F.regexp_replace(F.regexp_replace(text, r"(?: [ \t]|\t)[ \t]*+", " "), r"\n{3,}", "\n\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def _inline_text(fragment: Column) -> Column:
    return _join_nodes(decode_entities(F.regexp_replace(fragment, MARKUP, NODE_BREAK)), "")


def html_title(html: Column) -> Column:
    """Text of the first ``<h1>``, else of the first ``<title>``, else null."""
    page = _without_raw_blocks(html)
    return F.coalesce(
        F.nullif(_inline_text(F.regexp_extract(page, H1_CONTENT, 1)), F.lit("")),
        F.nullif(_inline_text(F.regexp_extract(page, TITLE_CONTENT, 1)), F.lit("")),
    )


@lru_cache(maxsize=1)
def casefold_rules() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What full case folding does beyond lower-casing, derived from ``str.casefold``.

    Returns the one-to-one source and target characters and the expanding pairs.
    """
    source, target, expanding = [], [], []
    for point in range(0x80, 0x1_0000):
        char = chr(point)
        folded = char.casefold()
        if char.lower() != char or folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expanding.append((char, folded))
    return "".join(source), "".join(target), tuple(expanding)


def casefold(text: Column) -> Column:
    """Full case folding: what ``str.casefold`` does, for the whole basic plane.

    Lower-casing and ß settle nearly every text; the rest is only looked up in texts that
    hold one of the special characters.
    """
    source, target, expanding = casefold_rules()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    rare = [pair for pair in expanding if pair[0] != "ß"]
    expansions = F.create_map(*[F.lit(x) for pair in rare for x in pair])
    expanded = F.transform(
        F.split(F.translate(low, source, target), ""), lambda c: F.coalesce(F.try_element_at(expansions, c), c)
    )
    found = source + "".join(c for c, _ in rare)
    # One wide range is looked for first: few texts hold anything of it, and the exact class is slow.
    special = F.rlike(low, F.lit(_covering_class(found, 0x1_0000))) & F.rlike(low, F.lit(_covering_class(found)))
    return F.when(special, F.array_join(expanded, "")).otherwise(low)


def _covering_class(characters: str, gap: int = 256) -> str:
    """A regex class of few ranges that holds all the characters (and some between them)."""
    ranges: list[list[int]] = []
    for point in sorted(map(ord, characters)):
        # Latin letters are common: there, name the characters one by one.
        if ranges and point > 0x17F and point - ranges[-1][1] <= gap and ranges[-1][0] >= 0x17F:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ranges) + "]"


NO_WORD = r"[^\p{L}\p{N}_]+"


def normalize(text: Column) -> Column:
    """Case-folded words separated by single spaces; punctuation counts as a space."""
    return F.trim(F.regexp_replace(casefold(text), NO_WORD, " "))


def word_set(text: Column) -> Column:
    """The distinct words of a text, sorted."""
    words = F.split(casefold(text), NO_WORD)
    return F.sort_array(F.array_remove(F.array_distinct(words), ""))


def job_text(
    title: Column,
    company: Column,
    seniority: Column,
    location: Column,
    country: Column,
    remote: Column,
    stack: Column,
    visa: Column,
    summary: Column,
    body: Column | None = None,
) -> Column:
    """The rendering of a job that is embedded: six fixed lines, the summary and, if given, the
    whole text of the posting."""
    or_else = lambda value, fallback: F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))
    return F.concat_ws(
        "\n",
        F.concat(title, F.lit(" at "), company),
        F.concat(F.lit("seniority: "), seniority),
        F.concat(
            F.lit("location: "), or_else(location, "unknown"), F.lit(" ("), or_else(country, "?"), F.lit(")")
        ),
        F.concat(F.lit("remote: "), remote),
        F.concat(F.lit("stack: "), or_else(F.array_join(stack, ", "), "n/a")),
        F.concat(F.lit("visa sponsorship: "), visa),
        F.nullif(summary, F.lit("")),
        F.lit(None).cast("string") if body is None else F.nullif(body, F.lit("")),
    )


def job_text_of(prefix: str = "", body: Column | None = None) -> Column:
    names = (
        "title company seniority location country remote stack visa_sponsorship description_summary"
    ).split()
    return job_text(*[F.col(prefix + name) for name in names], body)
