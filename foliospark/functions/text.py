"""Scalar text functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"

# Marks that open a list item.
BULLETS = "-*•‣▪–—"

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ﬓ": "մն", "ﬔ": "մե", "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ"}

# Numeral letters by value, largest first.
ROMAN_VALUES = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def squeeze(c: Column) -> Column:
    """Runs of blanks as one, none at the edges."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalised(c: Column) -> Column:
    """Text for comparison: no controls, one blank between words, lower case."""
    return F.lower(squeeze(F.regexp_replace(c, r"[\x00-\x08\x0e-\x1f\x7f\r]", "")))


def similarity(a: Column, b: Column, cap: int = 10_000) -> Column:
    """1 minus the edit distance over the longer length; two empty texts are equal."""
    a, b = F.substring(a, 1, cap), F.substring(b, 1, cap)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def furniture_key(c: Column) -> Column:
    """The key under which running heads repeat: numbers and whole-line numerals become '#'."""
    key = F.regexp_replace(F.lower(squeeze(c)), "[0-9]+", "#")
    return F.when(key.rlike(ROMAN) & (key != ""), F.lit("#")).otherwise(key)


def item_marker(c: Column) -> Column:
    """The mark or number that opens a list item, '' if none does."""
    return F.regexp_extract(c, rf"^([{BULLETS}]|[0-9]{{1,9}}[.)]) ", 1)


def item_text(c: Column) -> Column:
    """A list item without its marker."""
    return F.trim(F.regexp_replace(c, rf"^([{BULLETS}]|[0-9]{{1,9}}[.)]) ", ""))


def typed_number(c: Column) -> Column:
    """The number a table cell shows: currency signs and thousands commas dropped, '%' a hundredth, '(n)' negative."""
    plain = F.regexp_replace(F.trim(c), "[$€£¥,]", "")
    percent, negative = plain.endswith("%"), plain.rlike(r"^\(.*\)$")
    core = F.trim(F.regexp_replace(plain, r"^\(|\)$|%$", ""))
    value = F.when(core.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), core.try_cast("double"))
    return F.when(percent, value / 100).when(negative, -value).otherwise(value)


def is_numeric_token(c: Column) -> Column:
    """Whether a token is a number, brackets, daggers, commas and signs aside."""
    core = F.regexp_replace(c, r"[()\[\]†‡*,%±]", "")
    return core.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")


def fold_ligatures(c: Column) -> Column:
    for sign, letters in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return c


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a positive number, else the number in digits."""
    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("text"))
    step = lambda s, v: F.struct(
        (s["left"] % v["value"]).cast("int").alias("left"), F.concat(s["text"], F.repeat(v["sign"], F.floor(s["left"] / v["value"]).cast("int"))).alias("text")
    )
    values = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(s).alias("sign")) for v, s in ROMAN_VALUES])
    return F.when(n >= 1, F.aggregate(values, start, step)["text"]).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """a to z, then aa, bb and so on."""
    return F.repeat(F.char((F.lit(97) + (n - 1) % 26).cast("int")), (F.floor((n - 1) / 26) + 1).cast("int"))


def page_label(n: Column, style: Column, prefix: Column) -> Column:
    """A page label: prefix and the number as decimal, roman (r, R) or letters (a, A)."""
    body = (
        F.when(style == "r", roman(n))
        .when(style == "R", F.upper(roman(n)))
        .when(style == "a", letters(n))
        .when(style == "A", F.upper(letters(n)))
        .otherwise(n.cast("string"))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), body)


def escape_url(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def escape_markdown(c: Column) -> Column:
    """Text whose first sign would read as markup, escaped."""
    return F.regexp_replace(c, r"^([#<>+*-]|[0-9]+(?=[.)] ))", r"\\$1")


def fence(c: Column) -> Column:
    """The code fence that is longer than any run of backticks in the text."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), 1), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def plain_number(c: Column) -> Column:
    """A double as text: null if not finite, whole numbers without fraction."""
    finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(finite & whole, c.cast("bigint").cast("string")).when(finite, c.cast("string"))


def coerced(c: Column) -> Column:
    """A form value as ``struct<type, value>``: null, boolean, number or text."""
    t = F.trim(c)
    number = t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    kind = (
        F.when(c.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false", "0", "1") & (F.lower(t) == t), "boolean").when(number, "number").otherwise("text")
    )
    value = (
        F.when(kind == "null", None)
        .when(kind == "boolean", F.when(t.isin("true", "1"), "true").otherwise("false"))
        .when(kind == "number", plain_number(t.try_cast("double")))
        .otherwise(c)
    )
    return F.struct(kind.alias("type"), value.alias("value"))


# Signs of a message that count, the mark for the rest, and the parts of
# messages that vary with their placeholders, in the order in which they are put in.
MESSAGE_SIGNS, MESSAGE_MORE = 120, "..."
PLACEHOLDERS = (
    (r"[0-9]+ 0 R", "{obj} 0 R"),
    (r"(?i)(offset|position|index|page|object)\s+[0-9]+", "$1 {N}"),
    (r"0x[0-9a-fA-F]+", "{hex}"),
    (r"/[\w/.-]+\.pdf", "{path}"),
)


def error_pattern(c: Column) -> Column:
    """An error message with its variable parts replaced; long messages are cut first."""
    head = F.when(F.length(c) > MESSAGE_SIGNS, F.concat(F.left(c, F.lit(MESSAGE_SIGNS)), F.lit(MESSAGE_MORE))).otherwise(c)
    return reduce(lambda text, part: F.regexp_replace(text, *part), PLACEHOLDERS, head)


def pdf_date(c: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+HH'mm'`` as epoch seconds; missing parts take their lowest value."""
    part = lambda i, low: F.when(F.regexp_extract(c, _PDF_DATE, i) == "", F.lit(low)).otherwise(F.regexp_extract(c, _PDF_DATE, i).try_cast("int"))
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", part(1, 0), part(2, 1), part(3, 1)), "yyyy-MM-dd")
    seconds = F.unix_date(day).cast("bigint") * 86400 + part(4, 0) * 3600 + part(5, 0) * 60 + part(6, 0)
    sign = F.when(F.regexp_extract(c, _PDF_DATE, 7) == "-", -1).when(F.regexp_extract(c, _PDF_DATE, 7) == "+", 1).otherwise(0)
    return F.when(c.rlike(_PDF_DATE), seconds - sign * (part(8, 0) * 3600 + part(9, 0) * 60))


_PDF_DATE = r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:([Z+-])([0-9]{2})?'?([0-9]{2})?'?)?$"


def wrap(c: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` signs as an array; words are never split."""
    words = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("line"), F.array().cast("array<string>").alias("lines"))
    step = lambda s, w: F.when(s["line"] == "", F.struct(w.alias("line"), s["lines"].alias("lines"))).when(
        F.length(s["line"]) + 1 + F.length(w) <= width, F.struct(F.concat_ws(" ", s["line"], w).alias("line"), s["lines"].alias("lines"))
    ).otherwise(F.struct(w.alias("line"), F.array_append(s["lines"], s["line"]).alias("lines")))
    return F.aggregate(words, start, step, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.array_append(s["lines"], s["line"])))


def wrap_text(c: Column, width: int) -> Column:
    """Lines of at most ``width`` signs of all paragraphs of a text, each on lines of its own; blank lines stay."""
    wrapped = F.transform(F.split(c, "\n"), lambda p: wrap(p, width))
    lines = F.flatten(F.transform(wrapped, lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(w)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(lines)


def flag(bits: Column, position: int) -> Column:
    """Whether the bit at ``position`` (from 1) is set."""
    return bits.bitwiseAND(F.lit(1 << (position - 1))) != 0


def entropy(weights: Column) -> Column:
    """Entropy of an array of weights, from 0 (one choice) to 1 (all alike)."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(weights, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
    return F.when(F.size(weights) < 2, F.lit(0.0)).otherwise(spread / F.log(F.size(weights)))


def is_year(c: Column) -> Column:
    """Whether a token is a year of the last or this century, signs around it aside."""
    return c.rlike(r"^[(\[]?(19|20)[0-9]{2}[)\],;:.]?$")


def has_letters(c: Column) -> Column:
    """Whether a token has three letters or more."""
    return c.rlike(r"\p{L}.*\p{L}.*\p{L}")


def is_upper(c: Column) -> Column:
    """Whether a token has capitals and no small letters."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def has_leader(c: Column) -> Column:
    """Whether a token leads to another with a run of dots."""
    return c.rlike(r"\.{3,}|…|(\. ){3,}")


def is_line_number(c: Column) -> Column:
    """Whether a token is a short number with at most a letter after it."""
    return c.rlike(r"^[(\[]?[0-9]{1,3}[a-z]?[)\].:]?$")


def edge_spaces(c: Column) -> Column:
    """A text as ``lead``, ``core`` and ``trail``: blanks before it, itself, blanks after it."""
    core = F.regexp_replace(c, r"\A\s+|\s+\z", "")
    lead = F.regexp_extract(c, r"\A\s*", 0)
    return F.struct(lead.alias("lead"), core.alias("core"), F.substr(c, F.length(lead) + F.length(core) + 1).alias("trail"))


def escape_run(c: Column, styled: bool = False, linked: bool = False) -> Column:
    """Text of a run for Markdown: backslashes, marks of style in styled runs and brackets in linked ones are escaped."""
    signs = "\\\\" + ("*~" if styled else "") + (r"\[\]" if linked else "")
    return F.regexp_replace(c, f"([{signs}])", r"\\$1")


def normal_code(c: Column) -> Column:
    """Code in one line: line ends are blanks; one blank goes from both edges if both have one."""
    flat = F.regexp_replace(c, r"\r\n|[\r\n]", " ")
    framed = flat.startswith(" ") & flat.endswith(" ") & (F.trim(flat) != "")
    return F.when(framed, F.substr(flat, F.lit(2), F.length(flat) - 2)).otherwise(flat)


def cluster_id(*parts: Column) -> Column:
    """A stable identifier of the parts of a cluster; null parts count as empty."""
    return F.lower(F.hex(F.xxhash64(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


# Narrow and wide elements of the signs of Code 39.
CODE_39 = {
    "0": "nnnwwnwnn", "1": "wnnwnnnnw", "2": "nnwwnnnnw", "3": "wnwwnnnnn", "4": "nnnwwnnnw", "5": "wnnwwnnnn", "6": "nnwwwnnnn", "7": "nnnwnnwnw", "8": "wnnwnnwnn", "9": "nnwwnnwnn",
    "A": "wnnnnwnnw", "B": "nnwnnwnnw", "C": "wnwnnwnnn", "D": "nnnnwwnnw", "E": "wnnnwwnnn", "F": "nnwnwwnnn", "G": "nnnnnwwnw", "H": "wnnnnwwnn", "I": "nnwnnwwnn", "J": "nnnnwwwnn",
    "K": "wnnnnnnww", "L": "nnwnnnnww", "M": "wnwnnnnwn", "N": "nnnnwnnww", "O": "wnnnwnnwn", "P": "nnwnwnnwn", "Q": "nnnnnnwww", "R": "wnnnnnwwn", "S": "nnwnnnwwn", "T": "nnnnwnwwn",
    "U": "wwnnnnnnw", "V": "nwwnnnnnw", "W": "wwwnnnnnn", "X": "nwnnwnnnw", "Y": "wwnnwnnnn", "Z": "nwwnwnnnn", "-": "nwnnnnwnw", ".": "wwnnnnwnn", " ": "nwwnnnwnn",
    "$": "nwnwnwnnn", "/": "nwnwnnnwn", "+": "nwnnnwnwn", "%": "nnnwnwnwn", "*": "nwnnwnwnn",
}


def code39(c: Column) -> Column:
    """The bars of a text between start and stop signs, a narrow gap between signs; null if a sign has none."""
    known = F.create_map(*[F.lit(x) for pair in CODE_39.items() if pair[0] != "*" for x in pair])
    bars = F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: F.element_at(known, s))
    edge = F.lit(CODE_39["*"])
    return F.when(~F.exists(bars, lambda b: b.isNull()), F.array_join(F.concat(F.array(edge), bars, F.array(edge)), "n"))


def text_width(c: Column, advances: dict[str, float], other: float, spacing: float = 0.0) -> Column:
    """Width of a text: the advances of its signs, ``other`` for those not listed, and the spacing between them."""
    known = F.create_map(*[F.lit(x) for pair in advances.items() for x in pair])
    signs = F.filter(F.split(c, ""), lambda s: s != "")
    total = F.aggregate(signs, F.lit(0.0), lambda w, s: w + F.coalesce(F.element_at(known, s), F.lit(other)))
    return F.round(total + spacing * F.greatest(F.size(signs) - 1, F.lit(0)), 6)


def file_digest_matches(content: Column, digest: Column) -> Column:
    """Whether content has a SHA-256 digest, however that is written; null content has none."""
    return F.coalesce(F.sha2(content, 256) == F.lower(F.trim(digest)), F.lit(False))
