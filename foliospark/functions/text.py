"""Text scalars, as Catalyst expressions unless Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_BREAK = "\r\n|\r|\n"


def lines_of(text: Column) -> Column:
    """Lines without a trailing empty one; null for null."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def collapsed(text: Column) -> Column:
    """Runs of blanks as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\u00A0\u3000]+", " "))


def compact_length(text: Column) -> Column:
    """Characters that are not blank."""
    return F.length(F.regexp_replace(text, r"[\s\u00A0\u3000]+", ""))


def word_count(text: Column) -> Column:
    """CJK characters plus Latin words."""
    return F.regexp_count(text, F.lit("[\u4e00-\u9fff]")) + F.regexp_count(text, F.lit("[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)*"))


def keyword_tokens(text: Column) -> Column:
    """Latin words, numbers and single CJK characters."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_+-]*|[0-9]+(?:[.][0-9]+)?|[\u4e00-\u9fff]"), F.lit(0))


def keyword_pile(text: Column) -> Column:
    """Long text made of few distinct tokens: 200 or more, and at most 30 distinct or under 8 hundredths.

    The tokens are bound to a lambda's variable, so that they are extracted once.
    """
    sized = F.transform(F.array(keyword_tokens(text)), lambda t: F.struct(F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("d")))
    piled = F.transform(sized, lambda s: (s["n"] >= 200) & ((s["d"] <= 30) | (100 * s["d"] < 8 * s["n"])))
    return (F.length(text) >= 200) & piled[0]


def slug(title: Column) -> Column:
    """Heading slug of a title that is already normalised: lower case, word characters, dashes for blanks."""
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.trim(kept), r"[\s-]+", "-")


def heading_anchor(title: Column) -> Column:
    """The anchor of the heading check: lower case, one space for blanks, closing brackets gone."""
    return F.regexp_replace(F.lower(collapsed(title)), r"\]", "")


def unescaped(text: Column) -> Column:
    """Backslash escapes of ASCII punctuation resolved."""
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def table_cell(text: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.replace(F.replace(collapsed(text), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def human_size(size: Column) -> Column:
    """Bytes with a unit of 1024."""
    shown = lambda name, unit: F.format_string(f"%.1f {name}", F.bround(size / unit, 1))  # noqa: E731  ties to even
    out = shown("GiB", 1 << 30)
    for name, unit in (("MiB", 1 << 20), ("KiB", 1 << 10)):
        out = F.when(size < unit * 1024, shown(name, unit)).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


#: Device names that a file may not have.
RESERVED_NAMES = ["con", "prn", "aux", "nul", *(f"{x}{n}" for x in ("com", "lpt") for n in range(1, 10))]


def safe_name(name: Column, limit: int = 80) -> Column:
    """A portable file name: no separators or control characters, at most ``limit`` characters."""
    clean = F.regexp_replace(collapsed(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', " ")), r"[. ]+$", "")
    cut = F.regexp_replace(F.substring(clean, 1, limit), r"[. ]+$", "")
    return F.when(cut == "", "untitled").when(F.lower(cut).isin(RESERVED_NAMES), F.concat(F.lit("_"), cut)).otherwise(cut)


def valid_date(value: Column, today: Column) -> Column:
    """An ISO date that exists and is not in the future; ``today`` is an argument for repeatable runs."""
    return F.coalesce(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.try_to_date(value, "yyyy-MM-dd") <= today), F.lit(False))


def note_title(text: Column, stem: Column) -> Column:
    """First level-one heading, else the stem."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1)), F.lit("")), stem)


def version_parts(value: Column) -> Column:
    """Leading numbers of a dotted version, comparable as an array."""
    return F.transform(F.split(F.regexp_extract(value, r"^[vV]?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.try_to_number(x, F.lit("9999999")).cast("int"))


def printable_ratio(text: Column) -> Column:
    """Share of characters that are not control or replacement characters."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]", "")) / F.length(text))


def holds(text: Column, parts: list[str]) -> Column:
    """Whether one of the parts stands in the text; a pattern of as many branches tries all of them at every character."""
    return reduce(or_, (F.contains(text, F.lit(part)) for part in parts))


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


#: Digits of Chinese numerals.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def chinese_number(value: Column) -> Column:
    """0 to 99 written in Chinese numerals; null otherwise."""
    digit = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    tens, ones = F.regexp_extract(value, "^(.?)十", 1), F.regexp_extract(value, "十(.?)$", 1)
    one = F.try_element_at(digit, value)
    ten = F.when(tens == "", 1).otherwise(F.try_element_at(digit, tens)) * 10 + F.when(ones == "", 0).otherwise(F.try_element_at(digit, ones))
    return F.when(value.rlike("^.?十.?$"), ten).when(F.length(value) == 1, one)


def indent_columns(line: Column) -> Column:
    """Columns of leading blanks, with tab stops of four."""
    lead = F.split(F.regexp_extract(line, r"^([ \t]*)", 1), "")
    return F.aggregate(lead, F.lit(0), lambda n, c: F.when(c == "\t", (F.floor(n / 4).cast("int") + 1) * 4).when(c == " ", n + 1).otherwise(n))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def stem_key(text: pd.Series) -> pd.Series:
    """Composed and case-folded: stems and archive paths that collide on common file systems."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


@F.pandas_udf(T.DoubleType())
def display_width(text: pd.Series) -> pd.Series:
    """Columns on screen: two for wide and full-width characters, none for combining ones."""
    width = lambda c: 0.0 if unicodedata.combining(c) else 2.0 if unicodedata.east_asian_width(c) in "WF" else 1.0
    return text.map(lambda x: None if x is None else sum(map(width, x)))


def _units(c: str) -> float:
    # Widths of character classes in ems.
    if unicodedata.combining(c):
        return 0.0
    if c.isspace():
        return 0.35
    if unicodedata.east_asian_width(c) in "WF":
        return 1.0
    return 0.9 if c in "MW@%&" else 0.3 if c in "ilI.,:;!|'`" else 0.7 if c.isupper() else 0.58 if c.isdigit() else 0.55


@F.pandas_udf(T.DoubleType())
def title_units(text: pd.Series) -> pd.Series:
    """Estimated width of a slide's title in ems."""
    return text.map(lambda x: None if x is None else sum(map(_units, x)))


# Commands whose doubled backslash is an artefact, and signs with their command.
COMMANDS = (
    "alpha|beta|gamma|delta|epsilon|varepsilon|theta|lambda|mu|pi|rho|sigma|phi|varphi|omega|nabla|frac|sum|prod|sqrt|log|ln|exp|min|max|argmin|argmax|"
    "left|right|mathrm|mathbf|mathcal|mathbb|top|rightarrow|to|le|ge|times|cdot|infty|partial|Vert|lVert|rVert"
)
MATH_SIGNS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "ρ": "rho", "σ": "sigma", "φ": "phi",
    "ω": "omega", "∑": "sum", "∏": "prod", "√": "sqrt", "∇": "nabla", "∂": "partial", "≤": "le", "≥": "ge", "→": "to", "×": "times", "·": "cdot", "∞": "infty",
}
MATH_LINE = r"[$\\=_^≤≥→∑∇∂]"


def slide_line(line: Column, math: bool = False) -> Column:
    """A line of slide text: composed, invisible characters off, backslashes and the blanks before marks repaired; signs as commands in math lines if asked."""
    out = F.regexp_replace(nfkc(line), r"[\u200b-\u200f\u2060\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(F.regexp_replace(out, "[﹨＼]", r"\\"), rf"\\{{2,}}({COMMANDS})\b", r"\\$1")
    out = F.regexp_replace(out, r"(?U)\s+([,.;:，。；：])", "$1")
    if math:
        signs = out
        for sign, command in MATH_SIGNS.items():
            signs = F.replace(signs, F.lit(sign), F.lit("\\" + command))
        out = F.when(out.rlike(MATH_LINE), signs).otherwise(out)
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\\\s+([A-Za-z]+)", r"\\$1"), r"(?U)\s+$", "")


def compact_slide(text: Column) -> Column:
    """Lines of slide text that ``slide_line`` cleaned, joined by line ends: at most two blank ones in a run, one line end at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, "\n{4,}", "\n\n\n"), r"(?U)\s+$", ""), F.lit("\n"))
