"""Text clean-up: ids, names, headers, labels."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE) + "]+"

# Texts that mean "no id".
ID_PLACEHOLDERS = ("", "-", "N/A", "NA", "NULL", "NONE")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """FN-01: stripped text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean_cell(c: Column) -> Column:
    """`clean` of a plain column: a text between two printable ASCII characters is taken as it is, without a search."""
    solid = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(solid, c).otherwise(clean(c))


def with_clean(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """Adds clean texts of cells, by their new names.

    A parser looks at its text many times. As columns of their own the texts are
    made once per row; written into the parser they would be made at every look.
    """
    return df.withColumns({name: clean_cell(F.col(f"`{cell}`")) for name, cell in cells.items()})


def clean_text(c: Column, is_clean: bool) -> Column:
    return c if is_clean else clean(c)


def collapse_blanks(c: Column) -> Column:
    """Strip and reduce every run of blanks to one space."""
    return strip(F.regexp_replace(c, _WS_CLASS, " "))


def id_text(c: Column, is_clean: bool = False) -> Column:
    """Id as text with a trailing `.0` dropped; placeholders are kept."""
    text = clean_text(c, is_clean)
    return F.when(text.endswith(".0"), F.regexp_replace(text, r"^([0-9]+)\.0$", "$1")).otherwise(text)


def normalize_id(c: Column, is_clean: bool = False) -> Column:
    """FN-02: id as text; placeholders become NULL; `123.0` becomes `123`."""
    text = id_text(c, is_clean)
    longest = max(len(p) for p in ID_PLACEHOLDERS)
    return F.when((F.length(text) > longest) | ~F.upper(text).isin(*ID_PLACEHOLDERS), text)


def numeric_id(c: Column) -> Column:
    """FN-02 for a source column that is numeric: 12.0 becomes `12`."""
    whole = c.cast("double") == F.floor(c.cast("double"))
    return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def _fold_char(ch: str) -> str:
    decomposed = unicodedata.normalize("NFKD", ch).casefold()
    plain = "".join(x for x in decomposed if not unicodedata.combining(x))
    return re.sub(r"[^a-z0-9]", " ", plain) if plain else ""


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Folding is per character, so it is a lookup built from Unicode's own rules.

    Returns (`translate` source, `translate` target, expansions); characters
    past the end of the target are deleted, as `translate` does.
    """
    one_from, one_to, dropped, expand = [], [], [], {}
    # CJK, Hangul, surrogates and private use never fold to a-z or 0-9.
    for lo, hi in ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000)):
        for cp in range(lo, hi):
            ch = chr(cp)
            folded = _fold_char(ch)
            if folded == "":
                dropped.append(ch)
            elif folded.strip() == "":
                continue
            elif len(folded) == 1:
                one_from.append(ch)
                one_to.append(folded)
            else:
                expand[ch] = folded
    return "".join(one_from + dropped), "".join(one_to), expand


def fold_name(c: Column) -> Column:
    """FN-03: compatibility-decomposed, case-folded, mark-free `[a-z0-9]+` tokens.

    Plain-ASCII names take a short path. Characters that fold to one letter or
    none are translated; of what is left beyond ASCII, each distinct character
    is looked up once per text, and one that folds to several letters is
    replaced in the text as a whole. The lookup is one literal text, written once:
    the driver holds, rewrites and prints each literal of a plan again and again.
    """
    source, target, expand = _fold_tables()
    table = F.str_to_map(F.lit("\x01".join(f"{ch}\x02{to}" for ch, to in expand.items())), F.lit("\x01"), F.lit("\x02"))
    single = F.translate(c, source, target)
    left = F.array_distinct(F.split(F.regexp_replace(single, r"[\x00-\x7f]+", ""), ""))
    looked_up = F.transform(left, lambda ch: F.struct(ch.alias("ch"), F.try_element_at(table, ch).alias("to")))
    several = F.filter(looked_up, lambda x: x["to"].isNotNull())
    wide = F.aggregate(several, single, lambda text, x: F.replace(text, x["ch"], x["to"]))
    folded = F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(wide)
    tokens = F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(tokens), F.lit(""))


def normalize_header(value: object) -> str:
    """FN-04: upper-case `[A-Z0-9]` form of a column header (driver side)."""
    text = unicodedata.normalize("NFKD", "" if value is None else str(value))
    plain = "".join(ch for ch in text if not unicodedata.combining(ch))
    return re.sub(r"[^A-Z0-9]+", "", plain.upper())


def catalog_key(c: Column) -> Column:
    """FN-05: upper-case `[A-Z0-9]` form of a catalog value; accents drop out."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "")


def status_label(c: Column) -> Column:
    """FN-12: status label for exact lookup: folded case, single blanks."""
    folded = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return collapse_blanks(folded)


def keyword(c: Column) -> Column:
    """FN-31: upper case, underscores as blanks, single blanks; NULL when empty."""
    return F.nullif(collapse_blanks(F.replace(F.upper(c), F.lit("_"), F.lit(" "))), F.lit(""))


# Scope suffixes that name a language.
SCOPE_LANGUAGES = ("FR", "VL", "NL", "DE", "EN")


def interval_language(scope: Column, language: Column) -> Column:
    """FN-17: language from the scope's last token, else the row's own language."""
    suffix = F.upper(F.element_at(F.split(F.coalesce(scope, F.lit("")), " "), -1))
    own = F.coalesce(F.upper(clean(language)), F.lit("(blank)"))
    return F.when(suffix.isin(*SCOPE_LANGUAGES), suffix).otherwise(own)


def number(c: Column) -> Column:
    """FN-11: number or NULL."""
    text = clean(c)
    shape = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return F.when(text.rlike(shape), text.try_cast("double"))


def tri_state(c: Column) -> Column:
    """FN-10: TRUE, FALSE or unknown."""
    text = F.upper(strip(c))
    return F.when(text.isin("1", "TRUE", "YES", "Y"), F.lit(True)).when(
        text.isin("0", "FALSE", "NO", "N"), F.lit(False)
    )
