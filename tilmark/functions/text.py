"""Text normalisation and tokenising as column expressions. White space is Unicode white space, as in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the normal form.
#: Marks that are removed (inclusive ranges).
DIACRITICS = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED))
#: Alef variants, folded to U+0627.
ALEF_VARIANTS = "آأإٱ"
ALEF = "ا"
#: Waw with hamza, folded to waw.
WAW_HAMZA, WAW = "ؤ", "و"
#: Ya without dots, folded to ya.
ALEF_MAQSURA, YA = "ى", "ي"
TATWEEL = "ـ"
END_OF_AYAH = "۝"
#: The characters that Python calls white space (inclusive ranges).
SPACES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

SPACE = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SPACES) + "]"
MARKS = "".join(chr(c) for a, b in DIACRITICS for c in range(a, b + 1))
_FROM = ALEF_VARIANTS + WAW_HAMZA + ALEF_MAQSURA + MARKS + TATWEEL
_TO = ALEF * len(ALEF_VARIANTS) + WAW + YA


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_diacritics(c: Column | str) -> Column:
    return F.translate(_col(c), MARKS, "")


def fold_alef(c: Column | str) -> Column:
    return F.translate(_col(c), ALEF_VARIANTS, ALEF * len(ALEF_VARIANTS))


def fold_waw(c: Column | str) -> Column:
    return F.translate(_col(c), WAW_HAMZA, WAW)


def fold_ya(c: Column | str) -> Column:
    return F.translate(_col(c), ALEF_MAQSURA, YA)


def strip_tatweel(c: Column | str) -> Column:
    return F.translate(_col(c), TATWEEL, "")


def collapse_ws(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def normalise(c: Column | str) -> Column:
    """The normal form: folds and removals in one pass (no fold makes a character that another step reads), then white
    space."""
    return collapse_ws(F.translate(_col(c), _FROM, _TO))


def py_strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def tokenise(c: Column | str) -> Column:
    """Words between white space; no empty words."""
    return F.filter(F.split(_col(c), f"{SPACE}+"), lambda w: w != "")


def strip_end_of_ayah(c: Column | str) -> Column:
    return py_strip(F.translate(_col(c), END_OF_AYAH, ""))


def remove_spaces(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(" "), F.lit(""))
