"""Font style flags from the font name and span flag bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference rule set): substrings looked for in the
# lower-case font name.
SERIF = ["times", "cambria", "garamond", "georgia", "serif", "bookman"]
SANS_SERIF = ["arial", "helvetica", "calibri", "verdana", "sans", "roboto", "futura"]
MONOSPACE = ["courier", "consolas", "mono", "fixed", "source code"]
SCRIPT = ["script", "hand", "comic", "cursive", "brush", "calligraph"]
SYMBOL = ["symbol", "wingdings", "dingbat", "zapf"]
DISPLAY = ["impact", "broadway", "jokerman", "stencil", "cooper"]
LIGHT = ["light", "thin", "hair", "extra light"]
BLACK = ["black", "ultra", "extra bold"]
CONDENSED = ["condensed", "narrow", "compressed"]
EXPANDED = ["expanded", "extended", "wide"]
# Flag bits: 16 bold, 2 italic, 8 "underline", 32 "strike-through".
FLAG_BOLD, FLAG_ITALIC, FLAG_UNDERLINE, FLAG_STRIKE = 16, 2, 8, 32


def _any(name: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        t = name.contains(w)
        out = t if out is None else (out | t)
    return out


def bit(flags: Column, mask: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(mask) != 0


def font_styles(font: Column, flags: Column, lowered: bool = False) -> dict[str, Column]:
    """Style flags of one span; mutual exclusions applied (light clears
    regular, black clears bold, oblique clears italic). ``lowered``: the
    font column is already lower-case (computed once per row)."""
    name = font if lowered else F.lower(F.coalesce(font, F.lit("")))
    light = _any(name, LIGHT)
    black = _any(name, BLACK)
    oblique = name.contains("oblique")
    bold = (name.contains("bold") | name.contains("heavy") | bit(flags, FLAG_BOLD)) & ~black
    italic = (name.contains("italic") | bit(flags, FLAG_ITALIC)) & ~oblique
    regular = (name.contains("regular") | ~(name.contains("bold") | name.contains("light") | name.contains("black"))) & ~light
    return {
        "is_bold": bold,
        "is_italic": italic,
        "is_serif": _any(name, SERIF),
        "is_sans_serif": _any(name, SANS_SERIF),
        "is_monospace": _any(name, MONOSPACE),
        "is_script": _any(name, SCRIPT),
        "is_symbol": _any(name, SYMBOL),
        "is_display": _any(name, DISPLAY),
        "is_light": light,
        "is_black": black,
        "is_condensed": _any(name, CONDENSED),
        "is_expanded": _any(name, EXPANDED),
        "is_regular": regular,
        "is_oblique": oblique,
    }
