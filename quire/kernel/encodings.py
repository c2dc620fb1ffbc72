"""Byte encodings and glyph names, from codecs and Unicode names where a rule gives them."""

from __future__ import annotations

import unicodedata
from functools import cache

REPLACEMENT = "�"


def _codec(name: str) -> list[str | None]:
    """A single-byte codec; bytes that it leaves out stand for the control character of their number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


#: Where StandardEncoding differs from the Windows code page; bytes that neither has stand as in that page.
_STANDARD = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤",
    0xAC: "ﬁ", 0xAD: "ﬂ", 0xB0: "–", 0xB1: "†", 0xB2: "‡", 0xB3: "·", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”",
    0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘", 0xC7: "˙",
    0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł",
    0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}

#: The font follows the Unicode block of that name in runs: (first byte, last byte, first character).
_DINGBAT_RUNS = [(0x21, 0x7E, 0x2701), (0x80, 0x8D, 0x2768), (0xA1, 0xA7, 0x2761), (0xB1, 0xBA, 0x2460), (0xC0, 0xC9, 0x2776), (0xD1, 0xDA, 0x2780), (0xE1, 0xEA, 0x278A), (0xF1, 0xF1, 0x2794)]
#: Zapf Dingbats outside the runs.
_DINGBATS = {0x20: " ", 0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xF2: "→", 0xF3: "↔", 0xF4: "↕"}

#: The letters of Symbol that are Greek, Latin letter -> Unicode name.
_SYMBOL_GREEK = {
    "A": "ALPHA", "B": "BETA", "C": "CHI", "D": "DELTA", "E": "EPSILON", "F": "PHI", "G": "GAMMA", "H": "ETA", "I": "IOTA", "K": "KAPPA", "L": "LAMDA", "M": "MU",
    "N": "NU", "O": "OMICRON", "P": "PI", "Q": "THETA", "R": "RHO", "S": "SIGMA", "T": "TAU", "U": "UPSILON", "W": "OMEGA", "X": "XI", "Y": "PSI", "Z": "ZETA",
}
#: Characters that Symbol shares with ASCII, and its other characters by byte.
_SYMBOL_ASCII = " !#%&()*+,./0123456789:;<=>?[]_{|}"
_SYMBOL = {
    0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2D: "−", 0x40: "≅", 0x5E: "⊥", 0x7E: "∼", 0xA0: "€", 0xB1: "±", 0xB4: "×",
    0xB5: "∝", 0xB6: "∂", 0xB7: "•", 0xB8: "÷", 0xB9: "≠", 0xBA: "≡", 0xBB: "≈", 0xBC: "…", 0xC0: "ℵ", 0xC1: "ℑ",
    0xC2: "ℜ", 0xC3: "℘", 0xC5: "⊗", 0xC6: "⊕", 0xC7: "∅", 0xC8: "∩", 0xC9: "∪", 0xCA: "⊃", 0xCB: "⊇", 0xCC: "⊄",
    0xCD: "⊂", 0xCE: "⊆", 0xCF: "∈", 0xD0: "∉", 0xD1: "∠", 0xD2: "∇", 0xD5: "∏", 0xD6: "√", 0xE0: "◊", 0xE5: "∑",
    0xF2: "∫", 0xF5: "∞",
}


def win_ansi() -> list[str | None]:
    return _codec("cp1252")


def standard() -> list[str | None]:
    out = win_ansi()
    for b, c in _STANDARD.items():
        out[b] = c
    return out


def zapf_dingbats() -> list[str | None]:
    out: list[str | None] = [None] * 256
    for a, b, first in _DINGBAT_RUNS:
        out[a : b + 1] = [chr(first + i) for i in range(b - a + 1)]
    for b, c in _DINGBATS.items():
        out[b] = c
    return out


def symbol() -> list[str | None]:
    out: list[str | None] = [None] * 256
    for c in _SYMBOL_ASCII:
        out[ord(c)] = c
    for latin, greek in _SYMBOL_GREEK.items():
        out[ord(latin)] = unicodedata.lookup(f"GREEK CAPITAL LETTER {greek}")
        out[ord(latin.lower())] = unicodedata.lookup(f"GREEK SMALL LETTER {greek}")
    for b, c in _SYMBOL.items():
        out[b] = c
    return out


@cache
def _table(name: str) -> tuple[str | None, ...]:
    make = {"MacRomanEncoding": lambda: _codec("mac_roman"), "StandardEncoding": standard, "ZapfDingbatsEncoding": zapf_dingbats, "SymbolEncoding": symbol}.get(name, win_ansi)
    return tuple(make())


def encoding(name: str) -> list[str | None]:
    """256 characters of a named encoding; names that are not known mean the Windows code page."""
    return list(_table(name))


#: Names of the public glyph list without a rule, in the order of their characters.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "section": "§",
    "dieresis": "¨", "copyright": "©", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±",
    "acute": "´", "paragraph": "¶", "periodcentered": "·", "middot": "·", "cedilla": "¸", "guillemotright": "»", "AE": "Æ", "Eth": "Ð",
    "multiply": "×", "Oslash": "Ø", "Thorn": "Þ", "germandbls": "ß", "ae": "æ", "eth": "ð", "divide": "÷", "oslash": "ø", "thorn": "þ",
    "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘",
    "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "sigmafinal": "ς", "endash": "–", "emdash": "—",
    "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†",
    "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "fraction": "⁄", "Euro": "€", "Ifraktur": "ℑ", "weierstrass": "℘",
    "Rfraktur": "ℜ", "trademark": "™", "aleph": "ℵ", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "arrowboth": "↔",
    "universal": "∀", "partialdiff": "∂", "existential": "∃", "emptyset": "∅", "nabla": "∇", "gradient": "∇", "element": "∈", "notelement": "∉",
    "product": "∏", "summation": "∑", "radical": "√", "proportional": "∝", "infinity": "∞", "angle": "∠", "logicaland": "∧", "logicalor": "∨",
    "intersection": "∩", "union": "∪", "integral": "∫", "therefore": "∴", "because": "∵", "approxequal": "≈", "notequal": "≠", "equivalence": "≡",
    "lessequal": "≤", "greaterequal": "≥", "propersubset": "⊂", "subset": "⊂", "propersuperset": "⊃", "superset": "⊃", "reflexsubset": "⊆",
    "reflexsuperset": "⊇", "circleplus": "⊕", "circlemultiply": "⊗", "perpendicular": "⊥", "star": "⋆", "filledbox": "■", "blacksquare": "■",
    "triagup": "▲", "triagdn": "▼", "blackdiamond": "◆", "lozenge": "◊", "circle": "○", "blackcircle": "●", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ",
    "ffi": "ﬃ", "ffl": "ﬄ",
}
#: Names that the public list lacks, or maps to another character, in the order of their characters.
_OTHER_GLYPHS = {
    "nbspace": " ", "minus": "-", "hyphenchar": "-", "guilsinglleft": "«", "neg": "¬", "pilcrow": "¶", "dotmath": "·", "cdot": "·",
    "guilsinglright": "»", "times": "×", "varepsilon": "ε", "varsigma": "ς", "varphi": "φ", "vartheta": "ϑ", "varpi": "ϖ", "grave": "‘", "Im": "ℑ",
    "wp": "℘", "Re": "ℜ", "leftarrow": "←", "uparrow": "↑", "rightarrow": "→", "downarrow": "↓", "leftrightarrow": "↔", "Arrowleft": "⇐",
    "Leftarrow": "⇐", "Arrowright": "⇒", "Rightarrow": "⇒", "Arrowboth": "⇔", "Leftrightarrow": "⇔", "forall": "∀", "partial": "∂", "exists": "∃",
    "in": "∈", "notin": "∉", "minusmath": "−", "sqrt": "√", "propto": "∝", "wedge": "∧", "vee": "∨", "cap": "∩", "cup": "∪", "approx": "≈",
    "equiv": "≡", "leq": "≤", "geq": "≥", "subseteq": "⊆", "supseteq": "⊇", "oplus": "⊕", "otimes": "⊗", "perp": "⊥", "openbox": "□", "square": "□",
    "diamond": "◆", "opendiamond": "◇", "opencircle": "○", "filledcircle": "●",
}

_MARKS = {"̀": "grave", "́": "acute", "̂": "circumflex", "̃": "tilde", "̈": "dieresis", "̊": "ring", "̧": "cedilla", "̌": "caron"}


@cache
def _glyphs() -> dict[str, str]:
    out = _GLYPHS | _OTHER_GLYPHS
    for i, word in enumerate("zero one two three four five six seven eight nine".split()):
        out[word] = str(i)
    # Accented letters are named letter + mark; the ones of Latin-1 and four beyond it are known.
    for code in [*range(0xC0, 0x100), 0x160, 0x161, 0x178, 0x17D, 0x17E]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2:
            out[parts[0] + _MARKS[parts[1]]] = chr(code)
    for code in [*range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA)]:
        word = unicodedata.name(chr(code)).rsplit(" ", 1)[1].lower().replace("lamda", "lambda")
        out[word], out[word.title()] = chr(code), chr(code).upper()
    return out


def _code_point(digits: str) -> str | None:
    try:
        code = int(digits, 16)
        return None if 0xD800 <= code < 0xE000 else chr(code)
    except (ValueError, OverflowError):
        return None


def glyph_text(name: str) -> str:
    """The text of a glyph name; a name that is not known stands for itself."""
    got = _glyphs().get(name)
    if got is None and name.startswith("uni") and len(name) == 7:
        got = _code_point(name[3:])
    if got is None and name.startswith("u") and len(name) >= 5:
        got = _code_point(name[1:])
    return name if got is None else got


#: The default width of each standard font, in thousandths of the text size.
STANDARD_14 = {
    "Courier": 600.0, "Courier-Bold": 600.0, "Courier-Oblique": 600.0, "Courier-BoldOblique": 600.0,
    "Helvetica": 278.0, "Helvetica-Bold": 278.0, "Helvetica-Oblique": 278.0, "Helvetica-BoldOblique": 278.0,
    "Times-Roman": 250.0, "Times-Bold": 250.0, "Times-Italic": 250.0, "Times-BoldItalic": 250.0, "Symbol": 250.0, "ZapfDingbats": 278.0,
}
