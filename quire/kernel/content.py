"""Content streams as operator rows."""

from __future__ import annotations

from typing import Any, NamedTuple

from quire.kernel.cos import ARRAY_OPEN, DICT_OPEN, END, MISSING, Keyword, Lexer, Name, is_string, parse_value


class Op(NamedTuple):
    op: str
    operands: list[Any]
    data: bytes | None = None  # of an inline image


#: Keyword -> how operands are read: n numbers, N all numbers, x name, s string, * as they are, - none.
#: Fixed by the page description language.
SHAPES: dict[str, str] = {
    "q": "-", "Q": "-", "cm": "nnnnnn", "w": "n", "J": "n", "j": "n", "M": "n", "d": "*", "ri": "x", "i": "n", "gs": "x",
    "m": "nn", "l": "nn", "c": "nnnnnn", "v": "nnnn", "y": "nnnn", "h": "-", "re": "nnnn",
    "S": "-", "s": "-", "f": "-", "F": "-", "f*": "-", "B": "-", "B*": "-", "b": "-", "b*": "-", "n": "-", "W": "-", "W*": "-",
    "BT": "-", "ET": "-", "Tc": "n", "Tw": "n", "Tz": "n", "TL": "n", "Tf": "xn", "Tr": "n", "Ts": "n",
    "Td": "nn", "TD": "nn", "Tm": "nnnnnn", "T*": "-", "Tj": "s", "TJ": "*", "'": "s", '"': "nns",
    "CS": "x", "cs": "x", "SC": "N", "SCN": "N", "sc": "N", "scn": "N", "G": "n", "g": "n", "RG": "nnn", "rg": "nnn", "K": "nnnn", "k": "nnnn",
    "Do": "x", "sh": "x", "MP": "x", "DP": "x*", "BMC": "x", "BDC": "x*", "EMC": "-", "BX": "-", "EX": "-",
}

#: Short keys of inline images, fixed by the page description language.
INLINE_KEYS = {b"BPC": b"BitsPerComponent", b"CS": b"ColorSpace", b"D": b"Decode", b"DP": b"DecodeParms", b"F": b"Filter", b"H": b"Height", b"IM": b"ImageMask", b"I": b"Interpolate", b"W": b"Width"}

_BLANK = b" \t\n\r\x0c\x00"
_ENDS = frozenset(_BLANK + b"()<>[]{}/%")


def number(operands: list, i: int) -> float:
    v = operands[i] if i < len(operands) else None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else 0.0


def name(operands: list, i: int) -> bytes:
    v = operands[i] if i < len(operands) else None
    return bytes(v) if isinstance(v, Name) else b""


def string(operands: list, i: int) -> bytes:
    v = operands[i] if i < len(operands) else None
    return v if is_string(v) else b""


def parse_content(data: bytes) -> list[Op]:
    """All operators in order; a lexer fault spoils the whole stream."""
    lex, out, stack = Lexer(data), [], []
    while True:
        at = lex.skip()
        if data[at : at + 2] == b"BI" and (at + 2 >= len(data) or data[at + 2] in _ENDS):
            lex.pos = at + 2
            out.append(_inline_image(lex))
            stack = []
            continue
        t = lex.token()
        if t is END:
            return out
        if isinstance(t, Keyword):
            word = t.decode("latin-1")
            six = SHAPES.get(word) == "nnnnnn" and word in ("cm", "Tm") and len(stack) < 6
            out.append(Op("?" + word if six or word not in SHAPES else word, stack))
            stack = []
        elif t is ARRAY_OPEN or t is DICT_OPEN:
            lex.pos = at
            value = parse_value(lex)
            if value is not MISSING:
                stack.append(value)
        elif isinstance(t, (int, float, bytes)):
            stack.append(t)


def _inline_image(lex: Lexer) -> Op:
    data, head = lex.data, {}
    while True:
        at = lex.skip()
        if at >= len(data):
            break
        if data[at : at + 2] == b"ID":
            lex.pos = min(at + 3, len(data))
            break
        key = lex.token()
        if not isinstance(key, Name):
            break
        value = parse_value(lex)
        if value is MISSING:
            break
        head[INLINE_KEYS.get(bytes(key), bytes(key))] = value
    start = end = lex.pos
    while True:
        end = data.find(b"EI", end)
        if end < 0:
            end = len(data)
            break
        # The mark stands after white space and before white space or a delimiter.
        if (end == start or data[end - 1] in _BLANK) and end + 2 < len(data) and data[end + 2] in _ENDS:
            break
        end += 1
    lex.pos = min(end + 2, len(data))
    return Op("BI", [head], data[start:end].rstrip(_BLANK))


def columns(op: Op) -> tuple[list[float], list[bytes], list[bytes], Any]:
    """(numbers, names, strings, properties) of an operator by its shape, absent operands as 0 or empty."""
    shape, stack = SHAPES.get(op.op, "*"), op.operands
    nums: list[float] = []
    names: list[bytes] = []
    strs: list[bytes] = []
    props: Any = None
    if op.op == "BI":
        return nums, names, strs, stack[0]
    if op.op == "TJ":
        items = stack[0] if stack and isinstance(stack[0], list) else []
        return [float(v) for v in items if isinstance(v, (int, float)) and not isinstance(v, bool)], names, [v for v in items if is_string(v)], items
    if op.op == "d":
        dash = stack[0] if stack and isinstance(stack[0], list) else []
        return [*(number(dash, i) for i in range(len(dash))), number(stack, 1)], names, strs, None
    if op.op.startswith("?"):
        return [number(stack, i) for i, v in enumerate(stack) if isinstance(v, (int, float))], [bytes(v) for v in stack if isinstance(v, Name)], [v for v in stack if is_string(v)], stack
    if shape == "N":
        return [number(stack, i) for i, v in enumerate(stack) if isinstance(v, (int, float))], [bytes(v) for v in stack if isinstance(v, Name)], strs, None
    for i, kind in enumerate(shape):
        if kind == "n":
            nums.append(number(stack, i))
        elif kind == "x":
            names.append(name(stack, i))
        elif kind == "s":
            strs.append(string(stack, i))
        elif kind == "*" and i < len(stack):
            props = stack[i]
    return nums, names, strs, props


def graphics_depths(ops: list[Op]) -> list[int]:
    """Saved states after each operator; a restore without a save does nothing."""
    depth, out = 0, []
    for op in ops:
        depth = depth + 1 if op.op == "q" else max(0, depth - 1) if op.op == "Q" else depth
        out.append(depth)
    return out


