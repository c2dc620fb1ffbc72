"""The graphics state along a content stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from quire.kernel.content import Op, name, number

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """Row vectors: m first, then n."""
    a, b, c, d, h, v = m
    e, f, g, k, x, y = n
    return a * e + b * g, a * f + b * k, c * e + d * g, c * f + d * k, h * e + v * g + x, h * f + v * k + y


@dataclass(frozen=True)
class State:
    """What painting depends on, with the values that a page begins with."""

    ctm: tuple[float, ...] = IDENTITY
    line_width: float = 1.0
    line_cap: int = 0
    line_join: int = 0
    miter_limit: float = 10.0
    dash: tuple[float, ...] = ()
    dash_phase: float = 0.0
    rendering_intent: str = "RelativeColorimetric"
    flatness: float = 1.0
    stroke_space: str = "DeviceGray"
    fill_space: str = "DeviceGray"
    stroke_color: tuple[float, ...] = (0.0,)
    fill_color: tuple[float, ...] = (0.0,)
    stroke_opacity: float = 1.0
    fill_opacity: float = 1.0
    ext_state: str | None = None
    char_spacing: float = 0.0
    word_spacing: float = 0.0
    horizontal_scaling: float = 100.0
    leading: float = 0.0
    font: str | None = None
    font_size: float = 0.0
    render_mode: int = 0
    rise: float = 0.0


@dataclass
class Stack:
    """Saved states; a restore without a save does nothing."""

    current: State = State()
    saved: list[State] = field(default_factory=list)

    @property
    def depth(self) -> int:
        return len(self.saved)

    def save(self) -> None:
        self.saved.append(self.current)

    def restore(self) -> None:
        if self.saved:
            self.current = self.saved.pop()

    def set(self, **changes: Any) -> None:
        self.current = replace(self.current, **changes)


_NUMBERS = {"w": "line_width", "M": "miter_limit", "i": "flatness", "Tc": "char_spacing", "Tw": "word_spacing", "Tz": "horizontal_scaling", "TL": "leading", "Ts": "rise"}
_WHOLE = {"J": "line_cap", "j": "line_join", "Tr": "render_mode"}
_COLORS = {"G": ("stroke", "DeviceGray", 1), "g": ("fill", "DeviceGray", 1), "RG": ("stroke", "DeviceRGB", 3), "rg": ("fill", "DeviceRGB", 3), "K": ("stroke", "DeviceCMYK", 4), "k": ("fill", "DeviceCMYK", 4)}


def apply(stack: Stack, op: Op) -> None:
    args = op.operands
    text = lambda i: name(args, i).decode("utf-8", "replace")
    if op.op == "q":
        stack.save()
    elif op.op == "Q":
        stack.restore()
    elif op.op == "cm":
        stack.set(ctm=product(tuple(number(args, i) for i in range(6)), stack.current.ctm))
    elif op.op in _NUMBERS:
        stack.set(**{_NUMBERS[op.op]: number(args, 0)})
    elif op.op in _WHOLE:
        stack.set(**{_WHOLE[op.op]: int(max(-(2.0**31), min(2.0**31 - 1, number(args, 0))))})
    elif op.op == "d":
        lengths = args[0] if args and isinstance(args[0], list) else []
        stack.set(dash=tuple(number(lengths, i) for i in range(len(lengths))), dash_phase=number(args, 1))
    elif op.op == "ri":
        stack.set(rendering_intent=text(0))
    elif op.op == "gs":
        stack.set(ext_state=text(0))
    elif op.op == "Tf":
        stack.set(font=text(0), font_size=number(args, 1))
    elif op.op == "TD":
        stack.set(leading=-number(args, 1))
    elif op.op in _COLORS:
        side, space, n = _COLORS[op.op]
        stack.set(**{f"{side}_space": space, f"{side}_color": tuple(number(args, i) for i in range(n))})
    elif op.op in ("CS", "cs"):
        stack.set(**{"stroke_space" if op.op == "CS" else "fill_space": text(0)})
    elif op.op in ("SC", "SCN", "sc", "scn"):
        values = tuple(float(v) for v in args if isinstance(v, (int, float)) and not isinstance(v, bool))
        stack.set(**{"stroke_color" if op.op[0] == "S" else "fill_color": values})


def states(ops: list[Op]) -> Iterator[tuple[int, dict[str, Any]]]:
    """(depth, state) after each operator."""
    stack = Stack()
    for op in ops:
        apply(stack, op)
        yield stack.depth, asdict(stack.current)
