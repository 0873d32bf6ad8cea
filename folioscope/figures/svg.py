"""Drawing specs as SVG text; the same spec always gives the same bytes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from html import escape

WIDTH, HEIGHT = 860, 480
# The colours, in the order they are used.
PALETTE = ("#2f6690", "#d1603d", "#5b8e7d", "#8f5d9b", "#c9a227", "#3a7ca5", "#a44a3f", "#6b9080", "#7d7abc", "#b5838d")


class FigureError(ValueError):
    """A figure that can't be drawn: no data, an unknown form or format."""


@dataclass(frozen=True)
class Series:
    name: str
    x: tuple
    y: tuple[float | None, ...]
    form: str = "line"


@dataclass(frozen=True)
class FigureSpec:
    """What a figure shows: its form, title, axes and series, or nodes and links for networks and flows."""

    form: str
    title: str
    series: tuple[Series, ...] = ()
    x_label: str = ""
    y_label: str = ""
    log: bool = False
    nodes: tuple[tuple[str, float, float, float, int], ...] = ()
    links: tuple[tuple[str, str, float], ...] = ()
    grid: tuple[tuple[float, ...], ...] = ()
    style: dict = field(default_factory=dict)


FORMS = ("hbar", "vbar", "line", "mixed", "scatter", "area", "pie", "network", "density", "map", "treemap", "words", "flow", "tree")
STYLE = ("title", "show_title", "subtitle", "kind", "orientation", "palette", "color", "value_labels", "x_label", "y_label", "width", "height")
#: Forms that the `kind` of a style changes into one another.
KINDS = ("bar", "lollipop", "line", "area", "pie", "donut")
PLAIN = ("hbar", "vbar", "line", "area", "pie")
PALETTES = ("single", "gradient", "category")


def _mixed(colour: str, white: float) -> str:
    """`colour` with a share of white."""
    parts = [int(colour[i : i + 2], 16) for i in (1, 3, 5)]
    return "#" + "".join(f"{round(v + (255 - v) * white):02x}" for v in parts)


def gradient(colour: str, values: Sequence[float]) -> list[str]:
    """A colour for each value, from a light one for the least to `colour` for the largest."""
    low, high = min(values, default=0), max(values, default=0)
    return [_mixed(colour, 0.75 * (high - v) / (high - low) if high > low else 0.0) for v in values]


def spread(colours: Sequence[str], number: int) -> list[str]:
    """`number` different colours: those given, then lighter and lighter ones."""
    return [_mixed(colours[i % len(colours)], 1 - 0.7 ** (i // len(colours))) for i in range(number)]


def _n(value: float) -> str:
    return f"{value:.2f}".rstrip("0").rstrip(".")


def short(text: object, most: int = 40) -> str:
    text = str(text)
    return text if len(text) <= most else text[: most - 1] + "…"


def _ticks(lo: float, hi: float, number: int = 5) -> list[float]:
    if hi <= lo:
        hi = lo + 1
    step = 10 ** math.floor(math.log10((hi - lo) / number))
    step *= next(m for m in (1, 2, 5, 10) if (hi - lo) / (step * m) <= number)
    first = math.ceil(lo / step - 1e-9)
    return [k * step for k in range(first, math.floor(hi / step + 1e-9) + 1)]


class Canvas:
    def __init__(self, spec: FigureSpec):
        self.spec = spec
        self.w, self.h = int(spec.style.get("width", WIDTH)), int(spec.style.get("height", HEIGHT))
        style = spec.style
        self.palette = style.get("palette", "single")
        if isinstance(self.palette, str) and self.palette not in PALETTES:
            raise FigureError(f"no palette {self.palette!r}; there are {', '.join(PALETTES)}, or colours")
        listed = PALETTE if isinstance(self.palette, str) else tuple(self.palette)
        self.colours = (style["color"], *listed) if "color" in style else listed
        self.parts: list[str] = []
        if style.get("show_title", True):
            self.text(self.w / 2, 22, style.get("title", spec.title), 15, "middle")
            if style.get("subtitle"):
                self.text(self.w / 2, 38, style["subtitle"], 11, "middle")

    def colour(self, i: int) -> str:
        return self.colours[i % len(self.colours)]

    def fills(self, values: Sequence[float]) -> list[str]:
        """A colour for each category of a series, as the palette says."""
        if self.palette == "gradient":
            return gradient(self.colours[0], values)
        return spread(self.colours, len(values)) if self.palette == "category" else [self.colours[0]] * len(values)

    def text(self, x: float, y: float, what: object, size: int = 11, anchor: str = "start") -> None:
        self.parts.append(f'<text x="{_n(x)}" y="{_n(y)}" font-size="{size}" text-anchor="{anchor}">{escape(str(what))}</text>')

    def line(self, x1: float, y1: float, x2: float, y2: float, colour: str = "#999", width: float = 1) -> None:
        self.parts.append(f'<line x1="{_n(x1)}" y1="{_n(y1)}" x2="{_n(x2)}" y2="{_n(y2)}" stroke="{colour}" stroke-width="{_n(width)}"/>')

    def rect(self, x: float, y: float, w: float, h: float, colour: str, opacity: float = 1) -> None:
        self.parts.append(f'<rect x="{_n(x)}" y="{_n(y)}" width="{_n(max(w, 0))}" height="{_n(max(h, 0))}" fill="{colour}" fill-opacity="{_n(opacity)}"/>')

    def dot(self, x: float, y: float, r: float, colour: str) -> None:
        self.parts.append(f'<circle cx="{_n(x)}" cy="{_n(y)}" r="{_n(r)}" fill="{colour}" fill-opacity="0.8"/>')

    def path(self, d: str, stroke: str, fill: str = "none", width: float = 2, opacity: float = 1) -> None:
        self.parts.append(f'<path d="{d}" stroke="{stroke}" fill="{fill}" stroke-width="{_n(width)}" opacity="{_n(opacity)}"/>')

    def done(self) -> bytes:
        body = "\n".join(self.parts)
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.w}" height="{self.h}" viewBox="0 0 {self.w} {self.h}" font-family="sans-serif">\n<rect width="100%" height="100%" fill="white"/>\n{body}\n</svg>\n'.encode()


def _bars(c: Canvas, flat: bool, sticks: bool = False) -> None:
    s = c.spec.series[0]
    values = [v or 0.0 for v in s.y]
    top = max([*values, 0]) or 1
    n = len(values)
    fills, labelled = c.fills(values), c.spec.style.get("value_labels", flat)
    for i, (name, value) in enumerate(zip(s.x, values, strict=True)):
        if flat:
            band = (c.h - 60) / n
            y, size = 40 + i * band, (c.w - 340) * value / top
            if sticks:
                c.line(250, y + band / 2, 250 + size, y + band / 2, fills[i], 2)
                c.dot(250 + size, y + band / 2, min(6, band / 3), fills[i])
            else:
                c.rect(250, y + band * 0.1, size, band * 0.8, fills[i])
            c.text(244, y + band * 0.65, short(name), 11, "end")
            if labelled:
                c.text(258 + size, y + band * 0.65, f"{value:g}", 10)
        else:
            band = (c.w - 90) / n
            x, size = 60 + i * band, (c.h - 100) * value / top
            if sticks:
                c.line(x + band / 2, c.h - 50, x + band / 2, c.h - 50 - size, fills[i], 2)
                c.dot(x + band / 2, c.h - 50 - size, min(6, band / 3), fills[i])
            else:
                c.rect(x + band * 0.1, c.h - 50 - size, band * 0.8, size, fills[i])
            if n <= 30 or i % (n // 15) == 0:
                c.text(x + band / 2, c.h - 34, short(name, 16), 9, "middle")
            if labelled:
                c.text(x + band / 2, c.h - 56 - size, f"{value:g}", 9, "middle")
    if not flat:
        for t in _ticks(0, top):
            c.text(54, c.h - 46 - (c.h - 100) * t / top, f"{t:g}", 10, "end")


def _curves(c: Canvas, points: bool, filled: bool = False) -> None:
    spec = c.spec
    shift = (lambda v: math.log10(v) if v > 0 else None) if spec.log else float
    data = []
    for s in spec.series:
        x = [i if isinstance(v, str) else float(v) for i, v in enumerate(s.x)]
        pairs = [(shift(a), shift(b), name) for a, b, name in zip(x, s.y, s.x, strict=True) if b is not None]
        data.append((s, [p for p in pairs if p[0] is not None and p[1] is not None]))
    every = [p for _, ps in data for p in ps]
    if not every:
        raise FigureError("no data to draw")
    x0, x1, y0, y1 = min(p[0] for p in every), max(p[0] for p in every), min(0.0, *(p[1] for p in every)), max(p[1] for p in every)
    px = lambda v: 60 + (v - x0) / ((x1 - x0) or 1) * (c.w - 100)
    py = lambda v: c.h - 50 - (v - y0) / ((y1 - y0) or 1) * (c.h - 100)
    for t in _ticks(y0, y1):
        c.line(60, py(t), c.w - 40, py(t), "#e5e5e5")
        c.text(54, py(t) + 4, f"{10**t:.3g}" if spec.log else f"{t:g}", 10, "end")
    for t in _ticks(x0, x1, 10):
        c.text(px(t), c.h - 34, f"{10**t:.3g}" if spec.log else f"{t:g}", 10, "middle")
    for i, (s, ps) in enumerate(data):
        if s.form == "bar":
            for a, b, _ in ps:
                c.rect(px(a) - 3, py(b), 6, py(y0) - py(b), c.colour(i), 0.7)
        elif points or s.form == "scatter":
            for a, b, name in ps:
                c.dot(px(a), py(b), 5, c.colour(i))
                if isinstance(name, str):
                    c.text(px(a) + 6, py(b) + 4, short(name, 24), 9)
        else:
            line = "M" + " L".join(f"{_n(px(a))},{_n(py(b))}" for a, b, _ in ps)
            if s.form == "area" or filled:
                c.path(f"{line} L{_n(px(ps[-1][0]))},{_n(py(y0))} L{_n(px(ps[0][0]))},{_n(py(y0))} Z", c.colour(i), c.colour(i), 1, 0.4)
            else:
                c.path(line, c.colour(i))
            if spec.style.get("value_labels"):
                for a, b, _ in ps:
                    c.text(px(a), py(b) - 6, f"{10**b:.3g}" if spec.log else f"{b:g}", 9, "middle")
        if len(data) > 1:
            c.rect(c.w - 190, 34 + 15 * i, 10, 10, c.colour(i))
            c.text(c.w - 175, 43 + 15 * i, short(s.name, 26), 10)


def _pie(c: Canvas, hole: float = 0.0) -> None:
    if len(c.spec.series) != 1:
        raise FigureError("a pie shows a single series")
    s = c.spec.series[0]
    if any((v or 0) < 0 for v in s.y) or not any(s.y):
        raise FigureError("a pie shows positive values")
    pairs = sorted(((v or 0.0, str(n)) for n, v in zip(s.x, s.y, strict=True)), key=lambda p: (-p[0], p[1]))
    if len(pairs) > 8:
        pairs = [*pairs[:7], (sum(p[0] for p in pairs[7:]), "Other")]
    whole, angle = sum(p[0] for p in pairs), -math.pi / 2
    fills = gradient(c.colours[0], [p[0] for p in pairs]) if c.palette == "gradient" else spread(c.colours, len(pairs))
    for i, (v, name) in enumerate(pairs):
        end = angle + 2 * math.pi * v / whole
        at = [(c.w / 2 + 170 * math.cos(a), c.h / 2 + 10 + 170 * math.sin(a)) for a in (angle, min(end, angle + 2 * math.pi - 1e-6))]
        c.path(f"M{_n(c.w / 2)},{_n(c.h / 2 + 10)} L{_n(at[0][0])},{_n(at[0][1])} A170,170 0 {int(end - angle > math.pi)} 1 {_n(at[1][0])},{_n(at[1][1])} Z", "white", fills[i], 1)
        c.rect(20, 51 + 16 * i, 10, 10, fills[i])
        c.text(36, 60 + 16 * i, f"{short(name, 30)}: {v:g}" + (f" ({100 * v / whole:.1f} %)" if c.spec.style.get("value_labels") else ""), 11)
        angle = end
    if hole:
        c.parts.append(f'<circle cx="{_n(c.w / 2)}" cy="{_n(c.h / 2 + 10)}" r="{_n(170 * hole)}" fill="white" fill-opacity="1"/>')


def _network(c: Canvas) -> None:
    spec = c.spec
    place = {i: (x, y) for i, x, y, _, _ in spec.nodes}
    top = max((w for *_, w in spec.links), default=1) or 1
    for a, b, w in spec.links:
        if a in place and b in place:
            c.line(*place[a], *place[b], "#bbb", 0.5 + 3 * w / top)
    heavy = max((m for *_, m, _ in spec.nodes), default=1) or 1
    for name, x, y, mass, group in spec.nodes:
        c.dot(x, y, 4 + 12 * math.sqrt(mass / heavy), c.colour(group - 1))
        c.text(x + 6, y - 6, short(name.split(" · ")[-1], 28), 9)


def _density(c: Canvas) -> None:
    rows = c.spec.grid
    for i, row in enumerate(rows):
        for j, v in enumerate(row):
            if v > 0.02:
                c.rect(j * c.w / len(row), i * c.h / len(rows), c.w / len(row) + 0.5, c.h / len(rows) + 0.5, c.colour(1), v)
    for name, x, y, _, _ in c.spec.nodes:
        c.text(x, y, short(name, 24), 9, "middle")


def _map(c: Canvas) -> None:
    """Countries as discs at their longitude and latitude."""
    top = max((m for *_, m, _ in c.spec.nodes), default=1) or 1
    place = {}
    for name, lon, lat, mass, _ in c.spec.nodes:
        place[name] = (c.w * (lon + 180) / 360, 30 + (c.h - 40) * (90 - lat) / 180)
        c.dot(*place[name], 3 + 18 * math.sqrt(mass / top), c.colour(0))
        c.text(place[name][0], place[name][1] - 4, short(name, 18), 8, "middle")
    for a, b, w in c.spec.links:
        if a in place and b in place:
            (x1, y1), (x2, y2) = place[a], place[b]
            c.path(f"M{_n(x1)},{_n(y1)} Q{_n((x1 + x2) / 2)},{_n(min(y1, y2) - 30)} {_n(x2)},{_n(y2)}", "#d1603d", "none", 0.5 + min(w, 6) / 2, 0.5)


def _treemap(c: Canvas) -> None:
    """Rectangles by splitting the values in two halves of about the same sum, along the longer side."""
    s = c.spec.series[0]
    items = sorted(((v or 0.0, str(n)) for n, v in zip(s.x, s.y, strict=True) if v), key=lambda p: (-p[0], p[1]))

    def fill(part: Sequence[tuple[float, str]], x: float, y: float, w: float, h: float, k: int) -> None:
        if len(part) == 1:
            c.rect(x + 1, y + 1, w - 2, h - 2, c.colour(k))
            if w > 50 and h > 14:
                c.text(x + 5, y + 14, short(part[0][1], max(4, int(w / 7))), 10)
            return
        whole, run, cut = sum(p[0] for p in part), 0.0, 0
        while cut < len(part) - 1 and (cut == 0 or run + part[cut][0] / 2 < whole / 2):
            run += part[cut][0]
            cut += 1
        share = run / whole
        if w >= h:
            fill(part[:cut], x, y, w * share, h, k)
            fill(part[cut:], x + w * share, y, w * (1 - share), h, k + cut)
        else:
            fill(part[:cut], x, y, w, h * share, k)
            fill(part[cut:], x, y + h * share, w, h * (1 - share), k + cut)

    if items:
        fill(items, 10, 34, c.w - 20, c.h - 44, 0)


def _words(c: Canvas) -> None:
    """Words in rows, the most frequent first and largest."""
    s = c.spec.series[0]
    items = sorted(((v or 0.0, str(n)) for n, v in zip(s.x, s.y, strict=True)), key=lambda p: (-p[0], p[1]))
    top, x, y, tall = items[0][0] or 1, 14.0, 40.0, 0
    for i, (v, word) in enumerate(items):
        size = int(10 + 26 * math.sqrt(v / top))
        wide = 0.6 * size * len(short(word)) + 10
        if x + wide > c.w - 10:
            x, y, tall = 14.0, y + tall + 4, 0
        tall = max(tall, size)
        if y + size > c.h - 6:
            break
        c.parts.append(f'<text x="{_n(x)}" y="{_n(y + size)}" font-size="{size}" fill="{c.colour(i)}">{escape(short(word))}</text>')
        x += wide


def _flow(c: Canvas) -> None:
    """Columns of nodes with links as wide as their value; a node's column is the number in it."""
    columns: dict[int, list[tuple[str, float]]] = {}
    for name, _, _, mass, column in c.spec.nodes:
        columns.setdefault(column, []).append((name, mass))
    number = max(columns, default=0) or 1
    spot: dict[tuple[int, str], list[float]] = {}
    for k, found in columns.items():
        whole = sum(m for _, m in found) or 1
        y, room = 40.0, c.h - 60 - 6 * len(found)
        for i, (name, mass) in enumerate(found):
            h = room * mass / whole
            x = 30 + (c.w - 200) * k / number
            c.rect(x, y, 12, h, c.colour(i))
            c.text(x + 16, y + h / 2 + 4, short(name.split(":", 1)[-1], 24), 9)
            spot[k, name] = [x, y, y, h / (mass or 1)]
            y += h + 6
    for a, b, w in c.spec.links:
        for k in range(number):
            if (k, a) in spot and (k + 1, b) in spot:
                s, t = spot[k, a], spot[k + 1, b]
                mid = (s[0] + 12 + t[0]) / 2
                ya, yb = s[1] + w * s[3] / 2, t[2] + w * t[3] / 2
                c.path(f"M{_n(s[0] + 12)},{_n(ya)} C{_n(mid)},{_n(ya)} {_n(mid)},{_n(yb)} {_n(t[0])},{_n(yb)}", "#888", "none", max(1, w * min(s[3], t[3])), 0.35)
                s[1] += w * s[3]
                t[2] += w * t[3]


def _tree(c: Canvas) -> None:
    """A dendrogram: leaves (name, order), merges as links (a, b, height)."""
    leaves = sorted(c.spec.nodes, key=lambda n: n[2])
    at = {n[0]: (0.0, 40 + i * (c.h - 60) / max(1, len(leaves))) for i, n in enumerate(leaves)}
    top = max((h for *_, h in c.spec.links), default=1) or 1
    for name, *_ in leaves:
        c.text(214, at[name][1] + 4, short(name.split(":", 1)[-1], 32), 9, "end")
    px = lambda h: 220 + (c.w - 240) * h / top
    for k, (a, b, h) in enumerate(c.spec.links):
        (ha, ya), (hb, yb) = at[a], at[b]
        c.path(f"M{_n(px(ha))},{_n(ya)} H{_n(px(h))} V{_n(yb)} H{_n(px(hb))}", c.colour(0), "none", 1)
        at[f"#{k}"] = (h, (ya + yb) / 2)


def render(spec: FigureSpec) -> bytes:
    """The figure as SVG bytes."""
    if spec.form not in FORMS:
        raise FigureError(f"no form {spec.form!r}; there are {', '.join(FORMS)}")
    if unknown := set(spec.style) - set(STYLE):
        raise FigureError(f"unknown style {sorted(unknown)}; there are {', '.join(STYLE)}")
    if not any(len(s.x) for s in spec.series) and not spec.nodes and not spec.grid:
        raise FigureError("no data to draw")
    c = Canvas(spec)
    form, kind = spec.form, spec.style.get("kind")
    if kind is not None or "orientation" in spec.style:
        if form not in PLAIN:
            raise FigureError(f"a figure of the form {form!r} has no other kind")
        if kind not in (None, *KINDS) or spec.style.get("orientation") not in (None, "horizontal", "vertical"):
            raise FigureError(f"kind is one of {', '.join(KINDS)}, orientation horizontal or vertical")
        flat = {"horizontal": True, "vertical": False}.get(spec.style.get("orientation"), form == "hbar")
        form = {None: "hbar" if flat and form in ("hbar", "vbar") else "vbar" if form in ("hbar", "vbar") else form, "bar": "hbar" if flat else "vbar", "lollipop": "hsticks" if flat else "vsticks"}.get(kind, kind)
    drawn = {
        "hbar": lambda: _bars(c, True), "vbar": lambda: _bars(c, False), "hsticks": lambda: _bars(c, True, True), "vsticks": lambda: _bars(c, False, True), "pie": lambda: _pie(c), "donut": lambda: _pie(c, 0.55),
        "network": lambda: _network(c), "density": lambda: _density(c), "map": lambda: _map(c), "treemap": lambda: _treemap(c), "words": lambda: _words(c), "flow": lambda: _flow(c), "tree": lambda: _tree(c),
        "scatter": lambda: _curves(c, True), "area": lambda: _curves(c, False, True),
    }
    drawn.get(form, lambda: _curves(c, False))()
    x_label, y_label = (spec.style.get(k, getattr(spec, k)) for k in ("x_label", "y_label"))
    if x_label:
        c.text(c.w / 2, c.h - 10, x_label, 11, "middle")
    if y_label:
        c.text(12, 36, y_label, 11)
    return c.done()
