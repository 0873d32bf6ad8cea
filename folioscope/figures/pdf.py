"""Figures as one-page PDF files with text as text, converted from the SVG that `svg` writes; no library is needed."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
import zlib

# The widths of Helvetica's characters from the space to the tilde, in thousandths of the size.
_WIDTHS = """
278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611
722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584
"""
_ADVANCE = dict(enumerate(map(int, _WIDTHS.split()), 32))
# Colour words that figures use.
_NAMED = {"white": (1.0, 1.0, 1.0), "black": (0.0, 0.0, 0.0)}
#: How far a Bezier curve's handles lie from its ends, for a quarter of a circle.
_QUARTER = 4 / 3 * (math.sqrt(2) - 1)


def _number(value: float) -> str:
    return f"{value:.3f}".rstrip("0").rstrip(".")


def _colour(value: str | None) -> tuple[float, float, float] | None:
    if not value or value == "none":
        return None
    if value in _NAMED:
        return _NAMED[value]
    digits = value[1:] if len(value) == 7 else "".join(c * 2 for c in value[1:4])
    return tuple(int(digits[i : i + 2], 16) / 255 for i in (0, 2, 4))


def text_width(text: str, size: float) -> float:
    return sum(_ADVANCE.get(ord(c), 556) for c in text) * size / 1_000


def _arc(x0: float, y0: float, r: float, large: bool, sweep: bool, x1: float, y1: float) -> list[tuple[float, ...]]:
    """A circle's arc as Bezier curves of at most a quarter each."""
    half = math.dist((x0, y0), (x1, y1)) / 2
    if not half or not r:
        return [(x0, y0, x1, y1, x1, y1)]
    r = max(r, half)
    lift = math.sqrt(max(0.0, r * r - half * half)) / (2 * half) * (1 if large != sweep else -1)
    cx, cy = (x0 + x1) / 2 - lift * (y1 - y0), (y0 + y1) / 2 + lift * (x1 - x0)
    start, end = math.atan2(y0 - cy, x0 - cx), math.atan2(y1 - cy, x1 - cx)
    turn = end - start
    if sweep and turn <= 0:
        turn += 2 * math.pi
    elif not sweep and turn >= 0:
        turn -= 2 * math.pi
    pieces = max(1, math.ceil(abs(turn) / (math.pi / 2) - 1e-9))
    step = turn / pieces
    reach = 4 / 3 * math.tan(step / 4) * r
    out = []
    for i in range(pieces):
        a, b = start + i * step, start + (i + 1) * step
        bx, by = cx + r * math.cos(b), cy + r * math.sin(b)
        out.append((cx + r * math.cos(a) - reach * math.sin(a), cy + r * math.sin(a) + reach * math.cos(a), bx + reach * math.sin(b), by - reach * math.cos(b), bx, by))
    return out


def _path(data: str) -> list[tuple[str, tuple[float, ...]]]:
    """A path's absolute commands as PDF operators with their points: m, l, c, h."""
    out: list[tuple[str, tuple[float, ...]]] = []
    x = y = 0.0
    for command, rest in re.findall(r"([MLHVCQAZ])([^MLHVCQAZ]*)", data):
        values = [float(v) for v in re.findall(r"-?\d*\.?\d+(?:e-?\d+)?", rest)]
        if command == "Z":
            out.append(("h", ()))
            continue
        size = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "Q": 4, "A": 7}[command]
        for i in range(0, len(values), size):
            v = values[i : i + size]
            if command == "A":
                curves = _arc(x, y, v[0], bool(v[3]), bool(v[4]), v[5], v[6])
                out += [("c", c) for c in curves]
                x, y = v[5], v[6]
                continue
            if command == "C":
                out.append(("c", tuple(v)))
            elif command == "Q":
                # the same curve with two handles, each two thirds of the way to the one
                out.append(("c", (x + (v[0] - x) * 2 / 3, y + (v[1] - y) * 2 / 3, v[2] + (v[0] - v[2]) * 2 / 3, v[3] + (v[1] - v[3]) * 2 / 3, v[2], v[3])))
            else:
                v = [v[0], y] if command == "H" else [x, v[0]] if command == "V" else v
                out.append(("m" if command == "M" and i == 0 else "l", tuple(v)))
            x, y = v[-2], v[-1]
    return out


def _circle(x: float, y: float, r: float) -> list[tuple[str, tuple[float, ...]]]:
    k = r * _QUARTER
    return [
        ("m", (x + r, y)), ("c", (x + r, y + k, x + k, y + r, x, y + r)), ("c", (x - k, y + r, x - r, y + k, x - r, y)),
        ("c", (x - r, y - k, x - k, y - r, x, y - r)), ("c", (x + k, y - r, x + r, y - k, x + r, y)), ("h", ()),
    ]


class _Page:
    """The drawing operators of a page whose origin is at the top, as in SVG."""

    def __init__(self, height: float) -> None:
        self.height = height
        self.lines: list[str] = []
        self.opacities: dict[float, str] = {}

    def shape(self, parts: list[tuple[str, tuple[float, ...]]], fill: str | None, stroke: str | None, width: float, opacity: float) -> None:
        inside, line = _colour(fill), _colour(stroke)
        if not inside and not line:
            return
        name = self.opacities.setdefault(round(opacity, 3), f"O{len(self.opacities)}")
        self.lines.append(f"q /{name} gs")
        if inside:
            self.lines.append(" ".join(map(_number, inside)) + " rg")
        if line:
            self.lines.append(" ".join(map(_number, line)) + f" RG {_number(width)} w")
        for operator, points in parts:
            flipped = [self.height - v if i % 2 else v for i, v in enumerate(points)]
            self.lines.append(" ".join([*map(_number, flipped), operator]))
        self.lines.append({(True, True): "B", (True, False): "f", (False, True): "S"}[bool(inside), bool(line)] + " Q")

    def text(self, x: float, y: float, size: float, anchor: str, colour: str, text: str) -> None:
        x -= {"middle": 0.5, "end": 1.0}.get(anchor, 0.0) * text_width(text, size)
        shown = text.replace("…", "...").encode("cp1252", "replace").decode("latin-1")
        shown = re.sub(r"([\\()])", r"\\\1", shown)
        self.lines.append(f"BT /F {_number(size)} Tf {' '.join(map(_number, _colour(colour) or (0, 0, 0)))} rg {_number(x)} {_number(self.height - y)} Td ({shown}) Tj ET")


def from_svg(svg: bytes) -> bytes:
    """A PDF page of the size and content of an SVG figure; the same figure always gives the same bytes."""
    root = ET.fromstring(svg)
    width, height = float(root.get("width")), float(root.get("height"))
    page = _Page(height)
    for node in root:
        tag, get = node.tag.rsplit("}", 1)[-1], node.get
        value = lambda name, default="0": float(get(name, default))  # noqa: B023, E731
        if tag == "text":
            page.text(value("x"), value("y"), value("font-size", "12"), get("text-anchor", "start"), get("fill", "black"), node.text or "")
        elif tag == "line":
            page.shape([("m", (value("x1"), value("y1"))), ("l", (value("x2"), value("y2")))], None, get("stroke"), value("stroke-width", "1"), value("opacity", "1"))
        elif tag == "rect":
            w, h = ((total if get(name) == "100%" else value(name)) for name, total in (("width", width), ("height", height)))
            x, y = value("x"), value("y")
            page.shape([("m", (x, y)), ("l", (x + w, y)), ("l", (x + w, y + h)), ("l", (x, y + h)), ("h", ())], get("fill", "black"), get("stroke"), value("stroke-width", "1"), value("fill-opacity", "1"))
        elif tag == "circle":
            page.shape(_circle(value("cx"), value("cy"), value("r")), get("fill", "black"), get("stroke"), value("stroke-width", "1"), value("fill-opacity", "1"))
        elif tag == "path":
            page.shape(_path(get("d", "")), get("fill", "black"), get("stroke"), value("stroke-width", "1"), value("opacity", "1"))
        else:
            raise ValueError(f"no PDF form of <{tag}>")
    content = zlib.compress("\n".join(page.lines).encode("latin-1"), 9)
    states = " ".join(f"/{name} << /ca {_number(o)} /CA {_number(o)} >>" for o, name in page.opacities.items())
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {_number(width)} {_number(height)}] /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /ExtGState << {states} >> >> >>".encode(),
        f"<< /Length {len(content)} /Filter /FlateDecode >>\nstream\n".encode() + content + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())
