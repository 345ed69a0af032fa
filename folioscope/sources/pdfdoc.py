"""PDF documents without other libraries: objects, pages, what is drawn on them, and writing, merging and selecting pages.

Objects are parsed in file order, later ones of a number replace earlier ones, so incremental updates and broken cross-reference tables do no harm.
Text is read through ToUnicode maps or the Windows encoding, and measured by a font's widths (Helvetica's where it has none). Encrypted documents,
filters other than Flate, and fonts that only draw shapes aren't read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Widths of Helvetica from the blank to the tilde in thousandths, ascent and descent of a run without its own, papers.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
ASCENT, DESCENT = 0.8, -0.2
LETTER = [0, 0, 612, 792]
SCAN_COVERAGE = 0.8
_space = rb"\x00\t\n\x0c\r "
_plain = rb"\x00\t\n\x0c\r ()<>\[\]{}/%"
_token = re.compile(rb"(?:[" + _space + rb"]|%[^\r\n]*)*(?:(/[^" + _plain + rb"]*)|([+-]?(?:\d+\.?\d*|\.\d+)(?![^" + _plain + rb"]))|(<<)|(>>)|<([0-9A-Fa-f" + _space + rb"]*)>|(\()|(\[)|(\])|([^" + _plain + rb"]+))")
_ref = re.compile(rb"[" + _space + rb"]+(\d+)[" + _space + rb"]+R(?![^" + _plain + rb"])")
_object = re.compile(rb"(?<!\d)(\d+)[" + _space + rb"]+(\d+)[" + _space + rb"]+obj")
_escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Word(str):
    """An operator, or true, false and null before they are told apart."""


class Ref(int):
    pass


class Stream:
    def __init__(self, head: dict, raw: bytes):
        self.head, self.raw = head, raw


class End(Exception):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(data, at + 1)
            if not m:
                break
            t = m[0]
            out += bytes([int(t, 8) & 255]) if t[:1].isdigit() and t[:1] < b"8" else b"" if t in (b"\n", b"\r", b"\r\n") else _escapes.get(t, t)
            at = m.end()
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            return bytes(out), at
        out += c
    raise End


def parse(data: bytes, at: int = 0):
    """(object, place after it)."""
    m = _token.match(data, at)
    if not m:
        raise End
    name, number, opened, closed, hexed, text, listed, unlisted, word = m.groups()
    at = m.end()
    if name is not None:
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), name[1:]).decode("latin-1")), at
    if number is not None:
        r = _ref.match(data, at) if number.isdigit() else None
        if r:
            return Ref(int(number)), r.end()
        return (float(number) if b"." in number else int(number)), at
    if hexed is not None:
        h = re.sub(rb"[^0-9A-Fa-f]", b"", hexed)
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), at
    if text:
        return _string(data, at)
    if opened or listed:
        out = []
        while True:
            x, at = parse(data, at)
            if x is (Closing.DICT if opened else Closing.LIST):
                break
            if isinstance(x, Closing):
                raise End
            out.append(x)
        return ({k: v for k, v in zip(out[::2], out[1::2], strict=False) if isinstance(k, Name)} if opened else out), at
    if closed or unlisted:
        return (Closing.DICT if closed else Closing.LIST), at
    return {b"true": True, b"false": False, b"null": None}.get(word, Word(word.decode("latin-1"))), at


class Closing:
    def __init__(self, what: str):
        self.what = what


Closing.DICT, Closing.LIST = Closing("dict"), Closing("list")


class Document:
    """Objects by number. Bytes that aren't PDF, have no pages or are encrypted raise ValueError."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF")
        self.objects: dict[int, object] = {}
        trailer: dict = {}
        at = 0
        while m := _object.search(data, at):
            try:
                x, at = parse(data, m.end())
            except End:
                at = m.end()
                continue
            if isinstance(x, dict) and (s := re.compile(rb"[" + _space + rb"]*stream(\r\n|\n|\r)").match(data, at)):
                n = x.get("Length")
                n = self.objects.get(n) if isinstance(n, Ref) else n
                end = s.end() + n if isinstance(n, int) and re.compile(rb"[" + _space + rb"]*endstream").match(data, s.end() + n) else data.find(b"endstream", s.end())
                end = len(data) if end < 0 else end
                x, at = Stream(x, data[s.end() : end]), end
                if x.head.get("Type") == "XRef":
                    trailer |= x.head
            self.objects[int(m[1])] = x
        for m in re.finditer(rb"trailer", data):
            try:
                t, _ = parse(data, m.end())
            except End:
                continue
            trailer |= t if isinstance(t, dict) else {}
        if "Encrypt" in trailer:
            raise ValueError("the document is encrypted")
        for x in [x for x in self.objects.values() if isinstance(x, Stream) and x.head.get("Type") == "ObjStm"]:
            body = self.bytes_of(x)
            heads = [int(v) for v in body[: int(x.head["First"])].split()][: 2 * int(x.head["N"])]
            for number, offset in zip(heads[::2], heads[1::2], strict=False):
                if number not in self.objects:
                    self.objects[number] = parse(body, int(x.head["First"]) + offset)[0]
        self.trailer = trailer
        root = self.get(trailer.get("Root")) or next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if not isinstance(root, dict):
            raise ValueError("the document has no catalog")
        self.pages: list[dict] = []
        self._gather(root.get("Pages"), {}, set())

    def get(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def bytes_of(self, s: Stream) -> bytes:
        filters = self.get(s.head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f}")
            return zlib.decompressobj().decompress(s.raw)
        return s.raw

    def _gather(self, at, above: dict, seen: set) -> None:
        node = self.get(at)
        if not isinstance(node, dict) or id(node) in seen:
            return
        seen.add(id(node))
        own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
        if "Kids" in node:
            for k in self.get(node["Kids"]) or []:
                self._gather(k, own, seen)
        else:
            self.pages.append(node | own)

    def box(self, page: dict) -> tuple[float, float, float, float]:
        """The crop box, within the media box, from its lower left to its upper right corner."""
        read = lambda k: [float(self.get(v)) for v in self.get(page.get(k)) or LETTER]
        m = read("MediaBox")
        m = [min(m[0], m[2]), min(m[1], m[3]), max(m[0], m[2]), max(m[1], m[3])]
        if "CropBox" not in page:
            return tuple(m)
        c = read("CropBox")
        return max(m[0], min(c[0], c[2])), max(m[1], min(c[1], c[3])), min(m[2], max(c[0], c[2])), min(m[3], max(c[1], c[3]))

    def size(self, page: dict) -> tuple[float, float, int]:
        """Width and height as displayed, and the turn."""
        x0, y0, x1, y1 = self.box(page)
        turn = int(self.get(page.get("Rotate")) or 0) % 360
        return (y1 - y0, x1 - x0, turn) if turn in (90, 270) else (x1 - x0, y1 - y0, turn)

    def info(self) -> dict[str, str]:
        """The information dictionary's texts."""
        found = self.get(self.trailer.get("Info")) or {}
        plain = lambda b: b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b.decode("latin-1")
        return {k: plain(v) for k, v in ((k, self.get(v)) for k, v in found.items()) if isinstance(v, bytes)}


def times(m, n):
    """m, then n: matrices (a, b, c, d, e, f)."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def at_point(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def display(doc: Document, page: dict):
    """The matrix from user space to display points."""
    x0, y0, x1, y1 = doc.box(page)
    return {0: (1, 0, 0, -1, -x0, y1), 90: (0, 1, 1, 0, -y0, -x0), 180: (-1, 0, 0, 1, x1, -y0), 270: (0, -1, -1, 0, y1, x1)}.get(doc.size(page)[2], (1, 0, 0, -1, -x0, y1))


class Font:
    def __init__(self, doc: Document, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        below = doc.get((doc.get(font.get("DescendantFonts")) or [None])[0]) or {} if self.wide else font
        self.default = float(doc.get(below.get("DW")) or 1000) if self.wide else None
        self.widths: dict[int, float] = {}
        first, listed = doc.get(below.get("FirstChar")) or 0, doc.get(below.get("W" if self.wide else "Widths")) or []
        if self.wide:
            k = 0
            while k + 1 < len(listed):
                a, b = doc.get(listed[k]), doc.get(listed[k + 1])
                if isinstance(b, list):
                    self.widths |= {a + i: float(doc.get(w)) for i, w in enumerate(b)}
                    k += 2
                else:
                    self.widths |= dict.fromkeys(range(a, b + 1), float(doc.get(listed[k + 2])))
                    k += 3
        else:
            self.widths = {first + i: float(doc.get(w)) for i, w in enumerate(listed)}
        about = doc.get(below.get("FontDescriptor")) or {}
        self.ascent, self.descent = (float(doc.get(about.get(k)) or 0) / 1000 or d for k, d in (("Ascent", ASCENT), ("Descent", DESCENT)))
        self.map: dict[int, str] = {}
        cmap = doc.get(font.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self._read(doc.bytes_of(cmap))

    def _read(self, body: bytes) -> None:
        text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
            self.map |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                first = text(c)
                self.map |= {int(a, 16) + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(min(65536, int(b, 16) - int(a, 16) + 1))}

    def characters(self, raw: bytes) -> Iterator[tuple[int, str, float]]:
        """(code, text, width in em) of each character."""
        step = 2 if self.wide else 1
        for k in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[k : k + step], "big")
            plain = bytes([code]).decode("cp1252", "replace") if not self.wide else ""
            width = self.widths.get(code)
            if width is None:
                width = self.default if self.wide else HELVETICA[code - 32] if 32 <= code < 127 else 556
            yield code, self.map.get(code, plain), width / 1000


def walk(doc: Document, page: dict) -> dict:
    """What a page draws: runs (text, x, y, width, height, angle, size in display points), images (area and dpi) and whether it has paths."""
    contents = doc.get(page.get("Contents"))
    parts = [doc.get(c) for c in contents] if isinstance(contents, list) else [contents]
    body = b"\n".join(doc.bytes_of(p) for p in parts if isinstance(p, Stream))
    out = {"runs": [], "images": [], "paths": False, "text": []}
    _draw(doc, body, doc.get(page.get("Resources")) or {}, display(doc, page), out, 0)
    return out


def _draw(doc: Document, body: bytes, resources: dict, base, out: dict, depth: int) -> None:
    kinds = {k: doc.get(resources.get(k)) or {} for k in ("Font", "XObject")}
    fonts: dict[str, Font] = {}
    state = {"ctm": base, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
    stack, args, tm, line, at = [], [], (1, 0, 0, 1, 0, 0), (1, 0, 0, 1, 0, 0), 0

    def show(parts) -> None:
        nonlocal tm
        font, size = state["font"], state["size"]
        if font is None:
            return
        start, text, advance = tm, [], 0.0
        for p in parts:
            if isinstance(p, bytes):
                for code, c, w in font.characters(p):
                    text.append(c)
                    advance += (w * size + state["char"] + (state["word"] if code == 32 and not font.wide else 0.0)) * state["scale"]
            elif isinstance(p, (int, float)):
                advance -= p / 1000 * size * state["scale"]
        tm = times((1, 0, 0, 1, advance, 0), tm)
        said = "".join(text)
        out["text"].append(said)
        if not said.strip():
            return
        m = times((1, 0, 0, 1, 0, state["rise"]), times(start, state["ctm"]))
        corners = [at_point(m, x, y) for x in (0, advance) for y in (font.descent * size, font.ascent * size)]
        xs, ys = [p for p, _ in corners], [q for _, q in corners]
        out["runs"].append({"text": said, "x": min(xs), "y": min(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys), "angle": math.degrees(math.atan2(m[1], m[0])), "size": size * math.hypot(m[2], m[3])})

    while True:
        try:
            x, at = parse(body, at)
        except End:
            break
        if not isinstance(x, Word):
            if not isinstance(x, Closing):
                args.append(x)
            continue
        op = str(x)
        try:
            if op == "q":
                stack.append(dict(state))
            elif op == "Q" and stack:
                state.update(stack.pop())
            elif op == "cm":
                state["ctm"] = times(tuple(args[-6:]), state["ctm"])
            elif op == "BT":
                tm = line = (1, 0, 0, 1, 0, 0)
            elif op == "Tf":
                name = args[-2]
                if name not in fonts:
                    fonts[name] = Font(doc, doc.get(kinds["Font"].get(name)) or {})
                state["font"], state["size"] = fonts[name], float(args[-1])
            elif op in ("Tc", "Tw", "TL", "Ts"):
                state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[op]] = float(args[-1])
            elif op == "Tz":
                state["scale"] = args[-1] / 100
            elif op == "Tm":
                tm = line = tuple(args[-6:])
            elif op in ("Td", "TD", "T*"):
                dx, dy = (0, -state["lead"]) if op == "T*" else args[-2:]
                if op == "TD":
                    state["lead"] = -dy
                tm = line = times((1, 0, 0, 1, dx, dy), line)
            elif op == "Tj":
                show(args[-1:])
            elif op == "TJ":
                show(args[-1])
            elif op in ("'", '"'):
                if op == '"':
                    state["word"], state["char"] = args[-3:-1]
                tm = line = times((1, 0, 0, 1, 0, -state["lead"]), line)
                show(args[-1:])
            elif op == "Do":
                drawn = doc.get(kinds["XObject"].get(args[-1]))
                if isinstance(drawn, Stream) and drawn.head.get("Subtype") == "Image":
                    m = state["ctm"]
                    wide, high = math.hypot(m[0], m[1]), math.hypot(m[2], m[3])
                    px, py = doc.get(drawn.head.get("Width")) or 0, doc.get(drawn.head.get("Height")) or 0
                    out["images"].append({"area": abs(m[0] * m[3] - m[1] * m[2]), "dpi": math.sqrt(px / wide * 72 * py / high * 72) if wide and high else 0.0})
                elif isinstance(drawn, Stream) and drawn.head.get("Subtype") == "Form" and depth < 8:
                    own = tuple(doc.get(drawn.head.get("Matrix")) or (1, 0, 0, 1, 0, 0))
                    _draw(doc, doc.bytes_of(drawn), doc.get(drawn.head.get("Resources")) or resources, times(own, state["ctm"]), out, depth + 1)
            elif op in ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s"):
                out["paths"] = True
            elif op == "BI":
                # An inline image: its bytes end where EI stands alone.
                end = re.compile(rb"[" + _space + rb"]EI(?=[" + _space + rb"]|$)").search(body, at)
                at = end.end() if end else len(body)
        except (IndexError, TypeError, ValueError, ZeroDivisionError):
            pass  # an operator with wrong operands draws nothing
        args = []


def _dumped(x) -> bytes:
    if isinstance(x, Ref):
        return b"%d 0 R" % int(x)
    if isinstance(x, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], x.encode("latin-1"))
    if isinstance(x, bool) or x is None:
        return {True: b"true", False: b"false", None: b"null"}[x]
    if isinstance(x, (int, float)):
        return (b"%d" % x) if isinstance(x, int) else (b"%.6f" % x).rstrip(b"0").rstrip(b".")
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, list):
        return b"[" + b" ".join(map(_dumped, x)) + b"]"
    return b"<<" + b" ".join(_dumped(Name(k)) + b" " + _dumped(v) for k, v in x.items()) + b">>"


def assembled(objects: list, root: int, info: int | None = None) -> bytes:
    """A document of objects numbered from 1, with its cross-reference table."""
    out, places = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], []
    for k, x in enumerate(objects, 1):
        places.append(sum(map(len, out)) if k == 1 else places[-1] + len(out[-1]))
        if isinstance(x, Stream):
            body = _dumped({**x.head, "Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
        else:
            body = _dumped(x)
        out.append(b"%d 0 obj\n" % k + body + b"\nendobj\n")
    start = places[-1] + len(out[-1])
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    end = {"Size": len(objects) + 1, "Root": Ref(root)} | ({"Info": Ref(info)} if info else {})
    return b"".join(out) + table + b"trailer\n" + _dumped(end) + b"\nstartxref\n%d\n%%%%EOF\n" % start


def drawable(text: str) -> bytes:
    """Text in the Windows encoding; what it doesn't have becomes a question mark."""
    return text.encode("cp1252", "replace")


def text_width(text: str, size: float) -> float:
    return sum(HELVETICA[c - 32] if 32 <= c < 127 else 556 for c in drawable(text)) * size / 1000


def wrapped(text: str, width: float, size: float) -> list[str]:
    """Lines of at most width points: words as long as they fit, and a word that is longer than a line broken where it must be."""
    lines = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.split(" "):
            if line and text_width(f"{line} {word}", size) <= width:
                line = f"{line} {word}"
                continue
            if line:
                lines.append(line)
            while len(word) > 1 and text_width(word, size) > width:
                k = max(1, next((i for i in range(1, len(word) + 1) if text_width(word[:i], size) > width), len(word)) - 1)
                lines.append(word[:k])
                word = word[k:]
            line = word
        lines.append(line)
    return lines


def created(pages: list[dict], info: dict[str, str] | None = None) -> bytes:
    """A document of pages: width, height, rotation, texts (text, x, baseline y, size, visible), images (bytes array, x, y, width, height) and lines (x1, y1, x2, y2, thickness), in points from the upper left."""
    objects: list = [{"Type": Name("Catalog"), "Pages": Ref(2)}, {}, {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}]
    kids = []
    for p in pages:
        w, h, ops, images = float(p["width"]), float(p["height"]), [], {}
        for image, x, y, iw, ih in p.get("images", []):
            objects.append(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": image.shape[1], "Height": image.shape[0], "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray" if image.ndim == 2 else "DeviceRGB"), "Filter": Name("FlateDecode")}, zlib.compress(np.ascontiguousarray(image).tobytes())))
            images[f"I{len(images)}"] = Ref(len(objects))
            ops.append(b"q %f 0 0 %f %f %f cm /I%d Do Q" % (iw, ih, x, h - y - ih, len(images) - 1))
        for x1, y1, x2, y2, thick in p.get("lines", []):
            ops.append(b"%f w %f %f m %f %f l S" % (thick, x1, h - y1, x2, h - y2))
        for text, x, y, size, visible in p.get("texts", []):
            ops.append(b"BT /F %f Tf %d Tr 1 0 0 1 %f %f Tm <%s> Tj ET" % (size, 0 if visible else 3, x, h - y, drawable(text).hex().encode()))
        objects.append(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join(ops))))
        objects.append({"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, w, h], "Rotate": int(p.get("rotation", 0)), "Resources": {"Font": {"F": Ref(3)}} | ({"XObject": images} if images else {}), "Contents": Ref(len(objects))})
        kids.append(Ref(len(objects)))
    objects[1] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    if info:
        objects.append({Name(k): b"\xfe\xff" + v.encode("utf-16-be") for k, v in info.items()})
    return assembled(objects, 1, len(objects) if info else None)


def merged(documents: list[bytes], pages: list[list[int] | None] | None = None) -> bytes:
    """One document of all pages, or of those selected (from 1, in that order) of each; what pages don't need is left out. No pages raise ValueError."""
    objects: list = [{"Type": Name("Catalog"), "Pages": Ref(2)}, {}]
    kids = []
    for k, data in enumerate(documents):
        doc, known = Document(data), {}

        def copied(x, doc=doc, known=known):
            if isinstance(x, Ref):
                if int(x) not in known:
                    objects.append(None)
                    known[int(x)] = mine = len(objects)
                    objects[mine - 1] = copied(doc.objects.get(int(x)))
                return Ref(known[int(x)])
            if isinstance(x, Stream):
                return Stream({k: copied(v) for k, v in x.head.items() if k != "Length"}, x.raw)
            if isinstance(x, dict):
                return {k: copied(v) for k, v in x.items() if k != "Parent"}
            return [copied(v) for v in x] if isinstance(x, list) else x

        chosen = pages[k] if pages and pages[k] is not None else range(1, len(doc.pages) + 1)
        for n in chosen:
            if not 1 <= n <= len(doc.pages):
                raise ValueError(f"page {n} is outside 1 to {len(doc.pages)}")
            objects.append(copied(doc.pages[n - 1]) | {"Parent": Ref(2)})
            kids.append(Ref(len(objects)))
    if not kids:
        raise ValueError("no pages to merge")
    objects[1] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    return assembled(objects, 1)


PAGES = "path string, page int, pages int, width double, height double, rotation int, characters long, images int, coverage double, paths boolean, dpi double, kind string, text string, runs array<struct<text:string,x:double,y:double,width:double,height:double,angle:double,size:double>>, problem string"


def kind_of(coverage: float, characters: int, paths: bool) -> str:
    """What a page is, as in policies.page_kind."""
    if coverage >= SCAN_COVERAGE:
        return "scanned-with-text-layer" if characters else "scanned"
    return "vector" if characters or paths or coverage > 0 else "empty"


def pages_of(data: bytes) -> Iterator[tuple]:
    """Rows of PAGES without path; a document that can't be read is one row with its problem."""
    try:
        doc = Document(data)
    except (ValueError, RecursionError, zlib.error) as e:
        yield (None, 0, *(None,) * 11, str(e))
        return
    for n, page in enumerate(doc.pages, 1):
        w, h, turn = doc.size(page)
        try:
            seen, problem = walk(doc, page), None
        except (ValueError, zlib.error) as e:
            seen, problem = {"runs": [], "images": [], "paths": False, "text": []}, str(e)
        coverage = min(1.0, sum(i["area"] for i in seen["images"]) / (w * h)) if w * h > 0 else 0.0
        characters = sum(len("".join(r["text"].split())) for r in seen["runs"])
        largest = max(seen["images"], key=lambda i: i["area"], default=None)
        dpi = largest["dpi"] if largest and coverage >= SCAN_COVERAGE else None
        yield n, len(doc.pages), w, h, turn, characters, len(seen["images"]), coverage, seen["paths"], dpi, kind_of(coverage, characters, seen["paths"]), "\n".join(seen["text"]), seen["runs"], problem


def read_pages(files: DataFrame) -> DataFrame:
    """Pages of documents (path, content) with size, kind, resolution, text and runs; a document is one task's work, its pages are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAGES.split(", ")]
        runs = pa.list_(pa.struct([("text", pa.string()), *((k, pa.float64()) for k in ("x", "y", "width", "height", "angle", "size"))]))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.string(), pa.string(), runs, pa.string()]
        for batch in batches:
            rows = [(p.as_py(), *r) for p, c in zip(*batch.columns[:2], strict=True) for r in pages_of(c.as_py() or b"")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, PAGES)
