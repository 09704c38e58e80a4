"""A reader for vector PDF sheets: files as rows of ``binaryFile``, one page of each scanned where its bytes are.

It reads plain and Flate streams and object streams; of a page's content lines, curves, rectangles, colours, the graphics state with
its transforms, and text of simple fonts.  Other operators are skipped, and one with too few operands as well: a damaged file never
ends the job."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import colour_hex, parse_dimension
from ..operators.jobs import validation_reason
from ..schema import ENTITY
from ..tables import ship

_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]+|[-+]?(?:\d+\.?\d*|\.\d+)|\[|\]|[A-Za-z'\"*]+")
_NUMBER = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_BOX = re.compile(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]")
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
FILE = "readable boolean, encrypted boolean, pages int, page_width double, page_height double, items array<struct<ops:array<struct<op:string,points:array<struct<x:double,y:double>>>>,stroke:array<double>,fill:array<double>,width:double,text:string,size:double,x:double,y:double>>"
#: Operands that an operator needs.
_NEEDS = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4, "w": 1, "RG": 3, "rg": 3, "G": 1, "g": 1, "K": 4, "k": 4, "cm": 6, "Tf": 1, "Td": 2, "TD": 2, "Tm": 6, "TL": 1}


def _unpacked(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]


def _objects(content: bytes) -> dict[int, bytes]:
    """Bodies of all objects by number, those in object streams included."""
    out = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(out.values()):
        first = re.search(rb"/First\s+(\d+)", body)
        if b"/ObjStm" in body and first:
            data = _unpacked(body)
            start = int(first[1])
            numbers = [int(v) for v in data[:start].split()]
            places = [*numbers[1::2], len(data) - start]
            for n, at, end in zip(numbers[0::2], places, places[1:]):
                out.setdefault(n, data[start + at : start + end])
    return out


def _in_order(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the pages, by the page tree, or as they come where there is none."""
    pages = [n for n, body in objects.items() if _PAGE.search(body.split(b"stream")[0])]
    kids = {n: [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] for n, body in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S))}
    below = {k for v in kids.values() for k in v}
    out, todo, seen = [], [n for n in kids if n not in below], set()
    while todo:
        n = todo.pop(0)
        if n in seen:
            continue
        seen.add(n)
        todo = kids.get(n, []) + todo
        if n in pages:
            out.append(n)
    return out or pages


def scan(content: bytes, page: int = 0) -> dict:
    """The parts of a file: whether it can be read, its pages, and the items drawn on one of them, top left origin."""
    empty = {"readable": False, "encrypted": False, "pages": 0, "page_width": None, "page_height": None, "items": []}
    if not content.startswith(b"%PDF-") or b"%%EOF" not in content:
        return empty
    if b"/Encrypt" in content:
        return empty | {"readable": True, "encrypted": True, "pages": len(_PAGE.findall(content))}
    try:
        objects = _objects(content)
        pages = _in_order(objects)
        if not pages:
            return empty
        own = objects[pages[page]] if 0 <= page < len(pages) else b""
        box = _BOX.search(own) or _BOX.search(content) or next((m for b in objects.values() if (m := _BOX.search(b))), None)
        width, height = (float(box[3]) - float(box[1]), float(box[4]) - float(box[2])) if box else (612.0, 792.0)
        left, low = (float(box[1]), float(box[2])) if box else (0.0, 0.0)
        named = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", own, re.S)
        parts = [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", (named[1] or named[2]) if named else b"")]
        if own and not named:  # a page that names no content: all content of the file
            parts = [n for n, b in objects.items() if b"stream" in b and not re.search(rb"/ObjStm|/XObject|/XRef|/FontFile", b.split(b"stream")[0])]
        data = b"\n".join(_unpacked(objects[n]) for n in parts if n in objects)
        return {"readable": True, "encrypted": False, "pages": len(pages), "page_width": width, "page_height": height, "items": _items(data, height, left, low)}
    except (zlib.error, ValueError, ArithmeticError):
        return empty


def _times(a: tuple, b: tuple) -> tuple:
    """The transform that does ``a`` and then ``b``."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def _shown(token: bytes) -> str:
    """The text of a string operand."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1], token[1:-1], flags=re.S).decode("latin-1")


def _items(data: bytes, height: float, left: float = 0.0, low: float = 0.0) -> list[dict]:
    out, args, ops = [], [], []
    start = {"ctm": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "stroke": [0.0, 0.0, 0.0], "fill": [0.0, 0.0, 0.0], "width": 1.0, "size": 10.0, "lead": 0.0}
    state, stack = dict(start), []
    here = first = (0.0, 0.0)
    line = text_at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def place(x, y, by=None):
        a = by or state["ctm"]
        return {"x": a[0] * x + a[2] * y + a[4] - left, "y": height - (a[1] * x + a[3] * y + a[5] - low)}

    def scale() -> float:
        a = state["ctm"]
        return abs(a[0] * a[3] - a[1] * a[2]) ** 0.5

    def segment(kind, *points):
        ops.append({"op": kind, "points": [place(*p) for p in points]})

    def grey(v):
        return [v, v, v]

    def cmyk(c):
        return [(1 - v) * (1 - c[3]) for v in c[:3]]

    for token in _TOKEN.findall(data):
        if not token[:1].isalpha() and token[:1] not in (b"'", b'"', b"*"):
            args.append(token)
            continue
        op, a = token.decode("latin-1"), args
        n = [float(v) for v in a if _NUMBER.fullmatch(v)]
        args = []
        if len(n) < _NEEDS.get(op, 0):
            continue
        n = n[-_NEEDS[op] :] if op in _NEEDS else n
        if op == "q":
            stack.append(dict(state))
        elif op == "Q":
            state = stack.pop() if stack else dict(start)
        elif op == "cm":
            state["ctm"] = _times(tuple(n), state["ctm"])
        elif op == "m":
            here = first = (n[0], n[1])
        elif op == "l":
            segment("l", here, n)
            here = (n[0], n[1])
        elif op in ("c", "v", "y"):
            points = [here, *[(n[i], n[i + 1]) for i in range(0, len(n), 2)]]
            if op == "v":
                points.insert(1, here)
            elif op == "y":
                points.append(points[-1])
            segment("c", *points)
            here = points[-1]
        elif op == "h":
            if here != first:
                segment("l", here, first)
            here = first
        elif op == "re":
            x, y, w, h = n
            t = state["ctm"]
            if t[1] == t[2] == 0:
                p, q = place(x, y), place(x + w, y + h)
                ends = [{"x": f(p["x"], q["x"]), "y": f(p["y"], q["y"])} for f in (min, max)]
                ops.append({"op": "re", "points": ends})
            else:
                # A turned rectangle is a quad: its corners in the order upper left, upper right, lower left, lower right.
                segment("qu", (x, y + h), (x + w, y + h), (x, y), (x + w, y))
            here = first = (x, y)
        elif op == "w":
            state["width"] = n[0]
        elif op in ("RG", "rg", "G", "g", "K", "k"):
            state["stroke" if op.isupper() else "fill"] = list(n) if len(n) == 3 else grey(n[0]) if len(n) == 1 else cmyk(n)
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
            if op in ("s", "b", "b*") and ops and here != first:
                segment("l", here, first)
            if ops:
                strokes, fills = op in ("S", "s", "B", "B*", "b", "b*"), op not in ("S", "s")
                out.append({
                    "ops": ops, "stroke": list(state["stroke"]) if strokes else None, "fill": list(state["fill"]) if fills else None,
                    "width": state["width"] * scale() if strokes else None, "text": None, "size": None, "x": None, "y": None,
                })
            ops = []
        elif op == "n":
            ops = []
        elif op == "BT":
            line = text_at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif op == "Tf":
            state["size"] = n[0]
        elif op == "TL":
            state["lead"] = n[0]
        elif op in ("Td", "TD"):
            state["lead"] = -n[1] if op == "TD" else state["lead"]
            line = text_at = _times((1.0, 0.0, 0.0, 1.0, n[0], n[1]), line)
        elif op == "Tm":
            line = text_at = tuple(n)
        elif op in ("T*", "'", '"', "Tj", "TJ"):
            if op not in ("Tj", "TJ"):
                line = text_at = _times((1.0, 0.0, 0.0, 1.0, 0.0, -state["lead"]), line)
            text = "".join(_shown(t) for t in a if t[:1] in (b"(", b"<"))
            by = _times(text_at, state["ctm"])
            if text.strip():
                size = state["size"] * abs(by[0] * by[3] - by[1] * by[2]) ** 0.5
                p = place(0, 0, by)
                out.append({"ops": [], "stroke": None, "fill": None, "width": round(size, 2), "text": text.strip(), "size": size, "x": p["x"], "y": p["y"]})
            # The next string of a line goes behind this one; widths of glyphs are taken as 0.6 of the size.
            text_at = _times((1.0, 0.0, 0.0, 1.0, 0.6 * state["size"] * len(text), 0.0), text_at)
    return out


def read_pdf(spark: SparkSession, path: str, pattern: str = "*.pdf", page: int = 0) -> DataFrame:
    """One row per file: path, size, head, content_hash and what the scan of one page found."""
    ship(spark)

    @F.pandas_udf(FILE)
    def scanned(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(bytes(c), page) for c in content], columns=["readable", "encrypted", "pages", "page_width", "page_height", "items"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 5), "iso-8859-1")
    return files.select("path", F.col("length").alias("size"), head.alias("head"), F.sha2("content", 256).alias("content_hash"), scanned("content").alias("scan")).select("path", "size", "head", "content_hash", "scan.*")


def checked(files: DataFrame, page=0) -> DataFrame:
    """Adds ``reason``: why a file is rejected, or null."""
    paths = F.size(F.filter("items", lambda i: i["text"].isNull()))
    words = F.size(F.filter("items", lambda i: i["text"].isNotNull()))
    return files.withColumn("reason", validation_reason(F.col("path"), F.col("size"), F.col("head"), F.col("readable"), F.col("encrypted"), F.lit(page), F.col("pages"), paths, words))


def to_entities(files: DataFrame) -> DataFrame:
    """``files`` with comparison_id and revision to entity rows: paths become linework, texts text or dimension."""
    i = files.select("comparison_id", "revision", F.posexplode("items").alias("ordinal", "i"))
    kind = {"l": "line", "re": "rect", "c": "curve", "qu": "quad"}
    names = F.create_map(*[F.lit(v) for kv in kind.items() for v in kv])
    ops = F.filter(F.col("i.ops"), lambda o: o["op"].isin(*kind))
    geometry = F.transform(ops, lambda o: F.struct(F.element_at(names, o["op"]).alias("kind"), o["points"].alias("points")))
    points = F.flatten(F.transform(F.col("i.ops"), lambda o: o["points"]))
    low = lambda c: F.array_min(F.transform(points, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(points, lambda p: p[c]))
    text = F.col("i.text")
    label, value = parse_dimension(text)
    is_text = text.isNotNull()
    span = F.char_length(text) * F.col("i.size") * 0.6
    colour = lambda c: F.when(F.col(f"i.{c}").isNotNull(), colour_hex(*[F.col(f"i.{c}")[k] for k in range(3)]))
    out = i.where(is_text | (F.size(ops) > 0)).select(
        "comparison_id", "revision", F.col("ordinal").cast("long").alias("ordinal"),
        F.when(label.isNotNull(), "dimension").when(is_text, "text").otherwise("linework").alias("kind"), geometry.alias("geometry"),
        F.when(is_text, F.col("i.x")).otherwise(low("x")).alias("x0"), F.when(is_text, F.col("i.y") - F.col("i.size")).otherwise(low("y")).alias("y0"),
        F.when(is_text, F.col("i.x") + span).otherwise(high("x")).alias("x1"), F.when(is_text, F.col("i.y")).otherwise(high("y")).alias("y1"),
        text.alias("text_payload"), label.alias("label"), value.alias("dimension_value"), colour("stroke").alias("stroke"), colour("fill").alias("fill"),
        F.col("i.width").alias("width"), F.when(is_text, F.col("i.x")).alias("anchor_x"), F.when(is_text, F.col("i.y")).alias("anchor_y"),
        F.lit(None).cast("string").alias("semantic_label"), F.lit(None).cast("double").alias("semantic_confidence"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTITY.fields])


#: Readers by format.
PROVIDERS = {"pdf": read_pdf}


def provider(fmt: str):
    if fmt not in PROVIDERS:
        raise ValueError(f"no reader for {fmt!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[fmt]
