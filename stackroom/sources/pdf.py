"""Text of PDF files without other software: plain and Flate streams, literal and hexadecimal strings.

Fonts that number their glyphs on their own (no Latin encoding) give the bytes they use, and
encrypted files give nothing: a reader with fonts would do better, and its text can be fed to
:func:`joined_pages` instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES, ENOUGH, KEPT = 2000, 400_000, 200_000

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/()<>\[\]]+|[-+.\d]+|[A-Za-z'\"*]+[0-9*]?", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return _decoded(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
    plain = _ESCAPE.sub(lambda m: _NAMED.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else m[1]), token[1:-1])
    return _decoded(plain)


def _stream(body: bytes) -> bytes | None:
    found = _STREAM.match(body)
    if not found:
        return None
    if b"FlateDecode" not in found[1]:
        return None if b"/Filter" in found[1] else found[2]
    try:
        return zlib.decompressobj().decompress(found[2])
    except zlib.error:
        return None


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" not in body or (inner := _stream(body)) is None:
            continue
        first = re.search(rb"/First\s+(\d+)", body)
        if first is None:
            continue
        start = int(first[1])
        numbers = [int(x) for x in inner[:start].split()]
        places = list(zip(numbers[::2], numbers[1::2]))
        for (number, at), (_, end) in zip(places, [*places[1:], (0, len(inner) - start)]):
            found.setdefault(number, inner[start + at : start + end])
    return found


def _shown(content: bytes) -> str:
    """What a content stream shows, a line for each change of line."""
    out, waiting, inside = [], [], False
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            waiting.append(_string(token))
        elif token == b"BT":
            inside, waiting = True, []
        elif token in (b"Tj", b"TJ", b"'", b'"') and inside:
            if token in (b"'", b'"'):
                out.append("\n")
            out += waiting
            waiting = []
        elif token in (b"Td", b"TD", b"T*", b"ET") and inside:
            out.append("\n")
            waiting, inside = [], token != b"ET"
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def page_texts(data: bytes, pages: int = PAGES, enough: int = ENOUGH) -> list[str]:
    """The pages' texts in order; stops after ``pages`` pages or past ``enough`` characters. No PDF, no pages."""
    if not data.startswith(b"%PDF") or b"/Encrypt" in data:
        return []
    objects = _objects(data)
    order: list[int] = []
    seen: set[int] = set()

    def walk(number: int) -> None:
        if number in seen or len(order) >= pages:
            return
        seen.add(number)
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for m in _REFERENCE.finditer(kids[1]):
                walk(int(m[1]))
        elif re.search(rb"/Type\s*/Page\b", body):
            order.append(number)

    for body in objects.values():
        if re.search(rb"/Type\s*/Catalog\b", body) and (top := re.search(rb"/Pages\s+(\d+)", body)):
            walk(int(top[1]))
    out, total = [], 0
    for number in order:
        held = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[number], re.S)
        parts = [_stream(objects.get(int(m[1]), b"")) for m in _REFERENCE.finditer(held[1])] if held else []
        out.append("\n".join(t for t in (_shown(p) for p in parts if p) if t))
        total += len(out[-1])
        if total > enough:
            break
    return out


def pdf_texts(files: DataFrame) -> DataFrame:
    """``(path, pages, text)`` of files ``(path, content)``: at most 200,000 characters of at most 2,000 pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [page_texts(bytes(c) if c is not None else b"") for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "pages": [len(t) for t in texts], "text": ["\n".join(t)[:KEPT] for t in texts]})

    return files.select("path", "content").mapInPandas(read, "path string, pages int, text string")


def joined_pages(pages: Column) -> Column:
    """The text of pages that another reader extracted, within the same bounds."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("n"))

    def add(s, page):
        text = F.coalesce(page, F.lit(""))
        return F.when(s["n"] > ENOUGH, s).otherwise(F.struct(F.array_append(s["out"], text).alias("out"), (s["n"] + F.length(text)).alias("n")))

    return F.substring(F.array_join(F.aggregate(F.slice(pages, 1, PAGES), start, add, lambda s: s["out"]), "\n"), 1, KEPT)
