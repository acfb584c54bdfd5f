"""Text of PDF files: plain and packed streams, objects in streams, bounds."""

import zlib

from pyspark.sql import functions as F

from stackroom.sources import pdf


def make(contents, packed=True, grouped=False):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + k) for k in range(len(contents))) + b"] >>"}
    for k, _ in enumerate(contents):
        objects[10 + k] = b"<< /Type /Page /Contents [%d 0 R] >>" % (1000 + k)
    out = b"%PDF-1.5\n"
    if grouped:
        inner, places = b"", []
        for n, body in objects.items():
            places.append(b"%d %d" % (n, len(inner)))
            inner += body + b" "
        head = b" ".join(places) + b"\n"
        data = zlib.compress(head + inner)
        out += b"5 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n" % (len(objects), len(head)) + data + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % x for x in objects.items())
    for k, c in enumerate(contents):
        data = zlib.compress(c) if packed else c
        out += b"%d 0 obj << /Length %d%s >>\nstream\n" % (1000 + k, len(data), b" /Filter /FlateDecode" if packed else b"") + data + b"\nendstream endobj\n"
    return out


PAGES = [rb"BT (One \(1\)\051) Tj T* [(t) -20 (wo)] TJ ET", b"q (not shown) BT <FEFF00E9> Tj 0 -14 Td (line) Tj (next) ' ET Q", b""]


def test_pages_in_order():
    want = ["One (1))\ntwo", "é\nline\nnext", ""]
    for packed in (True, False):
        for grouped in (True, False):
            assert pdf.page_texts(make(PAGES, packed, grouped)) == want
    assert pdf.page_texts(b"no pdf") == [] and pdf.page_texts(b"%PDF-1.4 broken") == []
    assert pdf.page_texts(make(PAGES) + b"trailer << /Encrypt 9 0 R >>") == []


def test_bounds():
    many = make([b"BT (%d) Tj ET" % k for k in range(30)])
    assert pdf.page_texts(many, pages=7) == [str(k) for k in range(7)]
    assert len(pdf.page_texts(many, enough=5)) == 6


def test_files_and_pages_of_other_readers(spark):
    rows = [("a", make(PAGES)), ("b", None), ("c", b"")]
    got = {r["path"]: (r["pages"], r["text"]) for r in pdf.pdf_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": (3, "One (1))\ntwo\né\nline\nnext\n"), "b": (0, ""), "c": (0, "")}
    long = ["x" * 150_000] * 4
    out = spark.createDataFrame([(long,), (["a", None, "b"],)], "pages array<string>").select(F.length(pdf.joined_pages(F.col("pages"))).alias("n")).collect()
    assert [r["n"] for r in out] == [200_000, 4]
