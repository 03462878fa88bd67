"""Small writers of file formats, as columns: they make the files that the file queries read back."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_STAMP = (1980, 1, 1, 0, 0, 0)


def zipped(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, _STAMP), data)
    return out.getvalue()


def _docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return zipped([("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'.encode())])


def _xlsx(cells: list[str]) -> bytes:
    shared = "".join(f"<si><t>{escape(x)}</t></si>" for x in cells)
    row = "".join(f'<c t="s"><v>{k}</v></c>' for k in range(len(cells))) + "<c><v>7</v></c>"
    return zipped([
        ("xl/workbook.xml", b'<workbook><sheets><sheet name="First"/></sheets></workbook>'), ("xl/sharedStrings.xml", f"<sst>{shared}</sst>".encode()),
        ("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{row}</row></sheetData></worksheet>".encode()),
    ])


def _pptx(slides: list[str]) -> bytes:
    return zipped([(f"ppt/slides/slide{k}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:sld>'.encode()) for k, x in enumerate(slides, 1)])


def _mbox(bodies: list[str]) -> bytes:
    out = []
    for k, body in enumerate(bodies):
        refs = f"References: <m{k - 1}@x>\n" if k else ""
        coded = base64.encodebytes(body.encode()).decode()
        out.append(f"From x\nMessage-ID: <m{k}@x>\n{refs}Subject: Re: =?utf-8?b?{base64.b64encode('Çase'.encode()).decode()}?=\nFrom: a@b\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n{coded}")
    return "\n".join(out).encode()


def _zip(texts: list[str]) -> bytes:
    inner = zipped([("deep.txt", texts[-1].encode())])
    return zipped([*((f"m{k}.txt", x.encode()) for k, x in enumerate(texts)), ("../out.txt", b"no"), ("more.zip", inner)])


def _pdf(lines: list[str]) -> bytes:
    shown = "BT /F1 9 Tf " + " ".join(f"1 0 0 1 50 {700 - 20 * k} Tm ({x}) Tj" for k, x in enumerate(lines)) + " ET"
    packed = zlib.compress(shown.encode("latin-1"))
    return b"".join((
        b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n",
        b"3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>>>> endobj\n",
        b"4 0 obj <</Length %d /Filter /FlateDecode>> stream\n" % len(packed), packed, b"\nendstream endobj\n5 0 obj <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>> endobj\n%%EOF",
    ))


def _column(write):
    @F.pandas_udf(BinaryType())
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else write([x or "" for x in p]))

    return run


docx, xlsx, pptx, mbox, archive, pdf = map(_column, (_docx, _xlsx, _pptx, _mbox, _zip, _pdf))
