"""Files that hold further end marks are carved whole."""

import io
import zipfile

from foldwise.llm import media


def pdf(revisions, linearised=False):
    out = b"%PDF-1.7\n"
    if linearised:
        first = len(out)
        out += b"xref\n0 1\ntrailer\nstartxref\n0\n%%EOF\n1 0 obj\nendobj\nstartxref\n" + str(first).encode() + b"\n%%EOF"
    for j in range(revisions):
        out += b"\n%d 0 obj\nendobj\n" % j
        out += b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(out)
    return out


def archive(name, content):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as f:
        f.writestr(name, content)
    return made.getvalue()


def test_pdf_revisions():
    for file in (pdf(1), pdf(3), pdf(0, linearised=True), pdf(2, linearised=True), b"%PDF-1.4 broken %%EOF"):
        for before, after in ((b"", b""), (b"junk", b"junk %%EOF"), (b"", b"\n" + pdf(2)), (b"", file)):
            assert media.pdf_end(before + file + after, len(before)) == len(before) + len(file)
    assert media.pdf_end(b"%PDF-1.4 no end", 0) == -1


def test_archive_in_archive():
    inner = archive("a.txt", b"text" * 9)
    outer = archive("inner.zip", archive("b.zip", inner))
    found = media.segments(b"junk" + outer + b"PK\x05\x06")
    assert found[0] == ("application/zip", 4, 4 + len(outer)) and len(found) == 3
    assert media.zip_end(outer[:-1], 0) == -1
