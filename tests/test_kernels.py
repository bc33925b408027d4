import io
import re
import zipfile

import pytest

from scrubjay.kernels import bib, docx, exif, formats, images, tex, xmp
from scrubjay.kernels.base import Malformed, Policy, spliced
from scrubjay.plans import samples

ALL = Policy(True, True)
PAPER = rb"""% !TeX root = /home/ann/thesis/paper.tex
\documentclass{article}
\author[A. B.]{Ann Bee\thanks{Firm}}
\author*{Ann Bee}
\hypersetup{pdftitle={T, U}, pdfauthor={Ann}, colorlinks=true}
Up 100\% and \url{a%20b}, \verb|%x| and \lstinline[o]{a % b}.
\begin{lstlisting}
# 5% stays
\end{lstlisting}
text% goes
\input sections/one
\todo[author=AB, inline]{x}
\begin{comment}
hidden % stays
\end{comment}
\endinput
tail"""


def test_tex_changes_only_what_identifies():
    out = tex.scrub_tex(PAPER, Policy())
    assert b"Ann" not in out.data and b"Firm" not in out.data and b"/home" not in out.data and b"\\author[]{}" in out.data
    for kept in (b"100\\%", b"\\url{a%20b}", b"\\verb|%x|", b"\\lstinline[o]{a % b}", b"# 5% stays", b"hidden % stays", b"pdftitle={T, U}", b"colorlinks=true", b"author=AB", b"text%\n"):
        assert kept in out.data
    said = " ".join(f"{r.where} {r.what}" for r in out.removals)
    assert "references 1 other" in said and "content after \\endinput" in said and "comment environment" in said
    assert not tex.scrub_tex(out.data, Policy()).changed
    strict = tex.scrub_tex(PAPER, ALL)
    assert b"author=Author, inline" in strict.data and not tex.scrub_tex(strict.data, ALL).changed
    assert re.sub(rb"(?m)%.*$", b"%", PAPER).count(b"# 5%\n") == 1  # what a plain pattern would have broken


@pytest.mark.parametrize("data", [b"", b"\\", b"%", b"\\verb|unclosed\n% c\n", b"\\url{", b"\\author{", b"\\begin{verbatim}", b"\\hypersetup{pdfauthor", b"\\pdfinfo{/Author (", b"\\added[id=", b"\\author{\\author{x}}", b"\xff\xfe%\xe9"])
def test_tex_oddities(data):
    out = tex.scrub_tex(data, ALL)
    assert tex.scrub_tex(out.data, ALL).data == out.data


def test_unclosed_verb_does_not_swallow_comments():
    assert [s.kind for s in tex.spans(b"\\verb|unclosed\n% c\n")] == ["control", "comment"]


def test_dialects():
    sty = b"%% pkg\n%% more\n% last\n\\author{A}\\x % aside\n% MIT License\n"
    assert tex.scrub_tex(sty, Policy(), "latex-package").data == b"%% pkg\n%% more\n% last\n\\author{}\\x %\n% MIT License\n"
    assert not tex.scrub_tex(b"% only\n\\author{A}", Policy(), "latex-docstrip").changed
    assert not tex.scrub_tex(b"\\catcode`\\%=12 \\author{A}", Policy()).changed


def test_bib():
    data = b'@a{k,\n file = {x, y},\n note = "a, {b} file = {c}",\n Owner = me,\n timestamp = {1},\n}\n@b(k, pdf = (z), t = {@x{file=1}})\n@c{open, file = {'
    out = bib.scrub_bib(data, Policy())
    assert b"x, y" not in out.data and b"Owner" not in out.data and b"pdf" not in out.data
    assert b'"a, {b} file = {c}"' in out.data and b"timestamp" in out.data and b"{@x{file=1}}" in out.data
    assert b"timestamp" not in bib.scrub_bib(data, ALL).data and not bib.scrub_bib(out.data, Policy()).changed


def test_edits_that_overlap_are_errors():
    assert spliced(b"abcdef", [(4, 5, b"X"), (0, 2, b"")]) == b"cdXf"
    with pytest.raises(ValueError):
        spliced(b"abcdef", [(0, 3, b""), (2, 5, b"")])


@pytest.mark.parametrize("i", range(0, 60, 7))
def test_pictures(i):
    for data, run in ((samples.jpeg(i), images.scrub_jpeg), (samples.png(i), images.scrub_png)):
        out = run(data, Policy())
        for secret in (b"Annie", b"Cams", b"SN0", b"CreatorTool", b"GPSLatitude"):
            assert secret not in out.data
        assert not run(out.data, Policy()).changed
    block = exif.scrub_exif(samples.exif(i), Policy())[0]
    left = {(w, e.tag): e.value for w, e in exif.entries_of(block)}
    assert left[("IFD0", 0x0112)] == b"\x06\0" and ("Exif", 0x829A) in left and not any(w in ("GPS", "IFD1") for w, _ in left)
    assert samples.jpeg(i).endswith(images.scrub_jpeg(samples.jpeg(i), Policy()).data[-12:])


def test_big_endian_exif_and_location_in_the_sub_directory():
    import struct

    sub, values = samples.directory([(0x8825, 4, 1, struct.pack(">I", 0)), (0x829A, 3, 1, b"\0\x01")], 0, 0, ">")
    main = samples.directory([(0x8769, 4, 1, struct.pack(">I", 26))], 0, 0, ">")[0]
    block = b"MM" + struct.pack(">HI", 42, 8) + main + sub
    new, found = exif.scrub_exif(block, Policy())
    assert [r.what for r in found] == ["GPS IFD"] and [hex(e.tag) for _, e in exif.entries_of(new)] == ["0x8769", "0x829a"]


@pytest.mark.parametrize("data", [b"", b"\xff\xd8\xff", b"\xff\xd8\x00", b"\xff\xd8\xff\xe1\xff\xff", b"\xff\xd8\xff\xe1\x00\x01", images.PNG_SIGNATURE + b"\0\0\0\x09IHDR"])
def test_malformed_pictures(data):
    kind = "png" if data.startswith(b"\x89") else "jpeg"
    if data in (b"\xff\xd8\xff",):  # a lone fill byte
        assert images.scrub_jpeg(data, Policy()).data == data
        return
    with pytest.raises(Malformed):
        formats.scrub(data, kind, "", Policy())
    assert formats.facts_of(data, kind).unrecognized


def test_malformed_metadata():
    assert exif.scrub_exif(b"XX", Policy()) == (b"", [("EXIF", "entire block", "unparseable: too short", True)])
    assert xmp.scrub_xmp(b"<x", False) == (b"<x", [])
    bomb = b'<!DOCTYPE x [<!ENTITY a "b">]><x xmlns:x="adobe:ns:meta/"/>'
    assert xmp.scrub_xmp(bomb, False) == (bomb, [])


def test_xmp_never_loses_the_link_to_a_manifest():
    packet = samples.packet(12, "https://m.example/1")
    new, found = xmp.scrub_xmp(packet, True)
    assert found and xmp.provenance_url(new) == "https://m.example/1" and b"Rating" in new


@pytest.mark.parametrize("i", [0, 1, 5, 60])
def test_office_documents(i):
    out = docx.scrub_docx(samples.docx(i), ALL)
    with zipfile.ZipFile(io.BytesIO(out.data)) as a, zipfile.ZipFile(io.BytesIO(samples.docx(i))) as b:
        assert a.namelist() == b.namelist() and a.read("word/media/a.bin") == b.read("word/media/a.bin")
        everything = b"".join(map(a.read, a.namelist()))
    assert b"Annie" not in everything and b"Firmco" not in everything and b"rsid" not in everything
    assert not docx.scrub_docx(out.data, ALL).changed


def test_credentials():
    assert formats.facts_of(samples.credentials(1), "jpeg").embedded
    assert formats.facts_of(samples.credentials(2), "jpeg").remote_url == "https://m.example/2"
    assert formats.facts_of(samples.credentials(3), "jpeg").unrecognized
    assert formats.facts_of(samples.credentials(4), "jpeg") == formats.Facts()
    assert formats.facts_of(b"talk of jumb and c2pa", None) == formats.Facts() and formats.facts_of(samples.box(), None).unrecognized
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META/c2pa.bin", "x")
    assert formats.facts_of(out.getvalue(), "docx").unrecognized


def pdf_of(info: bytes, trailer: bytes = b"", more: bytes = b"") -> bytes:
    head = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog " + more + b">>\nendobj\n"
    body = head + b"2 0 obj\n" + info + b"\nendobj\n"
    table = b"xref\n0 3\n0000000000 65535 f \n%010d 00000 n \n%010d 00000 n \n" % (9, len(head))
    return body + table + b"trailer\n<< /Size 3 /Root 1 0 R /Info 2 0 R " + trailer + b">>\nstartxref\n%d\n%%%%EOF\n" % len(body)


def test_pdf_in_place_and_every_revision():
    from scrubjay.kernels.pdf import scrub_pdf

    first = pdf_of(b"<< /Author (An\\)n (x)) % /Author (c)\n/Title (/Author \\( t) /#43ompany <41 42> /Keywords [(a) << /b (c) >>] /ModDate (D:1) >>")
    again = first + b"2 0 obj\n<< /Author (Later) /Title (U) >>\nendobj\n"
    table = len(again)
    again += b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 3 /Root 1 0 R /Info 2 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (len(first), first.index(b"xref"), table)
    out = scrub_pdf(again, Policy())
    assert len(out.data) == len(again) and [r.what for r in out.removals] == ["Author", "Keywords", "Company"]
    for gone in (b"Ann", b"An\\)n", b"Later", b"41 42", b"/Keywords"):
        assert gone not in out.data
    for kept in (b"/Title (/Author \\( t)", b"/Title (U)", b"/ModDate (D:1)", b"%%EOF"):
        assert kept in out.data
    assert not scrub_pdf(out.data, Policy()).changed
    assert [r.what for r in scrub_pdf(again, Policy(strip_dates=True)).removals] == ["Author", "Keywords", "Company", "ModDate"]


@pytest.mark.parametrize("data", [b"%PDF-1.4", pdf_of(b"<< >>", b"/Encrypt 9 0 R "), pdf_of(b"<< /Type /ObjStm >>"), pdf_of(b"<< /Type /Metadata /Filter /FlateDecode >>\nstream\nxx\nendstream"), pdf_of(b"<<" * 300), pdf_of(b"<< /Author (x"), pdf_of(b"<< /Author "), b"%PDF-1.4\nstartxref\n5\n", pdf_of(b"<< /A 1 >>").replace(b"0000000009", b"0000000010")])
def test_pdfs_that_cannot_be_read_are_errors(data):
    from scrubjay.kernels.pdf import scrub_pdf
    from scrubjay.operators.scrub import scrubbed_bytes

    with pytest.raises(ValueError):
        scrub_pdf(data, Policy())
    new, _, _, changed, error = scrubbed_bytes(data, "pdf", ".pdf", Policy())
    assert new is None and not changed and error


def test_label_across_blocks_of_an_entry(monkeypatch):
    import io
    import zipfile

    from scrubjay.kernels import formats

    box = (40).to_bytes(4, "big") + b"jumb" + b"x" * 20 + b"c2pa" + b"y" * 40
    for block in (16, 33, 64, 1 << 20):
        monkeypatch.setattr(formats, "ENTRY_BLOCK", block)
        for before in (0, 1, 13, 50):
            for payload, want in ((b"z" * before + box, True), (b"z" * before + box.replace(b"c2pa", b"c3pa"), False), (b"z" * before + (9999).to_bytes(4, "big") + box[4:], False)):
                made = io.BytesIO()
                with zipfile.ZipFile(made, "w") as z:
                    z.writestr("a", payload)
                assert formats.archive_has_label(made.getvalue()) == want == formats.box_with_label(payload), (block, before)


def test_small_files_come_in_few_rows_at_once():
    """Findings about small files take more room than their bytes, so bytes alone are no bound of a worker's memory."""
    import pyarrow as pa

    from scrubjay.operators.scrub import BATCH_BYTES, BATCH_ROWS, small

    data = [b"x"] * 1000 + [b"y" * (BATCH_BYTES // 2 + 1)] * 3 + [None]
    parts = list(small(iter([pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["content"])]), 0))
    assert max(p.num_rows for p in parts) <= BATCH_ROWS <= 512 and BATCH_BYTES <= 2 << 20
    assert [v for p in parts for v in p.column(0).to_pylist()] == data and [p.num_rows for p in parts[-2:]] == [1, 2]


def test_kernels_get_small_batches(spark, sf_dir):
    """Once the query is made, the session's batches have a limit in bytes."""
    from scrubjay.plans import queries

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for query in ("x_png_bytes", "x_docx", "l_revisions", "x_xmp"):
        spark.conf.unset(name)
        queries.QUERIES[query](spark, sf_dir)
        assert int(spark.conf.get(name)) <= 1 << 20
