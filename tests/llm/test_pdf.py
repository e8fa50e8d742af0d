"""Ends of PDF files: far away, several, and none."""

import time

from windgrid.llm import media

ONE = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
SAVED = ONE + b"\n1 0 obj\nendobj\nstartxref\n30\n%%EOF"


def test_end_beyond_64_mib():
    blob = b"%PDF-1.7\n" + b"\0" * (65 << 20) + b"\nstartxref\n0\n%%EOF\n"
    assert media.sniff(blob) == ("application/pdf", len(blob) - 1, [])


def test_last_end_mark_of_the_file():
    assert media.sniff(SAVED) == ("application/pdf", len(SAVED), [])
    assert media.sniff(b"text " + SAVED + b" between " + ONE)[2] == [("application/pdf", 5, len(SAVED)), ("application/pdf", 14 + len(SAVED), len(ONE))]
    assert media.sniff(SAVED + b" %%EOF")[1] == len(SAVED)


def test_file_within_a_file():
    blob = b"%PDF-1.4\nstream\n" + ONE + b"\nendstream\nstartxref\n9\n%%EOF"
    assert media.sniff(blob) == ("application/pdf", len(blob), [])


def test_headers_without_an_end():
    start = time.time()
    assert media.sniff(b"%PDF-1.4 and no more\n" * 200_000)[1:] == (0, [])
    assert time.time() - start < 20
