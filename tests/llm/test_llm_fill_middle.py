"""Fill-in-the-middle against a plain transformation."""

import re
from hashlib import sha256

import pytest

from tillscope.llm import fill_middle

SCHEMA = "doc_id long, text string, h1 string, place int, n int"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def plain(doc_id, text):
    text = text or ""
    units = re.findall(UNIT, text)
    n = len(units)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def digested(row):
    return (*row[:5], *(sha256(t.encode()).hexdigest() for t in row[5:]))


TEXTS = [
    "", None, " ", "\n\t \x0b\x0c\r", "one", " one ", "one two three four é🙂 \x85 five", "a <P> b", "<S>", "x<M",
    "tail \n\n", "word " * 20_000, "é" * 150_000, "🙂 " * 40_000 + "\n", "a" * 70_000 + " b " * 5000,
]
ROWS = [(100 * i + k, text) for i, text in enumerate(TEXTS) for k in range(9)]
ROWS += [(None, "no id at all"), (None, "no id at all"), (None, None), (7, "shared id"), (7, "shared id two"), (7, "shared id"), (-3, "a b c")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], SCHEMA).repartition(6)


def test_digests_equal_plain_python(table):
    found = sorted((tuple(r) for r in fill_middle.fill_in_middle(table).collect()), key=str)
    assert found == sorted((digested(plain(*r)) for r in ROWS), key=str)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(table.limit(0)).collect() == []


def test_output_texts(table):
    found = sorted((tuple(r) for r in fill_middle.output_texts(table).collect()), key=str)
    assert found == sorted((plain(*r)[:6] for r in ROWS), key=str)


@pytest.mark.parametrize("units,size", [(1, 1 << 16), (3, 10), (4096, 7)])
def test_pieces_put_a_text_together(monkeypatch, units, size):
    monkeypatch.setattr(fill_middle, "UNITS", units)
    monkeypatch.setattr(fill_middle, "PIECE", size)
    for text in (t.encode()[:3000] for t in TEXTS if t):
        ends = fill_middle.unit_ends(text)
        for start, end in [(0, len(text)), (0, int(ends[len(ends) // 2])), (int(ends[len(ends) // 2]), len(text))]:
            own = list(fill_middle.pieces(text, start, end, ends))
            assert b"".join(own) == text[start:end] and all(0 < len(p) <= size for p in own)


def test_rows_that_are_wholly_equal(spark):
    rows = [(3, "the same row of text " * 20)] * 500
    found = fill_middle.fill_in_middle(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [digested(plain(*rows[0]))] * 500
