"""White space, figures from bytes, layout items."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as X
from lexquarry.operators import cleaning as C
from lexquarry.operators import figures as G
from lexquarry.operators import items as I
from lexquarry.operators import quality as Q
from lexquarry.plans.parsing import png


def test_white_space_is_all_white_space(spark):
    all_white = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert set(X.WHITE) == set(all_white)
    texts = [f"{all_white}a{all_white}b​{c}c{all_white}" for c in all_white] + [" 　", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.strip(F.col("t")).alias("s"), X.words(F.coalesce("t", F.lit(""))).alias("w"), F.regexp_replace("t", X.white(r"\s+"), "_").alias("r"), F.regexp_replace("t", X.white(r"[\sx]+"), "_").alias("q"), F.regexp_replace("t", X.white(r"[^\S\n]+"), "_").alias("n")).collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.s, r.w) == ((t or "").strip(), (t or "").split())
        if t is not None:
            assert (r.r, r.q, r.n) == (re.sub(r"\s+", "_", t), re.sub(r"[\sx]+", "_", t), re.sub(r"[^\S\n]+", "_", t))
    assert X.white(r"a\\s[^>]*\S") == r"a\\s[^>]*[^" + X.WHITE_RANGES + "]"
    with pytest.raises(ValueError, match="set"):
        X.white(r"[\S]")
    assert X.white_sql(r"SELECT '\s', 'it''s', x[1]") == f"SELECT '[{X.WHITE_RANGES}]', 'it''s', x[1]"


def test_a_page_of_hard_spaces_is_empty(spark):
    df = spark.createDataFrame([("  ",), ("a b",)], "t string")
    flags = [r.f for r in df.select(Q.page_flags(F.col("t"), F.lit(0)).alias("f")).collect()]
    assert [(f.text_length, f.n_words, f.is_empty) for f in flags] == [(0, 0, True), (3, 2, False)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("réimplemen-\ntation", "réimplemen-\ntation"), ("implemen-\ntationé", "implemen-\ntationé"), ("é implemen-\ntation é", "é implementation é"), ("infor- mation", "information"), ("implemen-　\n tation", "implementation"), ("Größe imple-\nmentation", "Größe implementation")],
)
def test_hyphens_beside_other_letters(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(C.repaired(F.col("t"))["text"].alias("x")).first().x == expected


# ---- figures ----


def made_png(samples, color, depth, filters, palette=b""):
    """A PNG of rows of sample bytes (already packed), with a filter for each row, written from the specification."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color] * depth // 8)
    out, before = b"", bytes(len(samples[0]))
    for row, kind in zip(samples, filters, strict=True):
        coded = bytearray()
        for x, v in enumerate(row):
            a, b, c = row[x - step] if x >= step else 0, before[x], before[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind]) + bytes(coded)
        before = row
    return out, step


def png_file(width, height, depth, color, data, palette=b"", interlaced=0):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    packed = zlib.compress(data)
    half = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("color", "channels"), [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_values_of_each_filter(color, channels, depth):
    rng = random.Random(color + depth)
    rows = [bytes(rng.choice([0, 3, 7, 200, 255, rng.randrange(256)]) for _ in range(5 * channels * depth // 8)) for _ in range(10)]
    data, _ = made_png(rows, color, depth, [k % 5 for k in range(10)])
    expected = {v for r in rows for v in r[:: depth // 8]}
    assert G.png_values(png_file(5, 10, depth, color, data)) == len(expected)


def test_values_of_palettes_and_bits():
    palette = bytes([10, 20, 30, 10, 20, 31, 99, 98, 97, 1, 2, 3])
    rows = [bytes([0b00011011, 0b00000000]), bytes([0b01010101, 0b11000000])]  # two bits a sample, five samples a row
    data, _ = made_png(rows, 3, 2, [0, 2])
    assert G.png_values(png_file(5, 2, 2, 3, data, palette)) == len(set(palette))
    data, _ = made_png([bytes([0b10100000]), bytes([0])], 0, 1, [0, 0])
    assert G.png_values(png_file(3, 2, 1, 0, data)) == 2
    assert G.png_values(png_file(3, 2, 1, 0, data, interlaced=1)) is None


def test_sizes_of_other_kinds(spark):
    gif = b"GIF89a" + struct.pack("<HH", 300, 40) + b"\x00" * 10
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 41, -50) + bytes(20)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, 60, 70) + bytes(8)
    cases = [(gif, ("gif", 300, 40)), (bmp, ("bmp", 41, 50)), (jpeg, ("jpeg", 70, 60)), (png(5, 6, 2), ("png", 5, 6)), (png(5, 6, 2)[:20], None), (jpeg[:9], None), (b"", None), (b"text", None), (None, None)]
    assert [G.size_of(c) for c, _ in cases if c is not None] == [e for _, e in cases[:-1]]
    df = spark.createDataFrame([(bytearray(c) if c is not None else None,) for c, _ in cases], "c binary")
    got = [r.m for r in df.select(G.measured(F.col("c")).alias("m")).collect()]
    assert [(m.kind, m.width, m.height) if m.kind else None for m in got] == [e for _, e in cases] and got[3].n_values == 2
    broken = png_file(4, 4, 8, 2, b"short")
    assert G._measured(broken) == ("png", 4, 4, None)


def test_icons_keep_their_number(spark):
    rows = [("d", 1, 7, bytearray(png(30, 30, 9)), 50.0), ("d", 1, 9, bytearray(png(30, 50, 9)), 50.0), ("d", 1, 11, bytearray(b"no image"), None), ("d", 2, 1, None, 1.0)]
    found = {r.figure_id: r for r in G.figures(spark.createDataFrame(rows, "document_id string, page_number int, seq int, content binary, left double")).collect()}
    assert set(found) == {"fig_p1_2", "fig_p1_3", "fig_p2_1"}
    assert (found["fig_p1_2"].width, found["fig_p1_2"].keep, found["fig_p1_2"].reason) == (30, True, "preserved_small_security_symbol")
    assert found["fig_p1_2"].caption == "Embedded image (9, 30x50)" and found["fig_p1_3"].reason == found["fig_p2_1"].reason == "file_missing_or_unreadable"


# ---- layout items ----

ITEM = "document_id string, seq int, label string, text string, level int, page_no int, caption string, cells array<struct<row:int,column:int,row_span:int,column_span:int,text:string>>"


def test_grids_with_spans(spark):
    cells = [(0, 0, 1, 2, "A|B"), (0, 2, 2, 1, "tall"), (1, 0, 1, 1, "x\ny"), (1, 1, None, 0, None), (2, 1, 1, 1, "z"), (2, 2, 1, 1, "end")]
    df = spark.createDataFrame([("d", *c) for c in cells], "k string, row int, column int, row_span int, column_span int, text string")
    r = I.grids(df, ["k"]).first()
    assert (r.n_rows, r.n_columns) == (3, 3)
    assert r.markdown.split("\n") == ["| A\\|B | A\\|B | tall |", "| --- | --- | --- |", "| x y |  | tall |", "|  | z | end |"]


def test_page_records(spark):
    rows = [
        ("d", 0, "Section Heading", "Top", None, 1, None, None),
        ("d", 1, "title", "Deep", 9, 1, None, None),
        ("d", 2, "TABLE", "as text", None, 1, None, []),
        ("d", 3, "table", "", None, None, None, [(0, 0, 1, 1, "h"), (1, 0, 1, 1, "v")]),
        ("d", 4, "Picture", "said", None, 3, "", None),
        ("d", 5, "figure", None, None, 3, None, None),
        ("d", 6, "list_item", "one", None, 3, None, None),
        ("d", 7, None, None, None, 3, None, None),
        ("e", 0, "text", "alone", None, 1, None, None),
    ]
    counts = spark.createDataFrame([("d", 4), ("f", 2)], "document_id string, n_pages int")
    got = {(r.document_id, r.page_number): r for r in I.page_records(spark.createDataFrame(rows, ITEM), counts).collect()}
    assert set(got) == {("d", 1), ("d", 2), ("d", 3), ("d", 4), ("e", 1), ("f", 1), ("f", 2)}
    first, third = got["d", 1], got["d", 3]
    assert first.structured_text == "## Top\n\n###### Deep\n\nas text\n\n| h |\n| --- |\n| v |" and first.section_headings == ["Top", "Deep"]
    assert [(t.table_id, t.n_rows, t.n_columns) for t in first.tables] == [("table_p1_1", None, None), ("table_p1_2", 2, 1)]
    assert [(b.block_id, b.kind, b.text, b.heading_level) for b in third.blocks] == [("p3_b0", "figure", "said", None), ("p3_b1", "figure", "[Figure on Page 3]", None), ("p3_b2", "list_item", "one", None), ("p3_b3", "paragraph", "", None)]
    assert [(f.figure_id, f.caption) for f in third.figures] == [("fig_p3_1", "said"), ("fig_p3_2", "[Figure on Page 3]")] and third.structured_text == "- one\n\n"
    assert got["d", 2].blocks == [] and got["d", 2].structured_text == "" and got["d", 2].citation_label == "[d Page 2]"
    assert I.page_records(spark.createDataFrame([], ITEM)).collect() == []
