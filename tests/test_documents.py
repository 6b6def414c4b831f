"""Literal fixtures for blocks, sections, imports and text functions."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import numbers as N
from scriptoria.functions import records
from scriptoria.functions import text as T
from scriptoria.operators import model, reduce, sections, segments, verify
from scriptoria.sources import blocks, detect, markup, packages, pdf, subtitles
from scriptoria.streaming import projection


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


MARKDOWN = "Intro line\nTitle\n=====\n\ntext a\ntext b\n- one\n- two\n  more\n\n```py\n# not a heading\n```\n\n## Part ##\n~~~\nopen\n~~~~\nend\nTwo\nlines\n---\n1. x\n"


def test_blocks_tile_and_have_kinds():
    found = segments.structural_blocks(MARKDOWN)
    assert [k for _, _, k in found] == ["paragraph", "heading", "paragraph", "list", "code_fence", "heading", "code_fence", "paragraph", "heading", "list"]
    assert found[0][0] == 0 and found[-1][1] == len(MARKDOWN) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert segments.structural_blocks("```\nnever closed\n# x") == [(0, 20, "code_fence")]
    assert segments.structural_blocks("") == []


def test_headings():
    assert [(lv, t) for lv, t, _, _ in segments.markdown_headings(MARKDOWN)] == [(1, "Intro line Title"), (2, "Part"), (2, "end Two lines")]


@pytest.mark.parametrize("overlap", [0, 30])
def test_segments_tile(overlap):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Éé ", "日本", "x" * 90, ". ", "\n", "\n\n", "# T\n", "- i\n", "😀", "Dr. A "]) for _ in range(rng.randint(1, 80)))
        found = segments.segment(text, 120, overlap)
        assert found[0][1] == 0 and found[-1][2] == len(text)
        for i, (order, s, e, a, b, core, total, lead, trail, _) in enumerate(found):
            assert order == i and a <= s < e <= b and total <= 120 and core + lead + trail == total
            assert core == len(text[s:e].encode()) and (i == 0 or found[i - 1][2] == s)
            assert lead <= overlap and trail <= overlap and (i == 0 or a >= found[i - 1][1])


def test_budget_that_holds_no_character():
    with pytest.raises(ValueError):
        segments.segment("日", 2)


def test_sentence_rule_is_the_same_in_both_engines(spark):
    texts = ["Mr. A went. He (e.g. fig. 3) left! “Yes.” Ok", "", "no end", "a.b c. \n\nd?  e", "U.S. is. no. st. x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [] for r in df.collect()}
    for r in segments.sentence_spans(df).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append(r.start)
        assert texts[r.doc_id][r.start : r.end] == r.text
    assert {i: segments.sentence_starts(t) if t else [] for i, t in enumerate(texts)} == got


def test_random_section_trees_tile():
    rng = random.Random(5)
    for _ in range(60):
        parts = [(f"T{i}", rng.randint(1, 4), "word " * rng.randint(0, 40)) for i in range(rng.randint(0, 9))]
        text, outline = "lead\n" if rng.random() < 0.5 else "", []
        for title, level, body in parts:
            outline.append((len(text), title, level))
            text += f"# {title}\n{body}\n"
        for target in (10, 100, 5000):
            found = sections.tree(text, outline, target)
            at = 0
            for s in found:
                assert s.start == at
                at = s.end
                assert s.parent in found or s.parent.level == 0
                assert all(c.level > s.level for c in s.children) or s.folded
            assert at == len(text)


def test_small_sections_fold_into_the_sibling_before():
    text = "# A\n" + "a " * 200 + "\n# B\nb\n# C\n" + "c " * 200
    found = sections.tree(text, [(0, "A", 1), (text.index("# B"), "B", 1), (text.index("# C"), "C", 1)], 100)
    assert [(s.title, s.folded) for s in found] == [("A", ["B"]), ("C", [])]
    assert sections.own_words(text, found[0]) == 201 and sections.has_body(text, found[0])
    assert not sections.has_body("# A\n", sections.tree("# A\n", [(0, "A", 1)], 0)[0])


HTML = """<title>t</title><h2>Head &amp; x</h2><p>one<p>two<br>b<ul><li>a<li>b<ol start=3><li>c</ol></ul><pre> x
  y </pre><table><tr><th>h<th>i<tr><td>1</td><td>2</table><script>no</script>tail"""


def test_html_blocks(spark):
    found = markup.html_blocks(HTML)
    assert [(k, t) for k, t, _, _ in found] == [
        ("heading", "Head & x"), ("paragraph", "one"), ("paragraph", "two\nb"), ("list_item", "- a"), ("list_item", "- b"), ("list_item", "  3. c"),
        ("preformatted", " x\n  y"), ("table_row", "h | i"), ("table_row", "1 | 2"), ("paragraph", "tail"),
    ]
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "doc_id long, html string")
    rows = blocks.rendered(markup.blocks_of(df, "doc_id")).collect()
    assert [r.doc_id for r in rows] == [1] and "- a\n- b" in rows[0].text and "h | i\n1 | 2" in rows[0].text


def test_subtitles(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,000 X1:1\r\nHello <i>you</i>\r\n\r\n2\n00:00:02,000 --> 00:00:03,000\nHello you\n{\\an8}there &amp; here\n"
    vtt = "WEBVTT\n\nSTYLE\n::cue {}\n\nNOTE x\n\nid\n00:01.000 --> 00:02.000\n<v Ann>Hi</v>\n\n00:02.000 --> 00:03.000\n<v Ann>Hi</v>\nnew\n"
    df = spark.createDataFrame([(1, srt), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in subtitles.srt_text(df).collect()] == [(1, "Hello you\nthere & here", 2)]
    assert [tuple(r) for r in subtitles.vtt_text(spark.createDataFrame([(1, vtt)], "doc_id long, text string")).collect()] == [(1, "Ann: Hi\nnew", 2)]


def zipped(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_x_", "."), data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_packages():
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Base"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:styleId="Mine"><w:basedOn w:val="Base"/></w:style></w:styles>'
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Mine"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    docx = zipped(word__document_x_xml=body, word__styles_x_xml=styles)
    assert detect.detected(docx, "a.bin") == ("docx", None)
    assert [b[:2] + b[3:] for b in packages.docx_blocks(docx)] == [("heading", "Head", 2), ("paragraph", "a", None), ("list_item", "  - item", None), ("table_row", "x | y", None)]
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    odt = zipped(mimetype="application/vnd.oasis.opendocument.text", content_x_xml=f'<office:document-content {ns}><office:body><office:text><text:h text:outline-level="3">H</text:h><text:p>a<text:s text:c="2"/>b</text:p><text:list><text:list-item><text:p>i</text:p></text:list-item></text:list></office:text></office:body></office:document-content>')
    assert detect.detected(odt, "a")[0] == "odt"
    assert [b[:2] for b in packages.odt_blocks(odt)] == [("heading", "H"), ("paragraph", "a b"), ("list_item", "- i")]
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b" linear="no"/><itemref idref="a"/></spine></package>'
    epub = zipped(mimetype="application/epub+zip", **{"META-INF__container_x_xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o__p_x_opf": opf, "o__a_x_xhtml": "<p>main</p>", "o__b_x_xhtml": "<p>aside</p>"})
    assert [b[1] for b in packages.epub_blocks(epub)] == ["main", "aside"]
    assert packages.rtf_text(b"{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 X;}}caf\\'e9 \\u8364?\\par{\\*\\x no}b\\{}") == "café €\nb{"


def test_rows_of_nested_tables_come_out_once():
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    body = f"<w:tbl><w:sdt><w:sdtContent><w:tr>{cell(p('out') + inner)}{cell(p('a') + p('b'))}</w:tr></w:sdtContent></w:sdt><w:tr>{cell(p(''))}{cell(p('z'))}</w:tr></w:tbl>" + p("after")
    docx = zipped(word__document_x_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>")
    assert [b[:2] for b in packages.docx_blocks(docx)] == [("table_row", "out in | a b"), ("table_row", " | z"), ("paragraph", "after")]
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    nested = "<table:table><table:table-row><table:table-cell><text:p>in</text:p></table:table-cell></table:table-row></table:table>"
    rows = f"<table:table><table:table-header-rows><table:table-row><table:table-cell><text:p>out</text:p>{nested}</table:table-cell><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row></table:table-header-rows></table:table>"
    odt = zipped(content_x_xml=f"<office:document-content {ns}><office:body><office:text>{rows}</office:text></office:body></office:document-content>")
    assert [b[:2] for b in packages.odt_blocks(odt)] == [("table_row", "out in | b")]


def test_paragraphs_keep_boxes_and_leave_out_what_was_deleted():
    box = "<w:r><w:pict><w:txbxContent><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:pict></w:r>"
    old = "<w:pPrChange><w:pPr><w:outlineLvl w:val='0'/></w:pPr></w:pPrChange>"
    body = f"<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs>{old}</w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:noBreakHyphen/></w:r><w:ins><w:r><w:t>c</w:t></w:r></w:ins><w:del><w:r><w:delText>d</w:delText></w:r></w:del>{box}</w:p><w:p><w:pPr><w:outlineLvl w:val='2'/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val='Ring'/></w:pPr><w:r><w:t>r</w:t></w:r></w:p>"
    styles = f"<w:styles {W}><w:style w:type='paragraph' w:styleId='Ring'><w:basedOn w:val='Other'/></w:style><w:style w:type='paragraph' w:styleId='Other'><w:basedOn w:val='Ring'/></w:style></w:styles>"
    docx = zipped(word__document_x_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", word__styles_x_xml=styles)
    assert [(b[0], b[1], b[3]) for b in packages.docx_blocks(docx)] == [("paragraph", "a b-cboxed", None), ("heading", "H", 3), ("paragraph", "r", None)]


def test_damaged_files_give_reasons_and_stop_nothing(spark):
    good = zipped(word__document_x_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>ok</w:t></w:r></w:p></w:body></w:document>")
    locked = bytearray(good)
    for at in (good.index(b"PK\1\2") + 8, 6):  # the flag of an encrypted member
        locked[at] |= 1
    broken = zipped(word__document_x_xml=f"<w:document {W}><w:body>")
    files = [("a", good), ("b", good[:-30]), ("c", bytes(locked)), ("d", broken), ("e", b""), ("f", None), ("g", zipped(other=b"x"))]
    df = spark.createDataFrame([(p, bytearray(d) if d is not None else None) for p, d in files], "path string, content binary")
    assert [(r.path, r.text) for r in packages.blocks_of(df, "docx").collect()] == [("a", "ok")]
    found = {r.path: r.reason.split(":")[0] for r in packages.failures_of(df, "docx").collect()}
    assert found == {"b": "BadZipFile", "c": "RuntimeError", "d": "ParseError", "e": "BadZipFile", "f": "ValueError", "g": "KeyError"}
    odd = [("x", b"{\\rtf1 caf\\'e9"), ("y", b"\xff\xfe"), ("z", None)]
    df = spark.createDataFrame([(p, bytearray(d) if d is not None else None) for p, d in odd], "path string, content binary")
    assert {r.path for r in packages.failures_of(df, "rtf").collect()} == {"z"}


def test_the_first_declaration_of_an_encoding_counts(spark):
    heads = ['<?xml version="1.0" encoding="KOI8-R"?><meta charset="utf-8">', '<meta http-equiv=x content="text/html; charset=Latin1"><?xml encoding="a"?>', "<meta name=x>", "<META CHARSET = utf-16>", "<metadata charset=x>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    assert [r.x for r in df.orderBy("i").select(markup.declared_charset(F.col("h")).alias("x")).collect()] == ["koi8-r", "cp1252", None, "utf-16", None]


def test_sentences_keep_all_characters(spark):
    texts = ["a\ufdd0b. C\ufdd1d! E", "e.g. i.e. etc. x. Y", "\ufdd1", ". x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got: dict = {}
    for r in segments.sentence_spans(df).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert texts[r.doc_id][r.start : r.end] == r.text
    assert got == {0: ["a\ufdd0b. ", "C\ufdd1d! ", "E"], 1: ["e.g. i.e. etc. x. ", "Y"], 2: ["\ufdd1"], 3: [". ", "x"]}


def test_packs_leave_without_a_shuffle_and_in_proportion(spark):
    import time

    text = " ".join(f"Sentence number {i} of this long document." for i in range(6000))
    seconds = []
    for k in (1, 1, 10):  # the first run starts the JVM's code
        df = spark.createDataFrame([(1, " ".join([text] * k))], "doc_id long, text string").cache()
        df.count()
        began = time.time()
        rows = segments.packed_sentences(df, 1000).collect()
        seconds.append(time.time() - began)
        assert "".join(r.text for r in rows) == df.first().text and all(r.tokens <= 1000 for r in rows)
        assert [r.start for r in rows[1:]] == [r.end for r in rows[:-1]]
    assert seconds[2] < 30 * max(seconds[1], 0.2)
    assert "Exchange" not in segments.packed_sentences(df, 1000)._jdf.queryExecution().toString()


def pdf_file(objects: list[bytes], trailer: bytes = b"<< /Root 1 0 R >>") -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(objects, 1)) + b"trailer " + trailer + b"\n%%EOF"


def pdf_stream(body: bytes, facts: bytes = b"", packed: bool = True) -> bytes:
    import zlib

    body = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" * packed, facts, body)


CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00e9> endbfchar 2 beginbfrange <0041> <005a> <0041> <0061> <0062> [<0066006c> <d83dde00>] endbfrange"


def test_pdf_text_layer_and_bookmarks():
    one = b"BT /F1 12 Tf 14 TL 72 700 Td (Caf\\351 \\(x\\)) Tj T* [(wi) 20 (de) -400 (gap)] TJ (next) ' ET q 1 0 0 1 0 -500 cm /X1 Do Q BT /F1 20 Tf 300 700 Td (Far) Tj ET BI /W 1 ID (junk) Tj EI"
    two = b"BT /F2 10 Tf 1 0 0 1 50 500 Tm <00410042006100620001> Tj ET"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 9 0 R /Names << /Dests << /Names [(there) [4 0 R /Fit]] >> >> >>",
        b"<< /Type /Pages /Kids [3 0 R 12 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 8 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 10 0 R >>", b"<< /Type /Page /Contents [11 0 R] >>",
        b"<< /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /eacute] >> >>",
        b"<< /Subtype /Type0 /DescendantFonts [<< /W [65 [600 600] 97 98 500] >>] /ToUnicode 7 0 R >>", pdf_stream(CMAP), pdf_stream(b"BT /F1 8 Tf 72 600 Td <0102> Tj ET", b"/Subtype /Form"),
        b"<< /First 13 0 R >>", pdf_stream(one), pdf_stream(two, packed=False), b"<< /Kids [4 0 R 2 0 R] >>",
        b"<< /Title (Part \\(1\\)) /Dest [3 0 R /Fit] /Next 14 0 R /First 15 0 R >>", b"<< /Title <feff00c90032> /A << /S /GoTo /D (there) >> /Next 13 0 R >>", b"<< /Title (In it) >>",
    ]
    data = pdf_file(objects)
    found = list(pdf.read(data))
    assert [(n, [x.text() for x in lines], why) for n, lines, why in found] == [(1, ["Café (x)", "wide gap", "next", "fié", "Far"], None), (2, ["ABfl\U0001f600é"], None)]
    assert [(x.size, x.bold, x.y) for x in found[0][1]] == [(12, True, 700), (12, True, 686), (12, True, 672), (8, True, 100), (20, True, 700)]
    assert pdf.bookmarks(pdf.Document(data)) == [("Part (1)", 1, 1), ("In it", 2, None), ("É2", 1, 2)]


def test_pdf_object_streams_and_damage():
    import zlib

    packed = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >>   << /Type /Pages /Kids [3 0 R] >>"
    first = packed.index(b"<<")
    packed = packed.replace(b"2 33", b"2 %d" % (packed.index(b"<< /Type /Pages") - first))
    body = zlib.compress(packed)
    data = b"%PDF-1.5\n3 0 obj << /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >> endobj\n4 0 obj " + pdf_stream(b"BT /F 9 Tf (ok) Tj ET") + b" endobj\n5 0 obj << /Subtype /Type1 >> endobj\n6 0 obj << /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\r\n" % (first, len(body)) + body + b"\nendstream endobj\n7 0 obj << /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream endobj"
    assert [[x.text() for x in lines] for _, lines, _ in pdf.read(data)] == [["ok"]]
    rng, plain = random.Random(1), bytes(random.Random(1).randrange(256) for _ in range(60))
    near = lambda g, *x: min(x, key=lambda v: abs(g - v))
    stored = bytearray()
    for r in range(10):  # each row by a filter of its own, three columns of two bytes
        kind = r % 5
        stored.append(kind)
        for i in range(6):
            at = r * 6 + i
            left, up, corner = plain[at - 2] if i > 1 else 0, plain[at - 6] if r else 0, plain[at - 8] if r and i > 1 else 0
            stored.append((plain[at] - (0, left, up, (left + up) // 2, near(left + up - corner, left, up, corner))[kind]) % 256)
    assert pdf.Document(data)._unpredicted(bytes(stored), {"Predictor": 15, "Columns": 3, "Colors": 2}) == plain
    broken = data.replace(pdf_stream(b"BT /F 9 Tf (ok) Tj ET"), b"<< /Length 4 /Filter /FlateDecode >>\nstream\nnope\nendstream")
    assert [(n, lines, why.split(":")[0]) for n, lines, why in pdf.read(broken)] == [(1, [], "Damaged")]
    for bad, why in ((b"", "not a PDF"), (b"%PDF-1.4 nothing", "no catalog"), (pdf_file([b"<< /Pages 2 0 R >>", b"<< /Kids [2 0 R] >>"]), "no pages"), (pdf_file([b"<< /Pages 2 0 R >>"], b"<< /Root 1 0 R /Encrypt 9 0 R >>"), "encrypted"), (pdf_file([b"<< /Pages 1 0 R >>"]) + b"2 0 obj (((", None)):
        assert why is None or [(n, r) for n, _, r in pdf.read(bad)] == [(None, f"Damaged: {why}")]
    rng = random.Random(3)
    for _ in range(300):
        noise = bytearray(data)
        for _ in range(rng.randint(1, 12)):
            noise[rng.randrange(9, len(noise))] = rng.randrange(256)
        list(pdf.read(bytes(noise)))


def test_detection_and_decoding():
    assert detect.detected(b"GIF89a\0\0\1", "x.png") == (None, "gif image")
    assert detect.detected("1\n00:00:01,000 --> x".encode("utf-16"), "x") == ("srt", None)
    assert detect.detected(b"PK\3\4broken", "x.zip") == (None, "damaged package")
    assert detect.detected(b"", "x.txt") == (None, "not text")
    assert detect.detected(b" \n%PDF-1.7", "x.txt") == ("pdf", None) and detect.detected(b"\0\1junk %PDF-1.7", "x") == ("pdf", None)
    assert detect.detected(b"\xef\xbb\xbf {\\rtf1 a}", "x.txt") == ("rtf", None) and detect.detected(b"II*\0" + bytes(9), "x") == ("tiff", None)
    for text, kind in (("<?xml version='1.0'?> <!-- a --><!-- b -->\n<!DOCTYPE  html>", "html"), ("<BODY class=x>", "html"), ("<html>", "html"), ("<!doctypehtml>", "txt"), ("<headline>", "txt"), ("<!-- never closed <html>", "txt"), ("7 \r\n 1:02:03.4 --> x", "srt"), ("WEBVTT x", "vtt"), ("plain", "txt")):
        assert detect.detected(text.encode(), "x") == (kind, None), text
    assert detect.detected(b"<html>", "x.md") == ("md", None)
    assert detect.decoded(b"\xef\xbb\xbfa")[:2] == ("a", "utf-8")
    assert detect.decoded("caf\xe9 d\xe9j\xe0 vu, na\xefve".encode("cp1252"))[0] == "café déjà vu, naïve"
    assert detect.decoded("жук".encode("koi8-r"), "koi8-r")[0] == "жук"


def test_text_functions(spark):
    df = spark.createDataFrame([("﻿\r\na \t\r\n\r\nb\r",), ("   ",), (None,)], "t string")
    assert [r.x for r in df.select(T.normalized(F.col("t")).alias("x")).collect()] == ["a\n\nb", "", None]
    assert one(spark, T.redacted(F.lit("x Bearer abcdefghijklmnop, password: q1; http://u:p@h"))) == "x [REDACTED], [REDACTED]; http[REDACTED]h"
    assert one(spark, T.bounded_reason(F.lit("é" * 300))) == "é" * 200
    assert one(spark, T.node_place(F.lit("L2N0005"))) == (2, 4) and one(spark, T.node_place(F.lit("L2N0000"))) is None


def test_numbers(spark):
    assert one(spark, N.number_values(F.lit("1,234.5 and twenty-one, six"))) == [1234.5, 21.0, 6.0]
    assert one(spark, N.numbers_close(F.lit("about 105"), F.lit("100"))) and not one(spark, N.numbers_close(F.lit("105"), F.lit("100")))


def test_evidence_budget_passes_over_what_does_not_fit(spark):
    passages = spark.createDataFrame([(1, "S000001", 0, "alpha beta gamma " * 20), (1, "S000002", 1, "alpha beta"), (1, "S000003", 2, "Ward 12 is here"), (1, "S000004", 3, "nothing")], "doc_id long, segment_id string, ord int, text string")
    claim = spark.createDataFrame([(1, "V01C000001", "alpha beta gamma of Ward 12")], "doc_id long, claim_id string, anchor string")
    got = verify.selected(verify.ranked(claim, passages), 120).first()
    assert got.chosen == ["S000003", "S000002"] and got.omitted == ["S000001", "S000004"] and not got.complete
    assert got.token_cost == len('{"segment_id":"S000003","text":"Ward 12 is here"}\n{"segment_id":"S000002","text":"alpha beta"}')


def test_words_of_scripts_without_blanks_carry_no_content(spark):
    assert one(spark, verify.content_words(F.lit("Words 日本語 ไทย カタカナ of running naïve"))) == ["word", "runn", "naïve"]


def test_quotations_are_located_as_the_passage_has_them(spark):
    passage = "He said: \u201cIt\u2019s (a) 10\u201312 $x | y\u201d\n  \u2014 and left."
    cases = {'It\'s (a)  10-12 $x | y"': "It\u2019s (a) 10\u201312 $x | y\u201d", ' "It\u2019s ': "\u201cIt\u2019s", "- and\tleft.": "\u2014 and left.", "He said:": "He said:", "it's": None, "  ": None, "10.12": None, "": None}
    df = spark.createDataFrame([(q, passage) for q in cases], "q string, p string")
    assert {r.q: r.x for r in df.select("q", verify.located(F.col("q"), F.col("p")).alias("x")).collect()} == cases


def test_long_quotations_are_located(spark):
    words = [f"word\u2019s{i}{' ' if i % 3 else chr(10) * 2 + chr(160)}" for i in range(60_000)]
    passage, quote = "".join(words), " ".join(f"word's{i}" for i in range(20_000, 50_000))
    df = spark.createDataFrame([(quote, passage), (quote + "x", passage), (f"\t{quote}\n", passage), (None, passage), (quote, None)], "q string, p string")
    got = [r.x for r in df.select(verify.located(F.col("q"), F.col("p")).alias("x")).collect()]
    piece = "".join(words[20_000:50_000]).rstrip()
    assert got == [piece, None, piece, None, None]


def test_places_of_quotations_against_patterns(spark):
    import random
    import re

    rng, like = random.Random(4), ["'\u2018\u2019", '"\u201c\u201d', "-\u2013\u2014"]
    rows = [("".join(rng.choices("ab ' \u2019\u2014-\n\u00a0\U0001f600.\"\u201d", k=rng.randint(0, 6))), "".join(rng.choices("ab ' \u2019\u2014-\n\u00a0\U0001f600.\"\u201d", k=rng.randint(0, 60)))) for _ in range(1500)]

    def want(q, p):
        if not q.strip():
            return None
        if q in p:
            return q
        found = re.search("".join(r"\s+" if c.isspace() else next((f"[{x}]" for x in like if c in x), re.escape(c)) for c in re.sub(r"\s+", " ", q.strip())), p)
        return found and found.group()

    df = spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate(rows)], "i int, q string, p string")
    got = {r.i: r.x for r in df.select("i", verify.located(F.col("q"), F.col("p")).alias("x")).collect()}
    assert got == {i: want(q, p) for i, (q, p) in enumerate(rows)} and sum(x is not None for x in got.values()) > 200


def test_items_are_asked_for_three_times_at_most():
    asked = []

    def ask(group, note):
        asked.append((list(group), note))
        return {i: i for i in group if len(group) <= i % 3}, {7: "about"}, {i: "too long" for i in group if i == 2}

    got = model.settled(list(range(1, 8)), 4, ask)
    assert [g for g, _ in asked] == [[1, 2, 3, 4], [5, 6, 7], [1, 2], [3, 4], [5, 6], [7], [1], [3], [4], [6]]
    assert got[2] == (2, 2, 2, "accepted") and got[5] == (5, 2, 2, "accepted") and got[7] == (7, 2, 1, "accepted") and got[3][1:] == (3, 1, "omitted") and got[1][1:] == (3, 1, "accepted")
    assert asked[2][1] == "omitted; too long" and model.settled([], 3, ask) == {}


def test_the_stream_puts_late_events_in_their_place(spark, tmp_path):
    rng, states = random.Random(11), ["planned", "active", "retrying", "completed", "reused", "failed"]
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    events = [(1, f"L0N{rng.randint(1, 3):04d}", i, t0 + datetime.timedelta(seconds=i), rng.choice(states), rng.choice([None, f"s{i}"]), None) for i in range(60)]
    late = events[::2]
    for n, part in enumerate((events[1::2], late + events[1:9:2])):  # some are delivered twice
        spark.createDataFrame(part, projection.EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    source = spark.readStream.schema(projection.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    projection.run_stream(projection.streamed(source), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    rows = projection.latest(spark.read.parquet(str(tmp_path / "rows")).withColumnRenamed("batch", "version"), projection.KEYS, "version").drop("version")
    want = projection.projected(spark.createDataFrame(events, projection.EVENT))
    assert sorted(map(str, rows.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_published_keeps_breaks_and_joins_lower_case(spark):
    rows = [(1, 1, "One. ", True), (1, 2, "Two of U.S. ", True), (1, 3, "law.\n\n", False), (1, 4, "Three. ", True), (1, 5, "Four.", True)]
    spans = spark.createDataFrame(rows, "doc_id long, ordinal int, text string, supported boolean")
    assert verify.published(spans).first().text == "One.\n\nThree. Four."


def test_tree_covers_all_and_shrinks(spark):
    leaves = spark.createDataFrame([(d, o, f"S{o}", [(o % 5, f"S{o}", f"q{o}")]) for d, n in ((1, 1), (2, 5), (3, 23)) for o in range(n)], "doc_id long, ord int, segment_id string, units array<struct<rank:int,segment_id:string,quote:string>>")
    rows = reduce.tree(leaves, 4).collect()
    for d, n in ((1, 1), (2, 5), (3, 23)):
        own = [r for r in rows if r.doc_id == d]
        root = max(own, key=lambda r: r.level)
        assert root.covered == [f"S{o}" for o in range(n)] and [r.level for r in own].count(root.level) == 1
        sizes = [sum(r.level == lv for r in own) for lv in range(root.level + 1)]
        assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all(len(r.units) <= 3 for r in own if r.level)


def test_objects_in_noisy_answers():
    assert records.the_object('Use {x}: ```{"a": {"b": "}"}}```') == ('{"a": {"b": "}"}}', None)
    assert records.the_object("{} {}")[1] == "expected one JSON object, found 2"
    quotes = records.quote_candidates(["A first sentence here. Another sentence, much longer than that."], budget=60)
    assert quotes[0] == "A first sentence here." and all(q in "A first sentence here. Another sentence, much longer than that." for q in quotes)
    assert records.compression_chunks("", ["a" * 25 + " b"], 10) == [("\n\n", "a" * 10, True), ("", "a" * 10, True), ("", "aaaaa b", True)]


class Flaky:
    def __init__(self):
        self.n = 0

    def generate(self, instructions, text):
        self.n += 1
        if self.n == 1:
            raise model.ProviderError("timeout")
        return model.Answer("none" if self.n == 2 else '{"ok": true}', 1)


def test_retries_and_asks():
    assert model.called(Flaky(), "", "t", model.is_object, base=0)[:4] == ('{"ok": true}', 2, 3, 1)

    class Refusing:
        def generate(self, instructions, text):
            raise model.ProviderError("authentication")

    assert model.called(Refusing(), "", "t", model.is_object)[4] == "authentication"


def test_stream_rules_equal_batch_rules(spark):
    import datetime
    from types import SimpleNamespace

    rng, states = random.Random(9), ["planned", "active", "retrying", "completed", "reused", "failed"]
    t0 = datetime.datetime(2024, 1, 1)
    events = [(r, f"L0N{n:04d}", i, t0 + datetime.timedelta(seconds=i), rng.choice(states), rng.choice([None, f"s{i}"]), rng.choice([None, "m"])) for i, (r, n) in enumerate((rng.randint(1, 3), rng.randint(1, 4)) for _ in range(300))]
    got = {(r.run_id, r.node_id): tuple(r)[2:] for r in projection.projected(spark.createDataFrame(events, projection.EVENT)).collect()}
    want: dict = {}
    for r, n, i, ts, state, summary, message in events:
        want[r, n] = projection.apply(want.get((r, n)), SimpleNamespace(event_id=i, ts=ts, state=state, summary=summary, message=message))
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert not segments.sentence_spans(docs).count() and not segments.segments(docs, 100).count() and not segments.packed_sentences(docs, 100).count()
    assert not markup.blocks_of(spark.createDataFrame([], "doc_id long, html string"), "doc_id").count()
