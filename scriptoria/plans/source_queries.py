"""Queries of imports: pages, subtitles, page assembly and files."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.plans.registry import query, table
from scriptoria.plans.text_queries import sql_normalized, sql_words
from scriptoria.sources import blocks, detect, markup, packages, pdf, subtitles


@query("src_html_blocks")
def src_html_blocks(spark, sf):
    """SRC11: blocks of every page."""
    return markup.blocks_of(table(spark, sf, "pages"), "page_id")


@query("src_html_text")
def src_html_text(spark, sf):
    """SRC12, ING5, ING6: text and headings of every page."""
    found = markup.blocks_of(table(spark, sf, "pages"), "page_id")
    hints = blocks.outline_hints(found, "page_id").groupBy("page_id").agg(F.count("*").alias("headings"), F.min_by("title", "block_no").alias("first_heading"))
    return blocks.rendered(found, "page_id").join(hints, "page_id", "left").select("page_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"), "blocks", F.coalesce("headings", F.lit(0)).alias("headings"), "first_heading")


@query("src_charset", r"""
WITH p AS (SELECT page_id, left(CASE page_id % 3 WHEN 0 THEN '<meta charset="Latin1">' WHEN 1 THEN '<?xml version="1.0" encoding="KOI8-R"?>' ELSE '' END || html, 4096) AS h FROM pages),
f AS (SELECT page_id, h, strpos(lower(h), '<meta charset') AS m, strpos(lower(h), '<?xml ') AS x FROM p),
l AS (SELECT page_id, lower(nullif(CASE WHEN x > 0 AND (m = 0 OR x < m) THEN regexp_extract(h, '(?i)<\?xml[^>]+encoding\s*=\s*["'']([A-Za-z0-9._:-]+)', 1) ELSE regexp_extract(h, '(?i)<meta[^>]+charset\s*=\s*["'']?\s*([A-Za-z0-9._:-]+)', 1) END, '')) AS c FROM f)
SELECT page_id, CASE WHEN c IN ('ascii', 'us-ascii', 'iso-8859-1', 'iso8859-1', 'latin1', 'latin-1', 'l1', 'windows-1252') THEN 'cp1252' ELSE c END AS charset FROM l""")
def src_charset(spark, sf):
    """SRC6: declared encodings; the first declaration counts."""
    head = F.concat(F.when(F.col("page_id") % 3 == 0, '<meta charset="Latin1">').when(F.col("page_id") % 3 == 1, '<?xml version="1.0" encoding="KOI8-R"?>').otherwise(""), F.col("html"))
    return table(spark, sf, "pages").select("page_id", markup.declared_charset(head).alias("charset"))


_cue = "replace(replace(text, chr(10), ' '), '  ', ' ')"


def _srt(spark, sf, form: str):
    """Conversations as subtitle files: a cue per turn; each cue repeats the one before it."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")).alias("line"))
    turns = turns.withColumn("before", F.lag("line").over(Window.partitionBy("conv_id").orderBy("turn")))
    before = F.col("before")
    n = F.format_string("%02d", F.col("turn") % 60)
    if form == "srt":
        cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n00:00:"), n, F.lit(",000 --> 00:01:"), n, F.lit(",500\r\n"), F.coalesce(F.concat(before, F.lit("\r\n")), F.lit("")), F.lit("{\\an8}<i>"), F.col("line"), F.lit("</i>\r\n\r\n"))
        head = ""
    else:
        cue = F.concat(F.lit("id"), F.col("turn").cast("string"), F.lit("\n00:"), n, F.lit(".000 --> 01:"), n, F.lit(".500\n"), F.coalesce(F.concat(before, F.lit("\n")), F.lit("")), F.lit("<v.loud Ann>"), F.col("line"), F.lit("</v>\n\n"))
        head = "WEBVTT\n\nNOTE nothing\nat all\n\n"
    ordered = F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue"))))
    return turns.groupBy("conv_id").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda c: c["cue"]), "")).alias("text"))


_trimmed = r"trim(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(10), ' '), '  ', ' '), '\{\\[^}]*\}', '', 'g'), '\s+', ' ', 'g'))"


@query("src_srt", rf"""
WITH l AS (SELECT conv_id, turn, {_trimmed} AS t FROM conversations),
k AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT * FROM l WHERE t <> ''))
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS text, count(*) AS cues FROM k WHERE b IS NULL OR b <> t GROUP BY conv_id""")
def src_srt(spark, sf):
    """SRC8, WIN12: SRT files to text; rolling repeats appear once."""
    return subtitles.srt_text(_srt(spark, sf, "srt"), "conv_id")


@query("src_vtt", rf"""
WITH l AS (SELECT conv_id, turn, {_trimmed} AS t FROM conversations),
e AS (SELECT conv_id, turn, k, CASE WHEN k = 1 THEN 'Ann: ' || t ELSE b END AS t
      FROM (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM l), (VALUES (0), (1)) AS x(k) WHERE CASE WHEN k = 1 THEN t <> '' ELSE coalesce(b, '') <> '' END),
k AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn, k) AS b FROM e),
c AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY k) AS t FROM k WHERE b IS NULL OR b <> t GROUP BY conv_id, turn)
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS text, count(*) AS cues FROM c GROUP BY conv_id""")
def src_vtt(spark, sf):
    """SRC9: WebVTT files to text, with voices."""
    return subtitles.vtt_text(_srt(spark, sf, "vtt"), "conv_id")


@query("src_srt_legacy", r"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(string_split('12' || chr(10) || '00:01 --> 00:02' || chr(10) || coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[0-9]+') AND NOT contains(x, '-->') AND trim(x) <> ''), lambda x: trim(x)), ' ') AS text FROM conversations""")
def src_srt_legacy(spark, sf):
    """SRC21: the plain filter of lines."""
    return table(spark, sf, "conversations").select("conv_id", "turn", subtitles.legacy_srt_text(F.concat(F.lit("12\n00:01 --> 00:02\n"), F.coalesce("text", F.lit("")))).alias("text"))


def _pages(spark, sf):
    """Turns of conversations as pages; every fifth is blank."""
    t = table(spark, sf, "conversations")
    return t.select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), (F.col("turn") % 2 == 0).alias("ocr"))


_pages_sql = "p AS (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN turn % 5 = 4 THEN '' ELSE coalesce(text, '') END AS text, turn % 2 = 0 AS ocr FROM conversations)"


@query("ing_pages", rf"""
WITH RECURSIVE {_pages_sql},
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS n, regexp_matches(text, '[\p{{L}}\p{{N}}]') AS filled FROM p),
a AS (SELECT conv_id, n, page, ocr, filled, CASE WHEN filled THEN text ELSE '' END AS doc FROM o WHERE n = 1
      UNION ALL
      SELECT o.conv_id, o.n, o.page, o.ocr, o.filled,
             CASE WHEN a.doc = '' THEN '' ELSE a.doc || chr(10) || chr(10) END || '--- Page ' || o.page || ' ---' || CASE WHEN o.filled THEN chr(10) || chr(10) || o.text ELSE '' END
      FROM a JOIN o ON o.conv_id = a.conv_id AND o.n = a.n + 1)
SELECT conv_id, page, CAST(length(doc) - CASE WHEN filled THEN length((SELECT text FROM o WHERE o.conv_id = a.conv_id AND o.n = a.n)) ELSE 0 END AS INTEGER) AS start, CAST(length(doc) AS INTEGER) AS "end", ocr, NOT filled AS blank FROM a""")
def ing_pages(spark, sf):
    """ING7, WIN4, D7: page markers, spans and blank flags."""
    return blocks.assembled(_pages(spark, sf), "conv_id")[1]


@query("ing_page_text", rf"""
WITH {_pages_sql},
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS n, regexp_matches(text, '[\p{{L}}\p{{N}}]') AS filled FROM p),
s AS (SELECT conv_id, page, k, CASE k WHEN 0 THEN '--- Page ' || page || ' ---' ELSE text END AS t FROM o, (VALUES (0), (1)) x(k) WHERE (k = 0 AND n > 1) OR (k = 1 AND filled))
SELECT conv_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page, k)) AS digest, CAST(sum(CASE WHEN k = 1 THEN len({sql_words("t")}) ELSE 0 END) AS BIGINT) AS words FROM s GROUP BY conv_id
HAVING sum(CASE WHEN k = 1 THEN len({sql_words("t")}) ELSE 0 END) > 0""")
def ing_page_text(spark, sf):
    """ING7, AGG20: pages joined into one text."""
    return blocks.assembled(_pages(spark, sf), "conv_id")[0].select("conv_id", F.sha2("text", 256).alias("digest"), "words")


@query("ing_page_ranges", r"""
WITH p AS (SELECT doc_id, unnest(list_filter(range(1, 60), lambda i: (i * (doc_id + 3)) % 7 < 3 AND i % (doc_id % 9 + 2) <> 0)) AS page FROM documents),
i AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p) GROUP BY doc_id, g),
r AS (SELECT doc_id, a, CASE WHEN a = b THEN '' || a ELSE a || '–' || b END AS t, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM i)
SELECT doc_id, string_agg(t, ', ' ORDER BY a) FILTER (n <= 12) || CASE WHEN max(c) > 12 THEN ', and ' || (max(c) - 12) || ' more' ELSE '' END AS ranges FROM r GROUP BY doc_id""")
def ing_page_ranges(spark, sf):
    """ING16, WIN10: gaps and islands."""
    d = F.col("doc_id")
    every = F.filter(F.sequence(F.lit(1), F.lit(59)), lambda i: ((i * (d + 3)) % 7 < 3) & (i % (d % 9 + 2) != 0))
    return blocks.page_ranges(table(spark, sf, "documents").select("doc_id", F.explode(every).alias("page")))


@query("ing_report", rf"""
WITH {_pages_sql}, o AS (SELECT *, regexp_matches(text, '[\p{{L}}\p{{N}}]') AS filled FROM p)
SELECT conv_id, count(*) AS pages, count(*) FILTER (ocr) AS ocr_pages, count(*) FILTER (NOT filled) AS blank_pages,
       coalesce(string_agg(CASE WHEN a = b THEN '' || a ELSE a || '–' || b END, ', ' ORDER BY a), '') AS blank_ranges
FROM o LEFT JOIN (SELECT conv_id AS c, min(page) AS a, max(page) AS b FROM (SELECT conv_id, page, page - row_number() OVER (PARTITION BY conv_id ORDER BY page) AS g FROM o WHERE NOT filled) GROUP BY conv_id, g) i ON c = conv_id AND o.page = i.a
GROUP BY conv_id""")
def ing_report(spark, sf):
    """ING17: the report of an import."""
    return blocks.import_report(blocks.assembled(_pages(spark, sf), "conv_id")[1], "conv_id")


@query("src_ocr", r"""
WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '...' WHEN 1 THEN source ELSE text END AS layer, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text || ' ' || text ELSE text END AS ocr FROM documents),
v AS (SELECT *, length(replace(replace(layer, ' ', ''), chr(10), '')) AS a, length(replace(replace(ocr, ' ', ''), chr(10), '')) AS b, regexp_matches(layer, '[\p{L}\p{N}]') AS la, regexp_matches(ocr, '[\p{L}\p{N}]') AS lb FROM p)
SELECT doc_id, a < 1000 OR NOT la AS sparse, lb AND (NOT la OR b > 1.5 * a) AS recognized FROM v""")
def src_ocr(spark, sf):
    """SRC17, SRC18: thin text layers, and where recognized text replaces them."""
    d = F.col("doc_id")
    pages = table(spark, sf, "documents").select("doc_id", F.when(d % 4 == 0, "...").when(d % 4 == 1, F.col("source")).otherwise(F.col("text")).alias("layer"), F.when(d % 5 == 0, "").when(d % 5 == 1, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")).alias("ocr"))
    return pages.select("doc_id", blocks.sparse_page(F.col("layer")).alias("sparse"), blocks.preferred(F.col("layer"), F.col("ocr")).alias("recognized"))


@query("src_detect", r"""
SELECT 'page-' || page_id || CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '' WHEN 2 THEN '.pdf' ELSE '.png' END AS path,
       CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN CASE WHEN regexp_matches(html, '(?is)^(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<(?:!doctype\s+html|(?:html|head|body)[\s>])') THEN 'html' ELSE 'txt' END WHEN 2 THEN 'pdf' END AS format,
       CASE WHEN page_id % 4 = 3 THEN 'gif image' END AS reason FROM pages""")
def src_detect(spark, sf):
    """SRC3: formats by content."""
    n = F.col("page_id") % 4
    path = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.when(n == 0, ".html").when(n == 1, "").when(n == 2, ".pdf").otherwise(".png"))
    data = F.when(n == 2, F.concat(F.lit("  %PDF-1.7 "), F.col("html")).cast("binary")).when(n == 3, F.concat(F.lit("GIF89a\x00\x01").cast("binary"), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    return detect.formats(table(spark, sf, "pages").select(path.alias("path"), data.alias("content")))


@query("src_decode", r"""
SELECT 'd' || doc_id AS path, sha256(text) AS digest, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding, CAST(0 AS INTEGER) AS replaced FROM documents""")
def src_decode(spark, sf):
    """SRC1, SRC5: bytes in several encodings to text."""
    n, t = F.col("doc_id") % 3, F.col("text")
    data = F.when(n == 0, F.encode(t, "UTF-8")).when(n == 1, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(t, "UTF-16LE"))).otherwise(F.concat(F.lit(bytearray(b"\xfe\xff")), F.encode(t, "UTF-16BE")))
    found = detect.texts(table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), data.alias("content")))
    return found.select("path", F.sha2("text", 256).alias("digest"), "encoding", "replaced")


@query("src_rtf", rf"""
SELECT 'd' || doc_id AS path, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string({sql_words("x")}, ' ')), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def src_rtf(spark, sf):
    """SRC10: rich text with escaped characters."""
    chars = F.split("text", "")
    body = F.array_join(F.transform(chars, lambda c: F.when(c == "\n", "\\par\n").when(F.ascii(c) > 127, F.concat(F.lit("\\u"), F.ascii(c).cast("string"), F.lit("?"))).when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).otherwise(c)), "")
    data = F.concat(F.lit("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}\\f0 "), body, F.lit("}")).cast("binary")
    files = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), data.alias("content"))
    lines = packages.blocks_of(files, "rtf").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return lines.select("path", F.array_join(F.transform("b", lambda b: b["text"]), "\n").alias("text"))


@query("ing_outline", r"""
WITH d AS (SELECT doc_id, length('Title ' || doc_id) AS t, length(text) AS n FROM documents)
SELECT doc_id, CAST(0 AS INTEGER) AS start, CAST(t + 10 + n AS INTEGER) AS "end", 'Title ' || doc_id AS title, CAST(1 AS INTEGER) AS level FROM d
UNION ALL SELECT doc_id, CAST(t + 1 AS INTEGER), CAST(t + 10 + n AS INTEGER), 'PART Two', CAST(2 AS INTEGER) FROM d""")
def ing_outline(spark, sf):
    """ING8, ING13: titles are placed in order, in spite of case, blanks and compatibility forms."""
    from scriptoria.operators import outline

    docs = table(spark, sf, "documents")
    title = F.concat(F.lit("Title "), F.col("doc_id").cast("string"))
    text = F.concat(title, F.lit("\nPART Two\n"), F.col("text"))
    hint = lambda t, level: F.struct(t.alias("title"), F.lit(level).alias("level"), F.lit(None).cast("int").alias("page"))
    hints = F.array(hint(title, 1), hint(F.lit("Ｐart two"), 2), hint(F.lit("never here"), 2))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit(False).alias("blank")))
    found = outline.anchored(docs.select("doc_id", text.alias("text"), hints.alias("hints"), pages.alias("pages")))
    return found.select("doc_id", "start", "end", "title", "level")


@query("ing_layout")
def ing_layout(spark, sf):
    """ING9, ING11, ING12, AGG14, WIN7: headings of laid-out lines; every sixth line, whole, is set large, and each page has a running head."""
    from scriptoria.operators import layout

    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).where("trim(text) <> ''")
    big = F.col("i") % 6 == 0
    page = F.floor(F.col("i") / 12).cast("int") + 1
    placed = lines.select("doc_id", page.alias("page"), (F.col("i") % 12 + 1).alias("line_no"), "text", F.when(big, 16.0).otherwise(10.0).alias("size"), big.alias("bold"), (700.0 - (F.col("i") % 12) * 14 - F.floor(F.col("i") % 12 / 6) * 30).alias("y"))
    heads = placed.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0).alias("line_no"), F.concat(F.lit("Running Head "), F.col("page").cast("string")).alias("text"), F.lit(16.0).alias("size"), F.lit(True).alias("bold"), F.lit(760.0).alias("y"))
    return layout.headings(placed.unionByName(heads))


@query("src_plain", rf"""
WITH d AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || chr(10) || {sql_normalized("text")} AS t FROM documents)
SELECT doc_id, CAST(0 AS INTEGER) AS start, 'Title ' || doc_id AS title, CAST(1 AS INTEGER) AS level FROM d""")
def src_plain(spark, sf):
    """SRC7: Markdown with its headings as an outline."""
    from scriptoria.sources import pages

    t = F.concat(F.lit("\n# Title "), F.col("doc_id").cast("string"), F.lit(" ##\n\n"), F.col("text"), F.lit("\n"))
    return pages.plain_documents(table(spark, sf, "documents").select("doc_id", t.alias("text")), "doc_id")[1]


def _packed(spark, sf, kind: str):
    """Documents as files of a format: a heading and a paragraph a line."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    from scriptoria.sources.arrow import flat_mapped

    def rows(doc, text):
        lines = ["".join(c for c in x if c >= " ") for x in (text or "").split("\n")]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            if kind == "docx":
                w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
                body = "".join(f"<w:p>{'<w:pPr><w:pStyle w:val=$Heading1$/></w:pPr>'.replace('$', chr(34)) * (i == 0)}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for i, x in enumerate(lines))
                z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
            elif kind == "odt":
                ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
                z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
                z.writestr("content.xml", f"<office:document-content {ns}><office:body><office:text>" + "".join(f"<text:{'ph'[i == 0]}>{escape(x)}</text:{'ph'[i == 0]}>" for i, x in enumerate(lines)) + "</office:text></office:body></office:document-content>")
            else:
                z.writestr("mimetype", "application/epub+zip")
                z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
                z.writestr("b.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
                z.writestr("a.xhtml", "<html><body>" + "".join(f"<{('p', 'h1')[i == 0]}>{escape(x)}</{('p', 'h1')[i == 0]}>" for i, x in enumerate(lines)) + "</body></html>")
        yield (f"d{doc}", out.getvalue())

    files = flat_mapped(table(spark, sf, "documents").select("doc_id", "text"), "path string, content binary", rows)
    found = packages.blocks_of(files, kind).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block_no", "text", "kind"))).alias("b"))
    return found.select("path", F.array_join(F.transform("b", lambda b: b["text"]), "\n").alias("text"), F.size(F.filter("b", lambda b: b["kind"] == "heading")).alias("headings"))


_PACKED_SQL = rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: array_to_string({sql_words("x")}, ' ')) AS x FROM documents)
SELECT 'd' || doc_id AS path, array_to_string(list_filter(x, lambda y: y <> ''), chr(10)) AS text, CAST(x[1] <> '' AS INTEGER) AS headings FROM l WHERE len(list_filter(x, lambda y: y <> '')) > 0"""


@query("src_docx", _PACKED_SQL)
def src_docx(spark, sf):
    """SRC13: word-processor files."""
    return _packed(spark, sf, "docx")


@query("src_odt", _PACKED_SQL)
def src_odt(spark, sf):
    """SRC14: open documents."""
    return _packed(spark, sf, "odt")


@query("src_epub", _PACKED_SQL)
def src_epub(spark, sf):
    """SRC15: books."""
    return _packed(spark, sf, "epub")


@query("src_damaged", r"""
SELECT 'd' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'BadZipFile' WHEN 1 THEN 'KeyError' ELSE 'ParseError' END AS reason FROM documents WHERE doc_id % 4 < 3""")
def src_damaged(spark, sf):
    """SRC13: files that are cut off, lack their text or hold broken XML give their reasons; the others are read."""
    import io
    import zipfile

    from scriptoria.sources.arrow import flat_mapped

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def rows(doc, text):
        out, n = io.BytesIO(), doc % 4
        with zipfile.ZipFile(out, "w") as z:
            words = (text or "").replace("&", " ").replace("<", " ")
            z.writestr("word/other.xml" if n == 1 else "word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>{''.join(c for c in words if c >= ' ')}</w:t></w:r></w:p>" + "</w:body></w:document>" * (n != 2))
        yield (f"d{doc}", out.getvalue()[:-30] if n == 0 else out.getvalue())

    files = flat_mapped(table(spark, sf, "documents").select("doc_id", "text"), "path string, content binary", rows)
    return packages.failures_of(files, "docx").select("path", F.substring_index("reason", ":", 1).alias("reason"))


def _pdf_of(doc, text) -> bytes:
    """A document as PDF: 30 lines a page in a font whose codes are shifted, which only its character map tells; a bookmark a page."""
    import zlib

    lines = [" ".join(x.split()) for x in (text or "").split("\n")]
    pages = [lines[i : i + 30] for i in range(0, len(lines), 30)]
    units = sorted({u for x in lines for u in struct.unpack(f">{len(x.encode('utf-16-be')) // 2}H", x.encode("utf-16-be")) if not 0xD800 <= u < 0xE000})
    pairs = sorted({c for x in lines for c in x if c > "\uffff"})
    codes = {chr(u): (n + 7).to_bytes(2).hex() for n, u in enumerate(units)} | {c: (n + 7 + len(units)).to_bytes(2).hex() for n, c in enumerate(pairs)}
    cmap = "1 begincodespacerange <0000> <ffff> endcodespacerange " + " ".join(f"1 beginbfchar <{k}> <{c.encode('utf-16-be').hex()}> endbfchar" for c, k in codes.items())
    out = [b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >>", b"", b"<< /Subtype /Type0 /DescendantFonts [<< /DW 600 >>] /ToUnicode 4 0 R >>", b"", b""]

    def stream(body: str) -> bytes:
        data = zlib.compress(body.encode())
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)

    out[3] = stream(cmap)
    for i, page in enumerate(pages):
        shown = " T* ".join(f"<{''.join(codes[c] for c in x)}> Tj" for x in page)
        out += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(out) + 2), stream(f"BT /F 10 Tf 14 TL 40 800 Td {shown} ET")]
        out.append(b"<< /Title (Page %d) /Dest [%d 0 R /Fit]%s >>" % (i + 1, len(out) - 1, b" /Next %d 0 R" % (len(out) + 4) if i + 1 < len(pages) else b""))
    out[1] = b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F 3 0 R >> >> >>" % b" ".join(b"%d 0 R" % (6 + 3 * i) for i in range(len(pages)))
    out[4] = b"<< /First 8 0 R >>"
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(out, 1)) + b"trailer << /Root 1 0 R >>"


def _pdfs(spark, sf):
    from scriptoria.sources.arrow import flat_mapped

    def rows(doc, text):
        yield (f"d{doc}", _pdf_of(doc, text))

    return flat_mapped(table(spark, sf, "documents").select("doc_id", "text"), "path string, content binary", rows)


@query("src_pdf", rf"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, i, array_to_string({sql_words("line")}, ' ') AS line FROM l)
SELECT 'd' || doc_id AS path, CAST(i // 30 + 1 AS INTEGER) AS page, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '')) AS digest FROM w GROUP BY doc_id, i // 30""")
def src_pdf(spark, sf):
    """SRC16: the text layer of PDF files, page by page."""
    return pdf.pages_of(_pdfs(spark, sf)).where("reason is null").select("path", "page", F.sha2("text", 256).alias("digest"))


@query("src_pdf_outline", """
SELECT 'd' || doc_id AS path, CAST(p - 1 AS INTEGER) AS ord, 'Page ' || p AS title, CAST(1 AS INTEGER) AS level, CAST(p AS INTEGER) AS page FROM (SELECT doc_id, unnest(range(1, CAST(ceil(len(string_split(text, chr(10))) / 30.0) AS BIGINT) + 1)) AS p FROM documents)""")
def src_pdf_outline(spark, sf):
    """SRC16, ING8: the bookmarks of PDF files and their pages."""
    return pdf.bookmarks_of(_pdfs(spark, sf))
