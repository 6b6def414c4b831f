from scriptoria.operators import layout, outline


def test_titles_are_placed_in_order():
    text = "Intro\nabout intro here\nﬁrst Part\nx Intro\nMathx2 fine\n"
    hints = [("intro", 1, None), ("First part", 2, None), ("Intro", 2, None), ("Math x 2 fine", 1, None), ("absent", 1, None)]
    found, missed = outline.place(text, hints, [(1, 0, 23, False), (2, 23, 23, True), (3, 23, len(text), False)])
    assert [(t, lv, text[s : s + 3]) for s, _, t, lv, _, _ in found] == [("Intro", 1, "Int"), ("ﬁrst Part", 2, "ﬁrs"), ("Intro", 2, "Int"), ("Mathx2 fine", 1, "Mat")]
    assert missed == 1 and found[0][4:] == (1, 3) and found[1][1] == found[2][0] and outline.place("", [], []) == ([], 0)


def test_headings_of_pages(spark):
    rows = []
    for page in (1, 2, 3, 4):
        rows.append((1, page, 0, f"Running head {page}", 14.0, True, 780.0))
        rows.append((1, page, 1, f"Chapter {'ABCD'[page - 1]} of", 16.0, True, 700.0))
        rows.append((1, page, 2, "the book", 16.0, True, 682.0))
        rows += [(1, page, 3 + i, "body text that goes on and on over the line", 10.0, False, 640.0 - 12 * i) for i in range(6)]
        rows.append((1, page, 9, "A Section", 12.0, True, 540.0))
        rows += [(1, page, 10 + i, "more body text that goes on and on", 10.0, False, 520.0 - 12 * i) for i in range(4)]
        rows += [(1, page, 20 + i, f"Author {'ABCD'[i]}", 11.5, False, 400.0 - 30 * i) for i in range(4)]
    rows = [(*r[:6], r[6] - 20 * r[1] if r[2] else r[6]) for r in rows]  # what isn't a running head stands elsewhere on each page
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, size double, bold boolean, y double")
    got = [(r.page, r.title, r.level) for r in layout.headings(lines).orderBy("page", "line_no").collect()]
    assert got == [x for p in (1, 2, 3, 4) for x in ((p, f"Chapter {'ABCD'[p - 1]} of the book", 1), (p, "A Section", 2))]


class Odd:
    """Counts pairs, and "ab" as nothing: longer texts can count less."""

    identity, exact, monotonic = "odd", True, False

    def count(self, text):
        return (len(text.replace("ab", "")) + 1) // 2


def test_counters():
    import random

    from scriptoria.functions import counters
    from scriptoria.operators import segments

    rng = random.Random(4)
    for counter in (Odd(), counters.Utf8()):
        for _ in range(40):
            text = "".join(rng.choice("ab é\n.") for _ in range(rng.randint(1, 200)))
            end = counters.fitting_prefix(counter, text, 0, len(text), 7)
            assert counter.count(text[:end]) <= 7 and (end == len(text) or not counter.monotonic or counter.count(text[: end + 1]) > 7)
            start = counters.fitting_suffix(counter, text, 0, len(text), 7)
            assert counter.count(text[start:]) <= 7
            found = segments.segment(text, 9, 3, count=counter)
            assert found[0][1] == 0 and found[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False))
            assert all(counter.count(text[s:e]) <= 9 for _, s, e, *_ in found)


def test_settings_and_schemas():
    import pytest

    from scriptoria.functions import config

    assert config.RunConfig(segment_tokens=100, overlap_tokens=10).strategy == "auto"
    for bad in ({"target_words": 0}, {"strategy": "x"}, {"merge_ceiling": 1}, {"segment_tokens": 5, "overlap_tokens": 5}, {"margin_share": 1.0}, {"context_window": 0}):
        with pytest.raises(ValueError):
            config.RunConfig(**bad)
    schema = {"properties": {"level": {"type": "integer"}, "units": {"items": {"properties": {"segment_id": {"type": "string"}}}}}}
    got = config.narrowed(schema, segment_ids=["S000001"], level=2)
    assert got["properties"]["level"]["const"] == 2 and got["properties"]["units"]["items"]["properties"]["segment_id"]["enum"] == ["S000001"] and "const" not in schema["properties"]["level"]


def test_page_readers(spark):
    from scriptoria.sources import pages

    class Halves:
        def pages(self, data):
            text = data.decode()
            return iter([text[: len(text) // 2], text[len(text) // 2 :]])

    files = spark.createDataFrame([("a", bytearray(b"ab")), ("b", None)], "path string, content binary")
    layer = pages.pages_of(files, Halves)
    assert sorted(map(tuple, layer.collect())) == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, ""), ("b", 2, "")]
    ocr = spark.createDataFrame([("a", 2, "longer text"), ("b", 1, "found")], "path string, page int, text string")
    assert sorted(map(tuple, pages.merged(layer, ocr).collect())) == [("a", 1, "a", False), ("a", 2, "longer text", True), ("b", 1, "found", True), ("b", 2, "", False)]


def test_verified_claims_get_a_second_look(spark):
    from scriptoria.operators import verify

    passages = spark.createDataFrame([(1, "S000001", 0, "The town had 104 people."), (1, "S000002", 1, "Ada Lovelace wrote the notes.")], "doc_id long, segment_id string, ord int, text string")
    claims = spark.createDataFrame([(1, "c1", "About 100 people, the town had"), (1, "c2", "The town had 104 people"), (1, "c3", "Lovelace wrote poems"), (1, "c4", "...")], "doc_id long, claim_id string, anchor string")
    got = {r.claim_id: (r.verdict, r.tolerance) for r in verify.verified(claims, passages, 60).collect()}
    assert got == {"c1": ("supported", "rounded_number"), "c2": ("supported", None), "c3": ("insufficiently_supported", None), "c4": ("not_meaningfully_verifiable", None)}
