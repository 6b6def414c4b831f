"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from scriptoria.llm import bin_slack, components, decontaminate, id_matrix, language, licenses, line_chunks, mjpeg, near_dup, pseudonyms, queries, tokens, url_rules
from scriptoria.llm.words import Words, grams

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A table that has columns with names that the operators use themselves.
ODD = DOCS + ", node string, bands string, text_hash string, piece string, length string, component string, gone string, salt string, best string, found string, kinds string, n_pii string, score string, key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    lines = [f"line {i} of a long text with some words in it" for i in range(3000)]
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "", None, None, None), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (5, "other text here now yes", "de", "b", 1),
            (None, "no id at all, but words are here", "en", "a", 1), (6, "\n".join(lines), "en", "a", 1), (7, "\n".join(lines[:1000]), "fr", "a", 1), (8, "!!! ???", "en", "a", 1), (9, "日本語 текст\u0000 \ud7ff", "de", "b", 2), (10, " \n\n \n", "fr", "c", 5)]
    return spark.createDataFrame([(*r, *["x"] * 14) for r in rows], ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in queries.oracles():
        same_rows(got, duck.sql(queries.oracles()[name]).df())


# 1: pseudonyms

PII = "mail bob.smith7@x-1.example.com, card 4111 1111 1111 1111 or 4111-1111-1111-1111, bad 4111111111111112, +1 (212) 555-0199 and 212-555-0199, ip 10.0.0.255 not 10.0.0.256, ssn 123-45-6789 not 000-12-3456, on 2024-02-29, 29.02.2024, 2023-02-29, DE89370400440532013000 GB82 WEST 1234 5698 7654 32."


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def feistel(key, kind, value, a, b):
    """The permutation as the docstring says it, for comparison."""
    x, y = value % a, value // a
    for i in range(pseudonyms.ROUNDS):
        digest = lambda half: int(hashlib.sha256("|".join(map(str, (key, kind, a, b, i, half))).encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            x = (x + digest(y) % a) % a
        else:
            y = (y + digest(x) % b) % b
    return x + y * a


def test_pseudonyms_keep_format_and_link(spark):
    df = spark.createDataFrame([(1, PII), (2, "again 4111111111111111 here"), (3, "clean text 12 of 34"), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymized(df, "k").collect()}
    one = rows[1]
    assert (one.n_email, one.n_card, one.n_phone, one.n_ip, one.n_ssn, one.n_date, one.n_iban) == (1, 2, 2, 1, 1, 2, 2)
    assert [c if not c.isalnum() else "x" for c in one.text] == [c if not c.isalnum() else "x" for c in PII] or len(one.text) != len(PII)
    for kept in ("4111111111111112", "10.0.0.256", "000-12-3456", "2023-02-29", "@x-1.example.com"):
        assert kept in one.text
    for gone in ("bob.smith7", "4111 1111 1111 1111", "555-0199", "10.0.0.255", "123-45-6789", "2024-02-29", "370400440532013000"):
        assert gone not in one.text
    import re

    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", one.text)
    assert all(map(luhn, cards)) and len({re.sub(r"\D", "", c) for c in cards}) == 1 and re.sub(r"\D", "", cards[0]) in rows[2].text
    payload = feistel("k", "card15", 411111111111111, 10**7, 10**8)
    assert f"{payload:015d}" == re.sub(r"\D", "", cards[0])[:15]
    assert rows[3].text == "clean text 12 of 34" and rows[3].n_pii == 0 and rows[4].text is None and rows[4].n_pii == 0
    back = pseudonyms.pseudonymized(spark.createDataFrame([(1, one.text)], "doc_id long, text string"), "k", inverse=True).first()
    assert back.text == PII
    assert pseudonyms.pseudonymized(df, "other").first().text != one.text


def test_values_within_numbers_that_are_not_valid_are_found(spark):
    card, iban = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    rows = [("id 7 123-45-6789 2021", "n_ssn", "123-45-6789"), ("call 2 212-555-0199 1234", "n_phone", "555-0199"), (f"order 7 {card} 2025", "n_card", card), (f"1234 {card} 1234", "n_card", card), (f"NR12 {card}", "n_card", card),
            (f"AB12 CDEF 3456 {iban}", "n_iban", "WEST 1234 5698"), ("1 2 3 2024-02-29 4 5 6 7 8 9 1 2", "n_date", "2024-02-29"), ("9-9-9 10.0.0.255 9 9 9 9 9 9 9 9 9 9 9", "n_ip", "10.0.0.255"), (f"{card} {card[::-1]} {card}", "n_card", card)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymized(df, "k").collect()}
    for i, (text, kind, gone) in enumerate(rows):
        assert got[i][kind] >= 1 and gone not in got[i].text and got[i].n_pii >= 1, (text, got[i])
        assert kind == "n_ip" or [c if not c.isalnum() else "x" for c in got[i].text] == [c if not c.isalnum() else "x" for c in text]
    assert got[0].text[:5] == "id 7 " and got[0].text[-5:] == " 2021" and got[0].n_pii == 1


def test_numbers_side_by_side_are_all_replaced(spark):
    card = "4111 1111 1111 1111"
    rows = [(1, f"{card} " * 40), (2, "0 " * 200), (3, "0000-" * 80), (4, "GB82 WEST 1234 5698 7654 32 " * 12), (5, ("0" * 16 + " ") * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new = pseudonyms.pseudonymized(df, "k")
    got = {r.doc_id: r for r in new.collect()}
    assert (got[1].n_card, got[2].n_card, got[3].n_card, got[4].n_iban, got[5].n_card) == (40, 10, 20, 12, 9)
    assert card not in got[1].text and "0000" not in got[3].text and "WEST 1234" not in got[4].text and "0" * 16 not in got[5].text and got[2].text[-20:] == "0 " * 10
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymized(new.select("doc_id", "text"), "k", inverse=True).collect()} == dict(rows)


def test_overlapping_numbers_against_all_runs(spark):
    import re

    rng = random.Random(5)
    some = ["0", "00", "0000", "18", "4111", "1111", "4111111111111111", "1", "x", "AB12", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]
    texts = ["".join(rng.choice(some[: rng.choice((4, 6, 8, 13))]) + rng.choice("     --,") for _ in range(rng.randint(5, 90))) for _ in range(150)]

    def kind(m):
        plain = re.sub("[ -]", "", m)
        if re.fullmatch("[0-9]+(?:[ -][0-9]+)*", m):
            return "card" if 13 <= len(plain) <= 19 and luhn(plain) else ""
        if not re.fullmatch("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", m):
            return ""
        return "iban" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else ""

    def want(text):
        t = re.findall("[0-9A-Za-z]+|[^0-9A-Za-z]+", text)
        runs = sorted((-len(m), a, b, kind(m)) for a in range(len(t)) for b in range(a + 1, min(a + 38, len(t) + 1)) if kind(m := "".join(t[a:b])))
        held = [""] * len(t)  # the longest first, then the leftmost, if it is free
        for _, a, b, k in runs:
            if not any(held[a:b]):
                held[a:b] = [f"{k} {a}"] * (b - a)
        return [("".join(t[i] for i in own), h.split(" ")[0]) for h, own in ((h, list(own)) for h, own in itertools.groupby(range(len(t)), held.__getitem__))]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(x) for x in r.x] for r in df.select("i", pseudonyms._cut(F.col("text")).alias("x")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)} and max(sum(k != "" for _, k in x) for x in got.values()) > 6


def test_each_way_of_writing_a_date_is_permuted_one_to_one(spark):
    import datetime

    days = [datetime.date(1999, 12, 1) + datetime.timedelta(i) for i in range(900)] + [datetime.date(1899, 12, 31) - datetime.timedelta(i) for i in range(70)]
    forms = {"iso": "%Y-%m-%d", "dots": "%d.%m.%Y", "days": "%d/%m/%Y", "months": "%m/%d/%Y"}
    rows = sorted({(name, d.strftime(f)) for d in days for name, f in forms.items() if name != "months" or d.day > 12})
    df = spark.createDataFrame([(i, f"on {t}.") for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    new = pseudonyms.pseudonymized(df, "k")
    got = {r.doc_id: r for r in new.collect()}
    assert all(got[i].n_date == 1 and len(got[i].text) == len(t) + 4 for i, (_, t) in enumerate(rows))
    for name in forms:
        assert len({got[i].text for i, (n, _) in enumerate(rows) if n == name}) == sum(n == name for n, _ in rows)
    slashed = [i for i, (n, _) in enumerate(rows) if n in ("days", "months")]
    assert len({got[i].text for i in slashed}) == len(slashed)
    assert sum(got[i].text == f"on {t}." for i, (_, t) in enumerate(rows)) < 20
    back = pseudonyms.pseudonymized(new.select("doc_id", "text"), "k", inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == {i: f"on {t}." for i, (_, t) in enumerate(rows)}
    linked = {(name, datetime.datetime.strptime(t, forms[name]).date()): datetime.datetime.strptime(got[i].text[3:-1], forms[name]).date() for i, (name, t) in enumerate(rows)}
    assert all(linked[name, d] == linked["iso", d] for name, d in linked)


def brute_pii(kind, value):
    """The permutations of the other formats, each as its docstring says it."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "ip":
        n = 0
        for o in value.split("."):
            n = n * 256 + int(o)
        n = feistel("k", "ip", n, 65536, 65536)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        n = feistel("k", "ssn", area - (2 if area > 666 else 1) + 898 * ((group - 1) * 9999 + serial - 1), 898, 99 * 9999)
        area, rest = n % 898 + 1, n // 898
        return f"{area + (area >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    n = feistel("k", "phone", int(digits[:3]) - 200 + 800 * ((int(digits[3:6]) - 200) * 10000 + int(digits[6:])), 800, 8_000_000)
    rest = n // 800
    return f"{n % 800 + 200}-{rest // 10000 + 200}-{rest % 10000:04d}"


def test_formats_against_plain_permutations(spark):
    rng = random.Random(2)
    rows = [("ip", ".".join(str(rng.randrange(256)) for _ in range(4))) for _ in range(40)] + [("phone", f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randrange(10000):04d}") for _ in range(40)]
    rows += [("ssn", f"{rng.choice([a for a in range(1, 900) if a != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}") for _ in range(40)]
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymized(df, "k").collect()}
    assert got == {i: brute_pii(kind, v) for i, (kind, v) in enumerate(rows)}


def test_permutation_is_one_to_one(spark):
    df = spark.range(75 * 4).select(pseudonyms.permuted(F.lit("t"), F.col("id"), F.lit(75).cast("long"), F.lit(4).cast("long"), "k", False).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(300))


# 2: media


def test_media_round_trip_and_generic_decoder():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 7, 40)] + [b" " * 192, b"\xff\x00" * 96]
    media = mjpeg.stored_avis(payloads)
    avis = [mjpeg.Avi(m) for m in media]
    assert mjpeg.frame_histograms(media, avis)[1] == payloads
    for m, avi, p in zip(media, avis, payloads, strict=True):
        assert (avi.width, avi.height, avi.fps) == (128, 96, 25.0)
        luma = mjpeg.Jpeg(m[avi.places[0] : avi.places[0] + avi.sizes[0]]).luma
        assert (np.kron(np.frombuffer(p[:192], np.uint8).reshape(12, 16), np.ones((8, 8), np.uint8)) == luma).all()
        walked = mjpeg.Avi(m.replace(b"idx1", b"JUNK"))
        assert walked.places.tolist() == avi.places.tolist() and walked.sizes.tolist() == avi.sizes.tolist()
    with pytest.raises(ValueError):
        mjpeg.Avi(b"nothing")
    with pytest.raises(ValueError):
        mjpeg.stored_avis([b"x"])


def baseline(blocks: np.ndarray, size: int = 16) -> bytes:
    """A grey size x size JPEG of quantized coefficients (zigzag order), with restart intervals of two blocks."""
    dc, ac = mjpeg.codes(mjpeg.DC_LUMA), mjpeg.codes(mjpeg.AC_LUMA)
    out, bits, level = b"", "", 0

    def number(v, n):
        return format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def settle():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""
        return data

    for k, block in enumerate(blocks):
        if k and k % 2 == 0:
            out += settle() + bytes([0xFF, 0xD0 + (k // 2 - 1) % 8])
            level = 0
        d = int(block[0]) - level
        level = int(block[0])
        n = abs(d).bit_length()
        bits += format(dc[n][0], f"0{dc[n][1]}b") + number(d, n)
        run = 0
        for v in map(int, block[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                bits += format(ac[0xF0][0], f"0{ac[0xF0][1]}b")
                run -= 16
            n = abs(v).bit_length()
            c = ac[run << 4 | n]
            bits += format(c[0], f"0{c[1]}b") + number(v, n)
            run = 0
        if run:
            bits += format(ac[0][0], f"0{ac[0][1]}b")
    seg = mjpeg._segment
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([2] * 64)) + seg(0xC0, bytes([8, 0, size, 0, size, 1, 1, 0x11, 0])) + seg(0xDD, b"\0\2") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + out + settle() + b"\xff\xd9"


def test_baseline_decoder_against_the_transform():
    rng = np.random.default_rng(2)
    blocks = np.zeros((4, 64), int)
    blocks[:, 0] = rng.integers(-200, 200, 4)
    blocks[:, 1:40] = rng.integers(-9, 10, (4, 39)) * (rng.random((4, 39)) < 0.3)
    luma = mjpeg.Jpeg(baseline(blocks)).luma
    for k in range(4):
        c = np.zeros(64)
        c[mjpeg.ZIGZAG] = blocks[k] * 2
        c = c.reshape(8, 8)
        u = np.arange(8)
        s = np.where(u == 0, 0.5**0.5, 1.0)
        want = np.array([[sum(s[a] * s[b] * c[a, b] * np.cos((2 * i + 1) * a * np.pi / 16) * np.cos((2 * j + 1) * b * np.pi / 16) for a in u for b in u) / 4 for j in u] for i in u])
        got = luma[k // 2 * 8 : k // 2 * 8 + 8, k % 2 * 8 : k % 2 * 8 + 8]
        assert np.abs(np.clip(np.rint(want + 128), 0, 255) - got).max() <= 1


def test_clips(spark):
    dark, light = bytes(range(32, 64)) * 6, bytes(range(200, 232)) * 6
    media = mjpeg.stored_avis([dark * 10 + light * 10 + dark * 5])[0]
    df = spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")
    got = [tuple(r) for r in mjpeg.clips(df).drop("reason").orderBy("clip").collect()]
    assert got == [(1, 0, 0.0, 0.4, 0, 10), (1, 1, 0.4, 0.8, 10, 10), (1, 2, 0.8, 1.0, 20, 5)]


def test_clips_of_files_that_cannot_be_read(spark):
    good = mjpeg.stored_avis([bytes(range(192)) * 3])[0]
    bad = {1: good, 2: b"", 3: b"nothing at all", 4: good[:40], 5: good[: len(good) // 2], 6: b"RIFF\x04\0\0\0AVI ", 7: None}
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in bad.items()], "doc_id long, media binary")
    got = mjpeg.clips(rows).collect()
    assert [r.n_frames for r in got if r.doc_id == 1 and r.reason is None] and not [r for r in got if r.doc_id == 7]
    assert {r.doc_id for r in got if r.reason is not None and r.clip is None} >= {2, 3, 4, 6}
    assert not mjpeg.clips(rows.limit(0)).count() and not mjpeg.media_table(spark.createDataFrame([], "doc_id long, text string")).count()


def test_media_digests(spark, odd):
    rows = mjpeg.media_table(odd).collect()
    assert len(rows) == odd.count()
    for r, text in zip(rows, (x.text for x in odd.select("text").collect()), strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# 3: near duplicates


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randint(0, rng.choice([3, 50, 500])) for _ in range(rng.randint(1, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 2)] = [rng.randint(0, 60)] * rng.randint(0, 2)
        n = lcs(a, b)
        assert near_dup.common_length(a, b, 100) == n and near_dup.common_length(a, b, 2) <= n
        for need in (n - 1, n, n + 1):
            assert near_dup.aligned(np.array(a), np.array(b), need) == bool(b and n >= need)


def brute_classes(rows):
    """Classes by comparing all pairs with plain dynamic programming."""
    words = Words(pa.array([t for _, t in rows], pa.string()))
    h, first = near_dup.shingles(words)
    own = [list(dict.fromkeys(h[first[i] : first[i + 1]].tolist())) for i in range(len(rows))]
    text = [words.hashes[words.first[i] : words.first[i + 1]].tolist() for i in range(len(rows))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = own[i], own[j]
            same = text[i] == text[j] and (text[i] or (rows[i][1] or "") == (rows[j][1] or ""))
            if not same and 9 * len(set(a) & set(b)) >= 4 * (len(a) + len(b)):
                same = 9 * lcs(a, b) >= 4 * (len(a) + len(b))
            if same:
                parent[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return Counter((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g)


def copies(rng, n, word=lambda r: "".join(r.choices("abcdefghij", k=5))):
    """Texts with exact and near copies of several strengths, and a passage that many share."""
    passage = [word(rng) for _ in range(60)]
    rows = []
    for _ in range(n):
        base = [word(rng) for _ in range(rng.choice([20, 120, 200]))]
        if rng.random() < 0.4:
            base[10:10] = passage
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 100, len(base) // 30])):
                copy[rng.randrange(len(copy))] = word(rng)
            rows.append(copy)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def between(got, rows):
    """The classes are those of the five-word shingles at 0.8, no more and no less."""
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def test_near_duplicates_against_all_pairs(spark):
    rows = copies(random.Random(4), 60)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    between(got, rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.copies == sizes[r.class_id] for r in got)


def test_texts_that_share_a_passage_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "ROWS", 1)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    between(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_pairs_led_by_a_third_text_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "ROWS", 1)
    monkeypatch.setattr(near_dup, "BANDS", 3)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(180)]
    rows = [(i, " ".join(template + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in range(400)]
    rows += [(5000 + i, rows[i][1] + f" end {i}") for i in range(0, 400, 5)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 5000 * (i >= 5000) for i, _ in rows}


def test_texts_alike_by_words_only_stay_apart(spark):
    words = [f"w{i}" for i in range(400)]
    edited = [f"e{i}" if i % 20 == 10 else w for i, w in enumerate(words)]  # shingle similarity 0.6
    block = words[:360] + [f"b{i}" for i in range(80)]  # 0.69
    once = [*words[:200], "new", *words[201:]]
    rows = [(i, " ".join(x)) for i, x in enumerate((words, edited, block, once))]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}


def test_repeated_lines_do_not_hide_copies(spark):
    rng, rows = random.Random(10), []
    for i in range(20):
        text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(8)]
        rows += [(10 * i, "\n".join(text)), (10 * i + 1, "\n".join(text * 3)), (10 * i + 2, "\n".join(x for x in text for _ in range(4))), (10 * i + 3, "\n".join(text[:1] * 40 + text))]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == d // 10 * 10 for d, _ in rows)


def test_near_duplicates_of_odd_tables(spark, odd, empty):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    classes = {(r.doc_id, r.class_id, r.copies) for r in got}
    assert {(4, 4, 3), (5, 4, 3), (5, 5, 1), (1, 1, 3), (3, 1, 3), (8, 8, 1)} <= classes
    assert not near_dup.near_duplicates(empty).count()
    kept = near_dup.stage(spark, odd, "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole = Counter((r.doc_id, r.text) for r in odd.collect())
    dropped = Counter({(2, ""): 1, (3, ""): 1, (5, "one"): 2})
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == whole - dropped
    assert not near_dup.stage(spark, empty, "").count()


def test_rows_without_doc_id_keep_their_classes(spark):
    """Two copies, one of them without doc_id; a class of rows without doc_id alone; links led by such a row."""
    rng = random.Random(12)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    a, b, c = text(), text(), text()
    rows = [(None, " ".join(a)), (1, " ".join(a)), (None, "alone it stays"), (None, " ".join(b)), (None, " ".join([*b[:60], "x", *b[61:]])), (7, " ".join(c)), (None, " ".join([*c[:60], "x", *c[61:]])), (9, " ".join([*c[:30], "y", *c[31:]]))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    got = Counter((r.doc_id, r.class_id, r.copies) for r in near_dup.near_duplicates(docs).collect())
    assert got == Counter({(None, 1, 2): 1, (1, 1, 2): 1, (None, None, 1): 1, (None, None, 2): 2, (7, 7, 3): 1, (None, 7, 3): 1, (9, 7, 3): 1})
    kept = near_dup.stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.doc_id or r.text == "alone it stays") == [(0, "alone it stays"), (1, rows[1][1]), (7, rows[5][1])]
    assert len(kept) == 4


def test_many_copies_too_far_apart_are_not_compared(spark, monkeypatch):
    """A bound keeps copies of one text, each with edits of its own, from being compared with each other; none is lost."""
    rng, rows = random.Random(14), []
    base = [f"b{i}" for i in range(150)]
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(3, 147), rng.randint(1, 8)):
            copy[k] = f"e{i}x{k}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[i][1] + f" end{i}") for i in range(0, 150, 3)]
    compared = []
    monkeypatch.setattr(near_dup, "_compared", lambda pairs, texts, real=near_dup._compared: compared.append(pairs.count()) or real(pairs, texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    between(got, rows)
    assert 5 * sum(compared) < len(rows) * (len(rows) - 1) / 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 4: decontamination


def brute_contamination(docs, items):
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows: dict = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("sent", [decontaminate.SENT_WORDS, 0])
def test_contamination_against_all_windows(spark, sent):
    rng = random.Random(8)
    word = lambda: rng.choice("a b c dd Éé x1 yy".split())  # noqa: E731  few words: many accidental grams
    items = [(i, ", ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(99, None), (3, "!!")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.choice([0, 5, 40, 120]))]
        for _ in range(rng.randint(0, 2)):
            piece = (rng.choice(items)[1] or "").split(", ")
            at = rng.randrange(len(own) + 1)
            own[at:at] = piece[: rng.randint(1, len(piece))]
        docs.append((i, " ".join(own) if rng.random() < 0.9 else None))
    docs += [docs[3], docs[3]]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), sent)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    assert got == brute_contamination(docs, items)


def test_contamination_of_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("contaminated").count() == 0
    assert decontaminate.contamination(odd, items).where("contaminated").count() == 3
    assert not decontaminate.contamination(empty, items).count()


@pytest.mark.parametrize("sent", [decontaminate.SENT_WORDS, 0])
def test_decontamination_judges_each_row(spark, odd, empty, tmp_path, sent):
    """Clean rows stay though another row of their doc_id goes; rows without doc_id go by their texts."""
    spark.createDataFrame([(1, "one"), (2, None), (3, " ".join(f"q{i}" for i in range(14)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = "before " + " ".join(f"q{i}" for i in range(2, 12)) + " after"
    rows = [(5, "clean here"), (5, leak), (5, leak), (None, leak), (None, "clean too"), (6, None), (7, "one"), (8, " ".join(f"q{i}" for i in range(9)))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    got = decontaminate.stage(spark, docs, str(tmp_path), sent)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([rows[0], rows[4], rows[5], rows[7]])
    whole = Counter((r.doc_id, r.text) for r in odd.collect())
    assert Counter((r.doc_id, r.text) for r in decontaminate.stage(spark, odd, str(tmp_path), sent).collect()) == whole - Counter({(4, "one"): 1, (5, "one"): 2})
    assert not decontaminate.stage(spark, empty, str(tmp_path), sent).count()


# 5: licenses


def test_licenses_of_odd_tables(spark, odd, empty):
    text = "foo bar. Released under the  MIT license!\nx " * 2 + "ALL rights, reserved"
    df = spark.createDataFrame([(1, text), (2, "Released under the MIT"), (3, None), (1, text)], "doc_id long, text string")
    got = Counter((r.doc_id, r.license, r.containment) for r in licenses.license_matches(df).collect())
    assert got == Counter({(1, "MIT", 1.0): 2, (1, "proprietary", 1.0): 2})
    assert not licenses.license_matches(odd).count() and not licenses.license_matches(empty).count() and not licenses.license_matches(df, ()).count()


def test_many_templates_are_looked_up():
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    templates = tuple((f"t{i}", text(rng.choice([3, 7, 12, 12, 30]))) for i in range(300)) + (("twin", "w1 w2 w3"), ("other twin", "w1 w2 w3"))
    library = licenses.Library(templates)
    chosen = [templates[i][1] for i in range(0, 300, 17)] + ["w1 w2 w3"]
    docs = [text(5) + " " + x + " " + text(9) for x in chosen] + ["", text(400)]
    found = licenses.scan(Words(pa.array(docs, pa.string())), library)
    want = set()  # plainly: containment in every window
    for row, doc in enumerate(docs):
        words = Words(pa.array([doc], pa.string()))
        for name, t in templates:
            own = Words(pa.array([t], pa.string()))
            k = min(licenses.K, len(own.hashes))
            shingles, size = np.unique(grams(own.hashes, own.first, k)[0]), licenses.group_length(len(own.hashes) - k + 1)
            h = grams(words.hashes, words.first, k)[0]
            if any(len(np.intersect1d(h[a : a + 2 * size], shingles)) >= licenses.CONTAINED * len(shingles) for a in range(0, len(h), size)):
                want.add((row, name))
    assert set(found) == want and {(len(chosen) - 1, "twin"), (len(chosen) - 1, "other twin")} <= want


def test_long_templates_are_found_when_damaged(spark):
    rng = random.Random(2)
    name, long = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    words = long.split()
    rows = []
    for i in range(200):
        own = list(words)
        own[rng.randrange(len(own))] = "changed"
        pad = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))]
        rows.append((i, " ".join(pad + own + pad)))
    assert licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).where(f"license = '{name}'").count() == 200


# 6 and 8: packing


def check_plan(plan, counts, capacity):
    used, rows = Counter(), {}
    for p in plan:
        assert used[p.length] == p.rank
        used[p.length] += p.count
        for i in range(p.count):
            rows.setdefault(p.sequence + i // p.each, []).append((p.offset + i % p.each * p.length, p.length))
    assert used == Counter({k: v for k, v in counts.items() if v})
    for row in rows.values():
        at = 0
        for offset, n in sorted(row):
            assert offset == at
            at += n
        assert at <= capacity
    return len(rows)


def test_plans_are_feasible_and_near_the_bound():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 50, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 20))}
        slack = check_plan(bin_slack.minimum_bin_slack(counts, capacity), counts, capacity)
        fit = check_plan(id_matrix.best_fit_decreasing(counts, capacity), counts, capacity)
        bound = max(-(-sum(k * v for k, v in counts.items()) // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
        assert bound <= slack <= fit + 1 and fit <= 1.25 * bound + 1
    assert bin_slack.minimum_bin_slack({}) == [] and id_matrix.best_fit_decreasing({}) == []


def test_best_fit_decreasing_equals_the_plain_rule():
    rng = random.Random(5)
    for _ in range(100):
        counts = {rng.randint(1, 40): rng.randint(1, 5) for _ in range(rng.randint(1, 12))}
        rooms: list[int] = []
        for n in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 40) - n)
        assert check_plan(id_matrix.best_fit_decreasing(counts, 40), counts, 40) == len(rooms)


def encoded(text):
    from tokenizers import Tokenizer

    t = encoded.__dict__.setdefault("t", Tokenizer.from_file(tokens.tokenizer_path()))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizers():
    odd = ["", None, "Don't STOP<|endoftext|>, x<|ENDOFTEXT|>. ΑΣ, İstanbul, e\u0301t\u0301 a b  \t c\r\nd!? ok?! 12,5 naïvé, 😀, Σ.", "a\n\n\nb", "東京, 大阪。", "x" * 5000 + ".", "a\x1cb c\x1f\u2003d\x85e\xa0f", "ﬁne K ǅ Straße ŉ ẞ"]
    coder = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):
        assert [[*np.frombuffer(x, "<u4"), 1] for x in coder.encode(odd)] == [encoded(t) for t in odd]
        coder.cache, coder.old = {}, coder.cache


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 20_000)
    monkeypatch.setattr(tokens, "WORD_BYTES", 20_000)
    code, rng = tokens.Encoder(tokens.tokenizer_path()), random.Random(6)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 12))) for _ in range(60)), "日本語" * 400, "x" * 3000]
        assert code.encode(texts) == [np.array(e.ids, code.kind).tobytes() for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for kept in (code.cache, code.old, code.words, code.old_words):
        assert sum(len(k) + len(v) for k, v in kept.items()) < 60_000 and all(len(k) <= tokens.LONG for k in kept)


def test_packing_is_lossless(spark, odd, empty):
    got = bin_slack.packed(odd, capacity=64).collect()
    parts: dict = {}
    for r in got:
        parts.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append((r.sequence_id, r.offset))
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = encoded(r.text)
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[r.doc_id, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter({k: len(v) for k, v in parts.items()}) == want
    rows: dict = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 64 and sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) for v in rows.values())
    assert not bin_slack.packed(empty).count()


def test_matrices_are_lossless(spark, odd, empty, tmp_path):
    id_matrix.write(id_matrix.packed_ids(odd, capacity=64, shard_tokens=500), str(tmp_path / "m"))
    got: dict = {}
    for row in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, positions = id_matrix.matrix(row, 64)
        assert len(ids) == 64 and row.cu_seqlens[-1] == row.n_tokens and row.position_resets == row.cu_seqlens[:-1]
        for d, k, a, b in zip(row.doc_ids, row.pieces, row.cu_seqlens, row.cu_seqlens[1:], strict=False):
            got.setdefault((d, k), []).append(ids[a:b].tolist())
            assert positions[a:b].tolist() == list(range(b - a))
    want: dict = {}
    for r in odd.select("doc_id", "text").collect():
        ids = encoded(r.text)
        for k, at in enumerate(range(0, len(ids), 64)):
            want.setdefault((r.doc_id, k), []).append(ids[at : at + 64])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert not id_matrix.packed_ids(empty).count()


def test_small_partitions_share_sequences(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string").repartition(50)
    rows = id_matrix.packed_ids(docs).collect()
    assert len(rows) == 1 and sorted(rows[0].doc_ids) == list(range(200))


# 7: language


def test_network_tables_equal_the_filters():
    net = language.Network(["a", "b"])
    x = language.windows_of(net.table[np.frombuffer("Ein Haus, und élan!".encode() * 40, np.uint8)])
    emb = net.p["E"][x]
    tops = [np.maximum((np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * language.EMBEDDED) @ net.p[f"W{w}"]).max(axis=1) + net.p[f"b{w}"], 0) for w in language.WIDTHS]
    want = language.softmax(np.concatenate(tops, axis=1) @ net.p["O"] + net.p["c"])
    assert np.allclose(net.shares(x, net.tables()), want, atol=1e-4)


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 509, 510, 3000):
        data = np.arange(1, n + 1)
        grams_in = {tuple(w[i : i + 4]) for w in language.windows_of(data) for i in range(len(w) - 3)}
        assert all(tuple(data[i : i + 4]) in grams_in for i in range(n - 3))


def test_language_is_learned(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = language.query(spark, sf.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_of_odd_tables(spark, odd, empty):
    assert language.trained(empty) is None
    assert {(r.lang_pred, r.score) for r in language.identified(odd, None).collect()} == {("und", 0.0)}
    net = language.trained(odd)
    rows = language.identified(odd, net).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 8, 10}
    assert not language.identified(empty, net).count()


# 9: urls


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "x://net?q/fr/", "http://notnet/", "http://sub.org/fr/a", "http://org.net.example.com/de/#", "a://b://c.net/x", "http://example.net/EN/", "http://net:80/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, best string, digest string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages, url_rules.rule_table(spark, url_rules.RULES)).collect()}
    assert len(got) == len(urls) + 1
    want = {0: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("example.net", "", None, "allow"), 5: ("example.net", "/", "net/", "block"), 6: ("net", "", None, "allow"),
            7: ("notnet", "/", None, "allow"), 8: ("sub.org", "/fr/a", "org/fr/", "allow"), 9: ("org.net.example.com", "/de/", "example.com/de/", "block"), 10: ("b:", "//c.net/x", None, "allow"), 11: ("example.net", "/EN/", "net/", "block"), 12: ("net:80", "/", None, "allow")}
    assert {k: got[k] for k in want} == want and got[13] == got[3]
    none = url_rules.rule_table(spark, [])
    assert {r.verdict for r in url_rules.judged(pages, none, "block").collect()} == {"block"}
    assert not url_rules.judged(pages.limit(0), none).count()


# 10: line chunks


def test_chunks_are_shift_resistant_and_first_stays(spark):
    rng = random.Random(1)
    passage = [f"passage line {i} {rng.random()}" for i in range(30)]
    rows = []
    for i in range(12):
        own = [f"own {i} {k} {rng.random()}" for k in range(20)]
        at = rng.randrange(20)
        rows.append((i, "\n".join(own[:at] + passage + own[at:])))
    rows += [(50, rows[0][1]), (51, None), (52, ""), (53, "x"), (53, "x")]
    got = {r.doc_id: r for r in line_chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, 12):
        left, kept = got[i].text.split("\n"), rows[i][1].split("\n")
        assert sum(x in passage for x in left) <= 12 and [x for x in kept if x not in passage] == [x for x in left if x not in passage]
        assert got[i].n_removed == len(kept) - len(left)
    assert got[50].n_removed == 50 and got[50].text == "" and got[51].text is None and got[52].text == "" and got[53].text == "x"


def brute_dedup(rows):
    seen: dict = {}
    for d, t in sorted({(d, t) for d, t in rows}, key=lambda r: (r[0], r[1] or "")):
        for k, c in line_chunks.chunks(t or ""):
            seen.setdefault(c, []).append((d, t, k))
    gone: dict = {}
    for places in seen.values():
        for d, t, k in places[1:]:
            gone.setdefault((d, t), set()).add(k)
    return Counter((d, line_chunks.without(t, gone[d, t])[0] if (d, t) in gone else t) for d, t in rows)


def test_line_dedup_against_a_table_of_chunks(spark):
    rng = random.Random(7)
    pool = [f"common line number {i} with words" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"rare {rng.random()}" for _ in range(rng.randint(1, 25)))) for i in range(80)]
    got = Counter((r.doc_id, r.text) for r in line_chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_dedup(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_passages_of_few_long_lines_are_removed(spark, n):
    rng = random.Random(n)
    line = lambda words: " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))
    passage = [line(54 // n + 1) for _ in range(n)]
    rows = []
    for i in range(12):
        own = [line(rng.choice([3, 20, 70])) for _ in range(rng.randint(4, 9))]
        at = rng.randint(0, len(own))
        rows.append((i, own[:at] + passage + own[at:], own))
    rows.append((20, ["again again"] * 60, ["again again"] * 25))  # 25 lines are the first run; those that overlap it stay
    got = {r.doc_id: r.text for r in line_chunks.deduplicated(spark.createDataFrame([(i, "\n".join(x)) for i, x, _ in rows], "doc_id long, text string")).collect()}
    assert got[0] == "\n".join(rows[0][1]) and all(got[i] == "\n".join(own) for i, _, own in rows[1:])


def test_line_dedup_of_odd_tables(spark, odd, empty):
    got = line_chunks.deduplicated(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns) and not line_chunks.deduplicated(empty).count()
    assert {r.text_hash for r in got.collect()} == {"x"}


def test_pseudonyms_of_odd_tables(spark, odd, empty):
    got = pseudonyms.pseudonymized(odd)
    assert {r.found for r in got.collect()} == {"x"} and got.where("n_pii > 0").count() == 0 and not pseudonyms.pseudonymized(empty).count()


def test_stored_tables_can_be_dropped(spark):
    from scriptoria.llm import common

    common.drop_stored(spark)
    df = common.stored(spark.range(3), "t")
    assert df.count() == 3 and common.drop_stored(spark) == 1 and common.drop_stored(spark) == 0


# the pipeline


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """No label to learn from, rows without doc_id, repeated rows, empty and long texts; and no rows at all."""
    import corpus_pipeline

    columns = empty.columns
    for name, docs in (("odd", odd.select(*columns).withColumn("lang", F.lit(None).cast("string"))), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in rows} == {5, None, 6, 7, 9} and sum(r.doc_id == 5 for r in rows) == 1
    assert not corpus_pipeline.run(spark, str(tmp_path / "empty")).count()


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= last
            last = docs.count()
    assert docs.select("doc_id").distinct().count() == last
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
