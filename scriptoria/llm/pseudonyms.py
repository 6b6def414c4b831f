"""PII pseudonyms by format-preserving Feistel networks, in DataFrame functions only.

Numbers and dates in a text are validated (Luhn, IBAN mod 97, calendar, octets, North American numbering) and
permuted under a key within their own format: the result is valid too, keeps separators and letter case, and equal
values get equal pseudonyms in all documents, however they are written. Each kind is a number below a * b; ten rounds
add a keyed digest of one half to the other, modulo a and b in turn, which is one to one. The local part of an e-mail
address is permuted by the same network over characters, each within its class (a-z, A-Z, 0-9). With inverse=True
the rounds run backwards.

Values are found in two passes, so that none is hidden by a number around it that isn't valid. Formats that a pattern can
validate wholly (e-mail, phone, IP, SSN, date) are matched first. In what lies between, every run of digit groups (or
letters and digits, for IBANs) that begin and end at a group's border is validated; of valid runs that overlap the longest
counts, of equally long ones the first, until what is left holds no valid run, however many stand side by side.

A date's pseudonym stays in its century and on the same side of the 12th of the month: a slashed date whose day and
month could be exchanged is read with the day first, and its pseudonym is such a date too, so that all dates of a century
are permuted one to one in each way of writing. inverse=True restores every value that stands apart; digits one blank
or hyphen away from a card number may make another run valid by chance (one in ten), and it is then read with them.

Edge cases: null text stays null with counts of 0; numbers that fail validation stay as they are; a text may hold any
number of values; repeated rows are changed alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import common

KEY, ROUNDS = "example key, replace in production", 10
KINDS = ("email", "iban", "phone", "ip", "ssn", "date", "card")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Years of four centuries, leap years of them, and days and months in the order that a separator goes with.
_YEAR, _LEAP = "(?:1[89]|2[01])[0-9]{2}", "(?:(?:1[89]|2[01])(?:0[48]|[2468][048]|[13579][26])|2000)"


def _dates(year: str, month: str, day: str, mark: str, order: str) -> str:
    at = {"y": year, "m": month, "d": day}
    return mark.join(at[x] for x in order)


def _calendar(mark: str, order: str) -> str:
    """A pattern of the days that there are."""
    days = ((_YEAR, "(?:0[1-9]|1[0-2])", "(?:0[1-9]|1[0-9]|2[0-8])"), (_YEAR, "(?:0[13-9]|1[0-2])", "(?:29|30)"), (_YEAR, "(?:0[13578]|1[02])", "31"), (_LEAP, "02", "29"))
    return "|".join(_dates(*x, mark, order) for x in days)


#: Whatever matches one of these is valid.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "date": rf"(?<![0-9./-])(?:{_calendar('-', 'ymd')}|{_calendar(chr(92) + '.', 'dmy')}|{_calendar('/', 'dmy')}|{_calendar('/', 'mdy')})(?![0-9/-]|\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What may hold a card number or an IBAN, which a pattern can't validate, and the most groups (a card's 19 digits, each
#: apart; an IBAN has 9) and characters of one. These are the formats' own bounds: no number in a format is beyond them.
POSSIBLE = r"[0-9](?:[ -]?[0-9]){12}|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2}"
GROUPS, LEAST_CARD, MOST_CARD, LEAST_IBAN, MOST_IBAN = 19, 13, 19, 12, 35
IBAN = r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"


def _digest(key: str, *parts) -> Column:
    """60 bits of a keyed digest."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permuted(kind: Column, value: Column, a: Column, b: Column, key: str, inverse: bool) -> Column:
    """A keyed permutation of the numbers below a * b (decimal digits of value: at most 18)."""
    start = F.struct(F.pmod(value, a).alias("x"), ((value - F.pmod(value, a)) / a).cast("long").alias("y"))

    def turn(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        sign = F.lit(-1 if inverse else 1)
        x, y = s["x"], s["y"]
        new_x = F.when(even, F.pmod(x + sign * F.pmod(_digest(key, kind, a, b, i, y), a), a)).otherwise(x)
        new_y = F.when(even, y).otherwise(F.pmod(y + sign * F.pmod(_digest(key, kind, a, b, i, x), b), b))
        return F.struct(new_x.alias("x"), new_y.alias("y"))

    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])
    return F.aggregate(rounds, start, turn, lambda s: s["x"] + s["y"] * a)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _digits(n: Column, size: Column) -> Column:
    return F.lpad(n.cast("string"), size, "0")


def _luhn_sum(digits: Column) -> Column:
    """Sum of digits, doubled (less 9 if over 9) at every other place, beginning with the last but none: for a payload without its check digit."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(back, lambda d, i: F.when(d == "", 0).when(F.pmod(i, F.lit(2)) == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))),
        F.lit(0),
        lambda s, d: s + d,
    )


def _check_digit(payload: Column) -> Column:
    return F.pmod(F.lit(10) - F.pmod(_luhn_sum(payload), F.lit(10)), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """Of letters as 10 to 35 and digits."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _masked(shape: Column, digits: Column) -> Column:
    """digits in the places of shape's digits."""
    def at(c, i):
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), at), "")


def _letters(text: Column, key: str, inverse: bool) -> Column:
    """The Feistel network over characters: each half is shifted, within classes, by a digest of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("x"), F.substring(text, half + 1, F.length(text)).alias("y"))

    def shifted(part, other, i):
        def one(c, k):
            stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.floor(k / 16).cast("string"), other), 256)
            by = F.conv(F.substring(stream, F.pmod(k, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") * (-1 if inverse else 1)
            code = F.ascii(c)
            return (
                F.when(c.rlike("[a-z]"), F.chr(F.pmod(code - 97 + by, F.lit(26)) + 97)).when(c.rlike("[A-Z]"), F.chr(F.pmod(code - 65 + by, F.lit(26)) + 65))
                .when(c.rlike("[0-9]"), F.chr(F.pmod(code - 48 + by, F.lit(10)) + 48)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def turn(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, shifted(s["x"], s["y"], i)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(shifted(s["y"], s["x"], i)).alias("y"))

    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])
    return F.aggregate(rounds, start, turn, lambda s: F.concat(s["x"], s["y"]))


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY."""
    return (
        F.when(m.contains("@"), F.lit("email")).when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$"), F.lit("date")).when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.lit("ip")).otherwise(F.lit("phone"))
    )


def _day(m: Column) -> Column:
    """The date of a match; with slashes the month is first only where the second number is over 12."""
    months_first = F.substring(m, 4, 2).cast("int") > 12
    slashed = F.when(months_first, F.try_to_date(m, "MM/dd/yyyy")).otherwise(F.try_to_date(m, "dd/MM/yyyy"))
    return F.when(m.rlike("-"), F.try_to_date(m, "yyyy-MM-dd")).when(m.rlike(r"\."), F.try_to_date(m, "dd.MM.yyyy")).otherwise(slashed)


def _date(m: Column, key: str, inverse: bool) -> Column:
    """A day of the same century and the same side of the 12th, in the same writing.

    Days up to the 12th are 14,400 in each century, numbered by year, month and day. The later ones are numbered in their
    order: a day's number in the century less twelve for each month begun."""
    day = _day(m)
    century = F.floor(F.year(day) / 100).cast("int")
    first = F.make_date(century * 100, F.lit(1), F.lit(1))
    long = lambda n: F.lit(n).cast("long")
    part = lambda n, by: ((n - F.pmod(n, long(by))) / by).cast("long")
    months = ((F.year(day) - century * 100) * 12 + F.month(day) - 1).cast("long")
    early = permuted(F.concat(F.lit("date to the 12th "), century.cast("string")), months * 12 + F.dayofmonth(day) - 1, long(120), long(120), key, inverse)
    early = _bound(early, lambda n: F.date_add(F.add_months(first, part(n, 12).cast("int")), F.pmod(n, long(12)).cast("int")))
    leap = F.pmod(century, F.lit(4)) == 0  # 22,125 later days, or 22,124
    a, b = F.when(leap, long(125)).otherwise(long(4)), F.when(leap, long(177)).otherwise(long(5531))
    late = permuted(F.concat(F.lit("date after the 12th "), century.cast("string")), F.date_diff(day, first).cast("long") - 12 * (months + 1), a, b, key, inverse)
    before = lambda k: F.date_diff(F.add_months(first, k.cast("int")), first) - 12 * k  # noqa: E731  later days before month k

    def later(n):
        guess = F.floor(n * 1200 / (a * b)).cast("int")
        near = F.filter(F.sequence(guess - 3, guess + 3), lambda k: (k >= 0) & (k < 1200) & (before(k) <= n) & (n < before(k + 1)))
        return _bound(F.element_at(near, 1), lambda k: F.date_add(F.add_months(first, k), (n - before(k) + 12).cast("int")))

    late = _bound(late, later)
    new = F.when(F.dayofmonth(day) <= 12, early).otherwise(late)
    months_first = F.substring(m, 4, 2).cast("int") > 12
    form = F.when(m.rlike("-"), "yyyy-MM-dd").when(m.rlike(r"\."), "dd.MM.yyyy").when(months_first, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    return F.call_function("date_format", new, form)


def _grouped(text: Column, key: str, inverse: bool) -> Column:
    """struct<text, cards, ibans> of a text without matches of ANY: its card numbers and IBANs are replaced."""

    def fresh(p):
        return F.when(p["kind"] == "", p["t"]).otherwise(pseudonym(p["kind"], p["t"], key, inverse, ("card", "iban")))

    number = lambda kind: lambda parts: F.size(F.filter(parts, lambda p: p["kind"] == kind))
    return _bound(_cut(text), lambda x: F.struct(F.array_join(F.transform(x, fresh), "").alias("text"), number("card")(x).alias("cards"), number("iban")(x).alias("ibans")))


def _cut(text: Column) -> Column:
    """array<struct<t, kind>>: the valid runs of a text that count and what lies between, in which no run is valid.

    The text is a list of tokens, groups and what stands between. All valid runs are found once. They are taken by their
    size, from the longest down, and from left to right within a size, if no token of theirs is taken: each size is one
    pass over the tokens, and there are no more sizes than a card number or an IBAN can have."""
    tokens = F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+|[^0-9A-Za-z]+"), F.lit(0))
    state = _bound(tokens, lambda t: F.struct(t.alias("t"), F.flatten(F.transform(t, lambda x, i: _runs(t, x, i))).alias("runs")))
    none = F.array().cast("array<struct<i:int,n:int,size:int,kind:string>>")

    def spans(count, taken):
        """(from, number of tokens, kind) of the runs, and of what lies before each and after the last."""
        lo, hi = F.concat(F.array(F.lit(0)), F.transform(taken, lambda r: r["i"] + r["n"])), F.concat(F.transform(taken, lambda r: r["i"]), F.array(count))
        gaps = F.zip_with(lo, hi, lambda lo, hi: F.struct(lo.alias("i"), (hi - lo).alias("n"), F.lit("").alias("kind")))
        runs = F.transform(taken, lambda r: F.struct(r["i"].alias("i"), r["n"].alias("n"), r["kind"].alias("kind")))
        both = F.flatten(F.zip_with(gaps, runs, lambda g, r: F.when(r.isNull(), F.array(g)).otherwise(F.array(g, r))))
        return F.filter(both, lambda x: x["n"] > 0)

    def counting(count, runs):
        """The runs that count, in their order."""

        def of_size(s, size):
            free = F.filter(runs, lambda r: (r["size"] == size) & ~F.exists(F.slice(s["held"], r["i"] + 1, r["n"]), lambda h: h))
            start = F.struct(F.lit(0).alias("end"), none.alias("taken"))
            step = lambda p, r: F.when(r["i"] < p["end"], p).otherwise(F.struct((r["i"] + r["n"]).alias("end"), F.concat(p["taken"], F.array(r)).alias("taken")))
            taken = F.array_sort(F.concat(s["taken"], F.aggregate(free, start, step, lambda p: p["taken"])))
            held = lambda taken: F.flatten(F.transform(spans(count, taken), lambda x: F.array_repeat(x["kind"] != "", x["n"])))
            return _bound(taken, lambda x: F.struct(x.alias("taken"), held(x).alias("held")))

        sizes = F.sort_array(F.array_distinct(F.transform(runs, lambda r: r["size"])), asc=False)
        return F.aggregate(sizes, F.struct(none.alias("taken"), F.array_repeat(F.lit(False), count).alias("held")), of_size, lambda s: s["taken"])

    def pieces(s):
        every = spans(F.size(s["t"]), counting(F.size(s["t"]), s["runs"]))
        return F.transform(every, lambda x: F.struct(F.array_join(F.slice(s["t"], x["i"] + 1, x["n"]), "").alias("t"), x["kind"].alias("kind")))

    return _bound(state, pieces)


def _runs(tokens: Column, token: Column, i: Column) -> Column:
    """array<struct<i, n, size, kind>>: the valid runs from token i, with their numbers of tokens and characters."""

    def candidates(least, most, joined, kind, valid):
        groups = F.sequence(F.lit(GROUPS), F.lit(1), F.lit(-1))
        run = lambda g: F.slice(tokens, i + 1, 2 * g - 1)
        right = F.filter(groups, lambda g: (i + 2 * g - 1 <= F.size(tokens)))
        found = F.transform(right, lambda g: F.struct((2 * g - 1).alias("n"), F.array_join(run(g), "").alias("m")))
        fits = F.filter(found, lambda c: F.length(F.regexp_replace(c["m"], "[ -]", "")).between(least, most) & c["m"].rlike(joined))
        good = F.filter(fits, lambda c: valid(c["m"]))
        return F.transform(good, lambda c: F.struct(i.alias("i"), c["n"].alias("n"), F.length(c["m"]).alias("size"), F.lit(kind).alias("kind")))

    iban = F.when(token.rlike("^[A-Z]{2}[0-9]{2}"), candidates(LEAST_IBAN, MOST_IBAN, IBAN, "iban", lambda m: _mod97(_turned(m)) == 1))
    card = F.when(token.rlike("^[0-9]+$"), candidates(LEAST_CARD, MOST_CARD, "^[0-9]+(?:[ -][0-9]+)*$", "card", _card))
    return F.coalesce(iban, card, F.array().cast("array<struct<i:int,n:int,size:int,kind:string>>"))


def _turned(m: Column) -> Column:
    """An IBAN's account before its country and check digits."""
    plain = F.regexp_replace(m, " ", "")
    return F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.substring(digits, -1, 1) == _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def pseudonym(kind: Column, m: Column, key: str, inverse: bool, kinds: tuple = KINDS) -> Column:
    """The pseudonym of a valid value of one of these kinds."""
    made = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card_number}
    out = F
    for k in kinds:
        out = out.when(kind == k, made[k](m, key, inverse))
    return out


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _part(n: Column, by: int) -> Column:
    """n / by, whole."""
    return ((n - F.pmod(n, _long(by))) / by).cast("long")


def _email(m: Column, key: str, inverse: bool) -> Column:
    local = F.regexp_extract(m, "^([^@]*)@", 1)
    return F.concat(_letters(local, key, inverse), F.substring(m, F.length(local) + 1, F.length(m)))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    address = F.aggregate(F.transform(F.split(m, r"\."), lambda o: o.cast("long")), _long(0), lambda s, o: s * 256 + o)
    octets = F.array(*[_long(256**i) for i in (3, 2, 1, 0)])
    new = permuted(F.lit("ip"), address, _long(65536), _long(65536), key, inverse)
    return _bound(new, lambda n: F.array_join(F.transform(octets, lambda p: F.pmod(((n - F.pmod(n, p)) / p).cast("long"), _long(256)).cast("string")), "."))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """Area and exchange from 200 to 999, line of four digits."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    national = F.substring(digits, -10, 10)
    number = (F.substring(national, 1, 3).cast("long") - 200) + 800 * ((F.substring(national, 4, 3).cast("long") - 200) * 10000 + F.substring(national, 7, 4).cast("long"))

    def shown(n):
        rest = _part(n, 800)
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), (F.pmod(n, _long(800)) + 200).cast("string"), (_part(rest, 10000) + 200).cast("string"), _digits(F.pmod(rest, _long(10000)), F.lit(4)))

    return _masked(m, _bound(permuted(F.lit("phone"), number, _long(800), _long(8_000_000), key, inverse), shown))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    area = F.substring(digits, 1, 3).cast("long")
    number = (area - F.when(area > 666, 2).otherwise(1)) + 898 * ((F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1)

    def shown(n):
        rest, area = _part(n, 898), F.pmod(n, _long(898)) + 1
        return F.concat(_digits(F.when(area >= 666, area + 1).otherwise(area), F.lit(3)), _digits(_part(rest, 9999) + 1, F.lit(2)), _digits(F.pmod(rest, _long(9999)) + 1, F.lit(4)))

    return _masked(m, _bound(permuted(F.lit("ssn"), number, _long(898), _long(99 * 9999), key, inverse), shown))


def _card_number(m: Column, key: str, inverse: bool) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits) - 1
    low = F.floor(n / 2).cast("int")
    payload = permuted(F.concat(F.lit("card"), n.cast("string")), F.substring(digits, F.lit(1), n).cast("long"), _power(low), _power(n - low), key, inverse)
    return _masked(m, _bound(_digits(payload, n), lambda p: F.concat(p, _check_digit(p))))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """Country and letters stay; the account's digits (in parts of at most 16) are permuted and the check digits made anew."""
    plain = F.regexp_replace(m, " ", "")
    account = F.substring(plain, F.lit(5), F.length(plain))
    digits = F.regexp_replace(account, "[^0-9]", "")
    frame = F.concat(F.substring(plain, 1, 2), F.regexp_replace(account, "[0-9]", "#"))

    def part(i):
        own = F.substring(digits, i * 16 + 1, F.lit(16))
        n = F.length(own)
        low = F.floor(n / 2).cast("int")
        new = _digits(permuted(F.concat(F.lit("iban"), frame, i.cast("string")), own.cast("long"), _power(low), _power(n - low), key, inverse), n)
        return F.when(n > 0, new).otherwise("")

    fresh = F.array_join(F.transform(F.array(F.lit(0), F.lit(1)), part), "")
    account = _masked(account, fresh)
    check = _digits(98 - _mod97(F.concat(account, F.substring(plain, 1, 2), F.lit("00"))), F.lit(2))
    digits = F.concat(check, fresh)
    return _masked(m, digits)


def pseudonymized(docs: DataFrame, key: str = KEY, inverse: bool = False) -> DataFrame:
    """docs with text: text has pseudonyms; n_pii and a count of each kind are added (or replaced)."""
    counts = ["n_pii", *(f"n_{k}" for k in KINDS)]
    names = [c for c in docs.columns if c not in counts]
    text = F.col("text").cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(*names, found.alias("__found"))
    between = F.when(F.size("__found") > 0, F.split(text, ANY, -1)).when(text.rlike(POSSIBLE), F.array(text))
    gap = lambda g: F.when(g.rlike(POSSIBLE), _grouped(g, key, inverse)).otherwise(F.struct(g.alias("text"), F.lit(0).alias("cards"), F.lit(0).alias("ibans")))
    shown = F.transform("__found", lambda m: _bound(kind_of(m), lambda k: F.struct(k.alias("kind"), pseudonym(k, m, key, inverse, tuple(PATTERNS)).alias("text"))))
    rows = rows.select(*names, F.transform(between, gap).alias("__gaps"), shown.alias("__shown"))
    joined = F.array_join(F.zip_with("__gaps", "__shown", lambda g, m: F.concat(g["text"], F.coalesce(m["text"], F.lit("")))), "")

    def of(kind: str) -> Column:
        if kind in ("card", "iban"):
            return F.coalesce(F.aggregate("__gaps", F.lit(0), lambda n, g: n + g[f"{kind}s"]), F.lit(0)).cast("long")
        return F.coalesce(F.size(F.filter("__shown", lambda m: m["kind"] == kind)), F.lit(0)).cast("long")

    every = F.coalesce(F.size("__shown"), F.lit(0)) + F.coalesce(F.aggregate("__gaps", F.lit(0), lambda n, g: n + g["cards"] + g["ibans"]), F.lit(0))
    new = F.when(F.col("__gaps").isNotNull(), joined).otherwise(text).alias("text")
    return rows.select(*(new if c == "text" else F.col(c) for c in names), every.cast("long").alias("n_pii"), *(of(k).alias(f"n_{k}") for k in KINDS))


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymized(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
