"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in DataFrame expressions only.

Found and validated: e-mail addresses, card numbers (Luhn), IBANs (mod 97), phone numbers (8 to 15 digits), US social security numbers
(issued ranges), IPv4 addresses (octets to 255, no leading zeros) and calendar dates from 1900 to 2099. What looks alike but fails its check stays as it is. Every place where
a value may begin is looked at unless a value before covers it, also within what failed its check, and forms that took in what follows are tried again without their
last parts: IBANs by their country's length first, phone numbers by their country code's number of digits and not into a date, time, address or card number. A number
after a phone number is taken for a part of it where the country's numbers vary in length and leave room for it. A value's
pseudonym is another valid value of the same format: digits stay digits, letters keep their case, separators stay, check digits are
made anew. It depends on the key and the value alone, so equal values stay linked across documents, and every step is a permutation, so
different values stay different.

Dates stay in their format: the order of day and month and the parts' widths. Of d/m/yyyy and m/d/yyyy, those that can be read in one order only move among
such dates, those that can be read either way among those, so no two dates meet. Where parts and year don't make a date, the permutation is applied again.

The key is a secret: who knows it can undo the pseudonyms. The queries take it from the session's setting SECRET; where none is set, one is drawn at random and set, so that
pseudonyms agree within the session alone. It stands in query plans, as any literal does.

Two networks of ROUNDS rounds are used, both with SHA-256 as round function: over the characters of a string, where each half's letters
and digits are shifted by amounts drawn from the other half; and over a pair of numbers below a and b, for values whose domain isn't a
power of ten (days, octets, numbers with ranges that aren't issued).

Defined cases: a null text stays null and has no finds; an empty one stays empty. Rows are never joined, so repeated rows and null ids keep their rows. An
empty table gives an empty result. Input columns named like result columns are replaced.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm.common import let

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Lengths of IBANs by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Digits after the country code, least and most, by country code.
PHONES = {
    (6, 6): "376", (7, 7): "354", (8, 8): "45 47 53 65 216 356 357 370 371 373 374 382 387 389 852 853 968 973 974", (6, 11): "39 49 352 358", (7, 8): "372 961", (7, 9): "46 353", (4, 13): "43",
    (8, 9): "32 36 51 66 213 355 359 377 385 855 886 962 965 971 972", (8, 10): "20 57 60 63 64 82 234", (9, 9): "27 31 33 34 40 41 48 56 61 93 94 212 218 251 254 255 256 351 375 380 381 386 420 421 963 967 994 995 996 998 966",
    (9, 10): "44 81 84 92", (10, 10): "1 7 30 52 58 90 91 98 880 964 977", (10, 11): "54 55", (8, 12): "62", (7, 10): "95", (10, 12): "86",
}
_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
#: What a phone number doesn't run into: a date, a time, an address, a social security number, a card number.
_OTHER = rf"(?:(?:19|20)\d\d-(?:0\d|1[0-2])-[0-3]\d|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{1,2}}:\d\d|{_IP}|\d{{3}}-\d\d-\d{{4}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,7}})(?!\d)"
_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})\d\d(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBANS.items())
_PLUS = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?"
#: By kind, the forms of a value from its first sign on; the first that passes the kind's check counts.
FORMATS = {
    "email": [r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"],
    "iban": [_COUNTRY, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"],
    "ip": [_IP],
    "date": [_DATE],
    "ssn": [r"\d{3}-\d{2}-\d{4}"],
    "phone": [rf"{_PLUS}(?:(?:[ .-](?!{_OTHER}))?\d{{2,4}}){{1,7}}", _PLUS + r"(?:[ .-]?\d{2,4}){1,7}", r"\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"],
    "card": [r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}", r"\d{13,19}"],
}
#: Empty matches before all that may begin a value.
STARTS = EDGE + "(?=" + "|".join([
    r"(?<![A-Za-z0-9._%+-])" + FORMATS["email"][0], r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}", rf"(?<!\d\.){_IP}", _DATE, FORMATS["ssn"][0], _PLUS + r"[ .-]?\d{2}", FORMATS["phone"][2], *[rf"(?:{x})" for x in FORMATS["card"]],
]) + ")"
#: What is looked at from a start on: more than any value but an e-mail address takes.
VIEW = rf"{STARTS}(?=((?:{FORMATS['email'][0]})?(?s:.){{0,99}}))"
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days end with 2099-12-31
WALK = 12  # at most 3 in 100 pairs of day and month aren't dates, so a longer walk has a chance of 1e-12 for each key
SECRET = "spark.cardlake.pseudonyms.secret"
Tweak = Callable[[Column], Column]


def _digest(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value), 256)


def permute_pair(key: str, kind: str, first: Column, second: Column, a: int | Column, b: int | Column) -> Column:
    """A permutation of the pairs with first below a and second below b: struct(x, y)."""
    a, b = (F.lit(n) if isinstance(n, int) else n for n in (a, b))

    def amount(turn: Column, value: Column, below: Column) -> Column:
        return F.pmod(F.conv(F.substring(_digest(key, kind, turn, value.cast("string")), 1, 15), 16, 10).cast("long"), below)

    def turned(acc: Column, r: Column) -> Column:
        even = F.struct(F.pmod(acc["x"] + amount(r, acc["y"], a), a).cast("long").alias("x"), acc["y"].alias("y"))
        odd = F.struct(acc["x"].alias("x"), F.pmod(acc["y"] + amount(r, acc["x"], b), b).cast("long").alias("y"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(first.cast("long").alias("x"), second.cast("long").alias("y")), turned)


def characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"(?s)."), F.lit(0))


def permute_characters(key: str, kind: str, value: Column) -> Column:
    """A permutation of the strings of one shape: ASCII letters and digits move within their kind, all else stays."""

    def moved(c: Column, by: Column) -> Column:
        code, shift = F.ascii(c), lambda low, n: F.char(F.lit(low) + F.pmod(F.ascii(c) - low + by, F.lit(n)))
        return F.when(code.between(48, 57), shift(48, 10)).when(code.between(97, 122), shift(97, 26)).when(code.between(65, 90), shift(65, 26)).otherwise(c)

    def shifted(part: Column, other: Column, r: Column) -> Column:
        by = lambda hashed, i: F.conv(F.substr(hashed, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return let(_digest(key, kind, r, other), lambda h: F.array_join(F.transform(characters(part), lambda c, i: moved(c, by(h, i))), ""))

    def turned(acc: Column, r: Column) -> Column:
        left = F.struct(shifted(acc["l"], acc["r"], r).alias("l"), acc["r"].alias("r"))
        right = F.struct(acc["l"].alias("l"), shifted(acc["r"], acc["l"], r).alias("r"))
        return F.when(r % 2 == 0, left).otherwise(right)

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda acc: F.concat(acc["l"], acc["r"]))


def refilled(shape: Column, signs: Column) -> Column:
    """shape with its letters and digits replaced, in order, by signs."""
    step = lambda acc, c: F.when(
        c.rlike("[A-Za-z0-9]"), F.struct(F.concat(acc["s"], F.substr(signs, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))
    return F.aggregate(characters(shape), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda acc: acc["s"])


def luhn_sum(body: Column) -> Column:
    """The Luhn sum of digits that a check digit will follow."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    from_right = F.transform(characters(F.reverse(body)), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 0, twice(d)).otherwise(d)))
    return F.aggregate(from_right, F.lit(0), lambda acc, d: acc + d)


def mod97(signs: Column) -> Column:
    """The number that letters (A as 10) and digits spell, modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(characters(signs), F.lit(0), lambda acc, c: let(value(c), lambda v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))))


def _email(key: str, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_characters(key, "email", local), F.substr(m, F.length(local) + 1))


def _iban(key: str, m: Column) -> Column:
    def made(s: Column) -> Column:
        country = F.substr(s, F.lit(1), F.lit(2))
        body = permute_characters(key, "iban", F.substr(s, F.lit(5)))
        full = let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(mod97(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))) == 1, refilled(m, full))

    return let(F.translate(m, " ", ""), made)


def _ip(key: str, m: Column) -> Column:
    def made(o: Column) -> Column:
        text = let(
            permute_pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536),
            lambda p: F.concat_ws(".", *[x.cast("string") for q in ("x", "y") for x in (F.floor(p[q] / 256).cast("int"), p[q] % 256)]),
        )
        return F.when(F.forall(o, lambda x: x <= 255), text)

    return F.when(~m.rlike(r"(?:^|\.)0\d"), let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), made))


def _iso_date(key: str, m: Column) -> Column:
    d = F.try_to_date(m, "yyyy-MM-dd")

    def moved(d: Column) -> Column:
        number = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        new = let(permute_pair(key, "date", F.floor(number / DAYS[1]), number % DAYS[1], *DAYS), lambda p: (p["x"] * DAYS[1] + p["y"]).cast("int"))
        return F.when(d.between(FIRST_DAY, "2099-12-31"), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new), "yyyy-MM-dd"))

    return let(d, moved)


def _days(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _parted_date(key: str, m: Column) -> Column:
    """d.m.yyyy, and d/m/yyyy or m/d/yyyy: dates move among those that can be read in the same orders and have parts of the same widths."""
    dot = m.contains(".")

    def made(p: Column) -> Column:
        """p: strings of first part, second part, year."""
        x, y, year = (p[i].cast("int") for i in range(3))
        few = lambda part: F.when(F.length(part) == 1, 9).otherwise(12)
        # least and most of each part, by what a reader can tell: the day first, the day second, or either
        day_first, day_second = dot | (x > 12), ~dot & (y > 12)
        most_day = F.when(F.length(p[0]) == 1, 9).otherwise(31)
        low = F.struct(F.when(~dot & day_first, 13).otherwise(1).alias("x"), F.when(day_second, 13).otherwise(1).alias("y"))
        high = F.struct(F.when(dot, most_day).when(day_first, 31).otherwise(few(p[0])).alias("x"), F.when(day_second, 31).otherwise(few(p[1])).alias("y"))
        is_date = lambda a, b, y: F.when(day_second, (a <= 12) & (b <= _days(y, a))).otherwise((b <= 12) & (a <= _days(y, b)))
        fits = (x >= 1) & (y >= 1) & year.between(1900, 2099) & is_date(x, y, year)

        def walked(bounds: Column) -> Column:
            """The pair of parts and the year, permuted until they are a date."""
            n = [bounds["high"][c] - bounds["low"][c] + 1 for c in ("x", "y")]
            part = lambda acc, c: bounds["low"][c] + (F.floor(acc["x"] / n[1]) if c == "x" else acc["x"] % n[1]).cast("int")
            sure = lambda acc: is_date(part(acc, "x"), part(acc, "y"), acc["y"] + 1900)
            turn = lambda acc: let(permute_pair(key, "date", acc["x"], acc["y"], n[0] * n[1], 200), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), sure(q).alias("ok")))
            start = F.struct(((x - bounds["low"]["x"]) * n[1] + y - bounds["low"]["y"]).cast("long").alias("x"), (year - 1900).cast("long").alias("y"), F.lit(False).alias("ok"))
            sign = F.when(dot, ".").otherwise("/")
            written = lambda acc, c, i: F.concat(F.lpad(part(acc, c).cast("string"), F.length(p[i]), F.lit("0")), sign)
            text = lambda acc: F.concat(written(acc, "x", 0), written(acc, "y", 1), (acc["y"] + 1900).cast("string"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda acc, _: F.when(acc["ok"], acc).otherwise(turn(acc)), text)

        return F.when(fits, let(F.struct(low.alias("low"), high.alias("high")), walked))

    return let(F.split(m, "[./]"), made)


def _date(key: str, m: Column) -> Column:
    return F.when(m.contains("-"), _iso_date(key, m)).otherwise(_parted_date(key, m))


def _ssn(key: str, m: Column) -> Column:
    def made(p: Column) -> Column:
        area = p[0] - 1 - F.when(p[0] > 666, 1).otherwise(0)  # 001-899 without 666
        text = let(
            permute_pair(key, "ssn", area, (p[1] - 1) * 9999 + p[2] - 1, 898, 99 * 9999),
            lambda q: F.format_string("%03d-%02d-%04d", q["x"] + 1 + F.when(q["x"] >= 665, 1).otherwise(0), F.floor(q["y"] / 9999) + 1, q["y"] % 9999 + 1),
        )
        return F.when((p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0), text)

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), made)


def _phone(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        kept = F.greatest(F.length(d) - 10, F.when(m.startswith("+"), 1).otherwise(0))
        new = F.concat(F.substr(d, F.lit(1), kept), permute_characters(key, "phone", F.substr(d, kept + 1)))
        return F.when(F.length(d).between(8, 15), refilled(m, new))

    return let(F.regexp_replace(m, "[^0-9]", ""), made)


def _card(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        body, last = F.substr(d, F.lit(1), F.length(d) - 1), F.substr(d, F.length(d)).cast("int")
        check = lambda b: F.pmod(10 - luhn_sum(b) % 10, F.lit(10))
        new = let(permute_characters(key, "card", body), lambda b: F.concat(b, check(b).cast("string")))
        return F.when(F.length(d).between(13, 19) & (check(body) == last), refilled(m, new))

    return let(F.regexp_replace(m, "[^0-9]", ""), made)


def _iban_passes(m: Column) -> Column:
    return let(F.translate(m, " ", ""), lambda s: F.length(s).between(12, 35) & (mod97(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))) == 1))


def _card_passes(m: Column) -> Column:
    return let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.length(d).between(13, 19) & ((luhn_sum(F.substr(d, F.lit(1), F.length(d) - 1)) + F.substr(d, F.length(d)).cast("int")) % 10 == 0))


def _phone_fits(m: Column, least: bool) -> Column:
    """Whether a number with a country code has as many digits as the country's, or as many at most."""
    lengths = "|".join(rf"(?:{c.replace(' ', '|')})\d{{{lo if least else 0},{hi}}}" for (lo, hi), c in PHONES.items())
    return m.startswith("+") & let(F.regexp_replace(m, "[^0-9]", ""), lambda d: F.length(d).between(8, 15) & d.rlike(f"^(?:{lengths})$"))


def _value(kind: str, view: Column) -> Column:
    """The value of a kind at the beginning of view; null or empty without one."""
    end = rf"(?:{END}|(?=[Tt]\d))" if kind == "date" else END
    seen = [F.regexp_extract(view, f"^(?:{x}){end}", 0) for x in FORMATS[kind]]
    first = lambda found, passes: F.get(F.filter(found, passes), F.lit(0))
    # a form that took in what follows is tried without its last 0, 1, 2 ... parts
    less = lambda m, part: let(m, lambda x: F.array(*[F.regexp_extract(x, rf"^(.+?)(?:{part}){{{k}}}$", 1) for k in range(8)]))
    if kind == "iban":
        return first(F.concat(F.array(seen[0]), less(seen[1], " [A-Z0-9]+")), _iban_passes)
    if kind == "phone":
        part = r"[ .-]\(?\d+\)?"
        passes = [lambda m: _phone_fits(m, True), lambda m: _phone_fits(m, False), lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)]
        return let(F.concat(less(seen[0], part), less(seen[1], part), F.array(seen[2])), lambda found: F.coalesce(*[first(found, f) for f in passes]))
    if kind == "card":
        return first(F.array(*seen), _card_passes)
    return seen[0]


def replaced(key: str, view: Column) -> Column:
    """struct(kind, n, new) of the value that view begins with, n its length; null where none passes its check."""
    makers = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}

    def made(k: str) -> Column:
        new = lambda m: let(makers[k](key, m), lambda x: F.when(x.isNotNull(), F.struct(F.lit(k).alias("kind"), F.length(m).alias("n"), x.alias("new"))))
        return let(_value(k, view), lambda m: F.when(m != "", new(m)))

    return F.coalesce(*[made(k) for k in KINDS])


def session_key(spark: SparkSession) -> str:
    """The session's secret; a random one is drawn and set where there is none."""
    if not spark.conf.get(SECRET, None):
        spark.conf.set(SECRET, secrets.token_hex(16))
    return spark.conf.get(SECRET)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text rewritten by the secret key, and n_<kind> for each kind and n_pii: how many values were replaced."""
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        """over: signs of the part that the last value covers. cuts: for each part the signs to leave out, with "+" before where its value is taken."""
        size = F.length(x["part"])
        taken = (acc["over"] == 0) & x["r"].isNotNull()
        over = F.when(taken, x["r"]["n"]).otherwise(acc["over"])
        return let(over, lambda o: F.struct(F.greatest(o - size, F.lit(0)).alias("over"), F.concat(acc["cuts"], F.when(taken, "+").otherwise(""), F.least(o, size).cast("string"), F.lit(",")).alias("cuts")))

    def rewritten(parts: Column, found: Column) -> Column:
        """parts: the text cut before each start, after a line feed; found: what is at each start."""
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        both = F.zip_with(rest, found, lambda part, r: F.struct(part.alias("part"), r.alias("r")))
        cuts = lambda xs: F.split(F.aggregate(xs, F.struct(F.lit(0).alias("over"), F.lit("").alias("cuts")), step, lambda acc: acc["cuts"]), ",")
        on = lambda x, c: F.struct(F.when(c.startswith("+"), x["r"]).alias("r"), F.substr(x["part"], F.regexp_replace(c, r"\+", "").cast("int") + 1).alias("left"))
        placed = let(both, lambda xs: F.zip_with(xs, F.slice(cuts(xs), 1, F.size(xs)), on))

        def put(ys: Column) -> Column:
            joined = F.array_join(F.transform(ys, lambda y: F.concat(F.coalesce(y["r"]["new"], F.lit("")), y["left"])), "")
            n = lambda k: F.size(F.filter(ys, lambda y: y["r"]["kind"] == k)).cast("long")
            return F.struct(F.substr(F.concat(parts[0], joined), F.lit(2)).alias("text"), *[n(k).alias(k) for k in KINDS])

        return let(placed, put)

    none = F.struct(text.alias("text"), *[F.lit(0).cast("long").alias(k) for k in KINDS])
    framed = F.concat(F.lit("\n"), text)
    values = F.transform(F.regexp_extract_all(framed, F.lit(VIEW), F.lit(1)), lambda view: replaced(key, view))
    found = docs.withColumn("_p", F.when(text.rlike("[0-9@]"), let(F.split(framed, STARTS), lambda parts: let(values, lambda vs: rewritten(parts, vs)))).otherwise(none))
    counts = {f"n_{k}": F.col(f"_p.{k}") for k in KINDS}
    return found.withColumns({"text": F.col("_p.text")} | counts).withColumn("n_pii", sum((F.col(c) for c in counts), F.lit(0).cast("long"))).drop("_p")
