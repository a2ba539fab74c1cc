"""Operator 9: format-preserving pseudonyms for personal data. DataFrame functions only; no shuffle.

Numbers and dates that prove valid (cards by Luhn, IBANs by their check digits, calendar dates, IPv4 addresses, phone and social
security numbers by their form) are permuted within their format by a keyed Feistel network: digits become other digits, separators stay,
check digits are made right again. A permutation maps equal values to equal pseudonyms in all documents and different ones to
different ones. The local part of an e-mail address, and secrets after token, password and the like, have no such domain: each character
is replaced within its class by a keyed hash of the whole value, which links equal values too. Numbers that are not valid stay.

Kinds are sought in turn (PASSES). Of a match that takes in what follows, the longest valid part up to a separator counts (an IBAN of its
country's length before others, and alone in lower case); what is not replaced is text again, in which later kinds are sought. Runs of digits are tried from each of
their groups; a part of a run has three digits a group on average at least, as most rows of short numbers hold a valid card by chance.

Defined results: null text stays null, a text without such data stays as it is, a text of any length is searched whole. All rows, repeated ones too, and columns are
carried, whatever their names; equal values get equal pseudonyms wherever they stand. An empty table gives no rows. Of two kinds that fit at one place the first of PASSES counts.
A phone number keeps its country's code and leading zeros, and is linked with itself written without the code or with a trunk zero.
Dates from 1600 to 2399 are permuted among themselves; others stay. dd/mm/yyyy comes before mm/dd/yyyy; dates that are only the latter
(days beyond 12) are permuted among themselves.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_CONF = "spark.brindle.pseudonym.key"  # of the session; never part of the code
ROUNDS = 8
_OWN: dict[str, str] = {}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: kind: pattern
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9_])(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\s?[=:]\s?[\x22']?[A-Za-z0-9+/_-]{12,}|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_])gh[pousr]_(?=[A-Za-z]*[0-9])[A-Za-z0-9]{20,}|(?<![A-Za-z0-9_])(?i:bearer)\s(?=[A-Za-z+/_.~-]*[0-9])[A-Za-z0-9+/_.~-]{16,}",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "iso_date": r"(?<![0-9/-])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?![0-9/-])",
    "day_first": r"(?<![0-9./-])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.|-[0-9]{2}-)[0-9]{4}(?![0-9/-])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.vV])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
    "national": r"(?<![0-9A-Za-z+])\(0?[1-9][0-9]{1,3}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z.+/-])(?<![0-9] )(?:[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8})(?![0-9/]|[ .-][0-9])",
    "card_form": r"(?<![0-9.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "card": r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,}+(?![0-9])",
}
#: kinds sought together, of which the first that fits counts
PASSES = (("email", "secret"), ("iban",), ("iso_date", "day_first", "ssn", "ip"), ("card_form",), ("phone", "national"), ("card",))
#: characters of a country's IBAN
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
#: Country codes of one and of two digits; all others have three.
ONE_DIGIT_CODES = "^[17]"
TWO_DIGIT_CODES = "^(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NORTH_AMERICAN = "^[2-9][0-9]{2}[2-9][0-9]{6}$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_FIRST_DAY, _DAYS = "1600-01-01", 292194  # to 2399-12-31


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def luhn_digit(body: Column) -> Column:
    """The check digit that belongs behind a string of digits."""
    return _let(body, _luhn_digit)


def _luhn_digit(body: Column) -> Column:
    n = F.length(body)
    doubled = lambda i: body.substr(n - i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.floor(doubled(i) / 10).cast("int") + doubled(i) % 10)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """Of digits and letters (A = 10)."""
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def feistel(key: str, tag: Column, x: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of 0 .. a b - 1: halves of radix a and b are added keyed hashes of each other in turn."""
    noise = lambda i, v: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, i, v), 256), 1, 15), 16, 10).cast("long")
    turn = lambda s, i: F.when(i % 2 == 0, F.struct((F.pmod(s["l"] + F.pmod(noise(i, s["r"]), a), a)).alias("l"), s["r"].alias("r"))).otherwise(
        F.struct(s["l"].alias("l"), (F.pmod(s["r"] + F.pmod(noise(i, s["l"]), b), b)).alias("r")))
    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _permuted(key: str, tag: str, digits: Column) -> Column:
    """Digits, at most 18, as other digits."""
    n = F.length(digits)
    a, b = _power(F.ceil(n / 2)), _power(F.floor(n / 2))
    return F.lpad(feistel(key, F.concat_ws(":", F.lit(tag), n), digits.cast("long"), a, b).cast("string"), n, "0")


def _refilled(form: Column, digits: Column) -> Column:
    """form, with its digits replaced in turn."""
    return _let(digits, lambda d: _refilled_with(form, d))


def _refilled_with(form: Column, digits: Column) -> Column:
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    nth = lambda i: F.length(_digits(form.substr(F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), digits.substr(nth(i), F.lit(1))).otherwise(c)), "")


def _scrambled(key: str, tag: str, value: Column, whole: Column) -> Column:
    """Each letter and digit of value replaced within its class by a hash of whole."""
    noise = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"{tag}{k}"), whole), 256) for k in range(2)])
    of = lambda first, i, n, noise: F.chr(F.lit(ord(first)) + F.conv(F.substr(noise, 1 + 2 * (i % 64), F.lit(2)), 16, 10).cast("int") % n)
    swap = lambda c, i, x: F.when(c.between("0", "9"), of("0", i, 10, x)).when(c.rlike("^[a-z]$"), of("a", i, 26, x)).when(c.rlike("^[A-Z]$"), of("A", i, 26, x)).otherwise(c)
    return _let(noise, lambda noise: F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, i: swap(c, i, noise)), ""))


def _kind(m: Column, kinds: tuple[str, ...]) -> Column:
    """The first of kinds whose pattern the whole of a match fits."""
    out = F.lit(None).cast("string")
    for kind in reversed(kinds):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _month_first(m: Column, key: str) -> Column:
    """mm/dd/yyyy, days beyond 12, permuted among themselves."""
    return F.when(m.substr(4, 2).cast("int") > 12, F.aggregate(F.sequence(F.lit(0), F.lit(63)), _date(m, "MM/dd/yyyy", key), lambda v, _: F.when(
        (v == m) | (v.substr(4, 2).cast("int") > 12), v).otherwise(_date(v, "MM/dd/yyyy", key)))).otherwise(m)


def _date(m: Column, form: str, key: str) -> Column:
    day = F.try_to_date(m, form)
    x = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    once = lambda v: feistel(key, F.lit("date"), v, F.lit(541).cast("long"), F.lit(541).cast("long"))
    # 541 * 541 is a little more than the number of days: what falls outside is permuted again until it falls inside.
    y = F.aggregate(F.sequence(F.lit(0), F.lit(15)), once(x), lambda v, _: F.when(v < _DAYS, v).otherwise(once(v)))
    valid = x.between(0, _DAYS - 1) & (F.date_format(day, form) == m)
    return F.when(F.coalesce(valid, F.lit(False)), F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), y.cast("int")), form)).otherwise(m)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    use = lambda body: _refilled(m, _let(_permuted(key, "card", body), lambda new: F.concat(new, luhn_digit(new))))
    return _let(d.substr(F.lit(1), n - 1), use)


def _subscriber(d: Column, key: str) -> Column:
    """The digits of a number behind its country's code: leading zeros stay, and what follows is permuted among numbers of its length that begin with no zero and,
    of ten digits, fit North America's plan or do not, as it does. What falls outside is permuted again until it falls inside."""
    zeros = F.length(d) - F.length(F.ltrim(d, F.lit("0")))
    plan = lambda x: x.rlike(NORTH_AMERICAN)

    def walked(body: Column) -> Column:
        good = lambda v: ~v.startswith("0") & (plan(v) == plan(body))
        once = lambda v: _permuted(key, "phone", v)
        return F.aggregate(F.sequence(F.lit(0), F.lit(127)), once(body), lambda v, _: F.when(good(v), v).otherwise(once(v)))

    return _let(zeros, lambda z: F.when(z == F.length(d), d).otherwise(F.concat(F.repeat(F.lit("0"), z), _let(d.substr(z + 1, F.length(d)), walked))))


def _phone(m: Column, key: str) -> Column:
    """The country's code stays; it follows from the digits alone, so spellings of a number stay linked, with its national ones too."""
    d = _digits(m)
    n = F.length(d)
    country = F.when(d.rlike(ONE_DIGIT_CODES), 1).when(d.rlike(TWO_DIGIT_CODES), 2).otherwise(3)
    return _let(F.greatest(country, n - 18), lambda c: _refilled(m, F.concat(d.substr(F.lit(1), c), _let(d.substr(c + 1, n), lambda s: _subscriber(s, key)))))


def _national(m: Column, key: str) -> Column:
    return _refilled(m, _let(_digits(m), lambda d: _subscriber(d, key)))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    side = F.lit(65536).cast("long")
    address = feistel(key, F.lit("ip"), F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o), side, side)
    octet = lambda x, s: F.call_function("shiftright", x, F.lit(s)).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return _let(address, lambda x: F.concat_ws(".", *[octet(x, s) for s in (24, 16, 8, 0)]))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    check = lambda x: F.lpad((98 - _mod97(F.upper(F.concat(x, F.substring(plain, 1, 2), F.lit("00"))))).cast("string"), 2, "0")
    respaced = lambda fresh: F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c, i: F.when(c == " ", c).otherwise(
        fresh.substr(F.length(F.regexp_replace(m.substr(F.lit(1), i + 1), " ", "")), F.lit(1)))), "")

    def moved(account: Column) -> Column:
        ad = _digits(account)
        tail = F.greatest(F.length(ad) - 18, F.lit(0))
        return _refilled(account, F.concat(ad.substr(F.lit(1), tail), _permuted(key, "iban", ad.substr(tail + 1, F.length(ad)))))

    spaced = lambda: _let(_let(_let(plain.substr(F.lit(5), F.length(plain)), moved), lambda x: F.concat(F.substring(plain, 1, 2), check(x), x)), respaced)
    return F.when(F.substring(plain, 5, 99).rlike("[0-9]"), spaced()).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    return F.concat(_scrambled(key, "email", local, F.lower(m)), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(AKIA|gh[pousr]_|(?i:bearer)\s|[A-Za-z_-]+\s?[=:]\s?[\x22']?)", 1)
    return _let(name, lambda name: _let(m.substr(F.length(name) + 1, F.length(m)), lambda value: F.concat(name, _scrambled(key, "secret", value, value))))


def _ssn(m: Column, key: str) -> Column:
    """Numbers of valid form among themselves: what falls outside is permuted again until it falls inside."""
    once = lambda d: _permuted(key, "ssn", d)
    valid = lambda d: d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    return _refilled(m, F.aggregate(F.sequence(F.lit(0), F.lit(63)), once(_digits(m)), lambda v, _: F.when(valid(v), v).otherwise(once(v))))


def _day_first(m: Column, key: str) -> Column:
    return F.when(m.contains("."), _date(m, "dd.MM.yyyy", key)).when(m.contains("-"), _date(m, "dd-MM-yyyy", key)).when(m.substr(4, 2) > "12", _month_first(m, key)).otherwise(_date(m, "dd/MM/yyyy", key))


#: what stands for a valid value of a kind; a date that is none stays
PSEUDONYMS = {
    "email": _email, "secret": _secret, "iban": _iban, "iso_date": lambda m, key: F.when(m.contains("/"), _date(m, "yyyy/MM/dd", key)).otherwise(_date(m, "yyyy-MM-dd", key)), "day_first": _day_first,
    "ssn": _ssn, "ip": _ip, "phone": _phone, "national": _national,
    "card_form": _card, "card": _card,
}


def _pseudonym(m: Column, kind: Column, kinds: tuple[str, ...], key: str) -> Column:
    out = m
    for k in kinds:
        out = F.when(kind == k, PSEUDONYMS[k](m, key)).otherwise(out)
    return out


def _piece(text: Column, new: Column | None = None) -> Column:
    return F.struct(text.alias("s"), (F.lit(None).cast("string") if new is None else new).alias("new"))


def _is_card(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    return F.when(n.between(13, 19), luhn_digit(d.substr(F.lit(1), n - 1)) == d.substr(n, F.lit(1))).otherwise(False)


def _is_iban(m: Column) -> Column:
    plain = F.upper(F.regexp_replace(m, " ", ""))
    n = F.length(plain)
    return F.when(n.between(12, 35), _mod97(F.concat(plain.substr(F.lit(5), n), plain.substr(1, 4))) == 1).otherwise(False)


def _start(m: Column, kind: str, key: str) -> Column:
    """The longest valid part from the start of a match to the end of one of its groups, and what is left."""
    if kind == "iban":
        groups, ok = r" ?[A-Za-z0-9]+", _is_iban
    else:
        groups, ok = r"[^0-9]*[0-9]+", _is_card if kind == "card_form" else lambda x: F.length(_digits(x)).between(8, 15)
    parts = F.regexp_extract_all(m, F.lit(groups), F.lit(0))
    fit = F.filter(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda j: F.array_join(F.slice(parts, F.lit(1), j), "")), ok)
    if kind == "iban":
        lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
        exact = F.filter(fit, lambda x: F.length(F.regexp_replace(x, " ", "")) == F.try_element_at(lengths, F.upper(m.substr(1, 2))))
        best = F.coalesce(F.get(exact, F.lit(0)), F.when(m.rlike("^[A-Z]"), F.get(fit, F.lit(0))))
    else:
        best = F.get(fit, F.lit(0))
    return _let(best, lambda x: F.when(x.isNull(), F.array(_piece(m))).otherwise(
        F.array(_piece(x, PSEUDONYMS[kind](x, key)), _piece(m.substr(F.length(x) + 1, F.length(m))))))


def _run(m: Column, key: str) -> Column:
    """A run of digits: all of it if valid, else the cards in it, each from the first group that begins one to the last that ends it."""
    parts = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))

    def within(parts: Column) -> Column:
        n = F.size(parts)
        part = lambda i, j: F.array_join(F.slice(parts, i + 1, j - i), "")
        fits = lambda i, j: _let(part(i, j), lambda x: (F.length(_digits(x)) >= 3 * (j - i)) & _is_card(x))
        end = lambda i: F.get(F.filter(F.sequence(F.least(i + 6, n), i + 1, F.lit(-1)), lambda j: fits(i, j)), F.lit(0))
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))
        add = lambda a, i, j: F.struct(F.coalesce(j, i + 1).alias("next"), F.concat(a["out"], F.array(F.struct(i.alias("i"), j.alias("j")))).alias("out"))
        cut = F.aggregate(F.sequence(F.lit(0), n - 1), start, lambda a, i: F.when(i < a["next"], a).otherwise(_let(end(i), lambda j: add(a, i, j))), lambda a: a["out"])
        return F.transform(cut, lambda x: F.when(x["j"].isNull(), _piece(F.get(parts, x["i"]))).otherwise(_let(part(x["i"], x["j"]), lambda v: _piece(v, _card(v, key)))))

    return F.when(_is_card(m), F.array(_piece(m, _card(m, key)))).otherwise(_let(parts, within))


def _searched(text: Column, kinds: tuple[str, ...], key: str) -> Column:
    """Pieces of a text: values with their pseudonyms, and what lies between."""
    pattern = F.lit("|".join(f"(?:{PATTERNS[k]})" for k in kinds))

    def one(m: Column) -> Column:
        if kinds == ("card",):
            return _run(m, key)
        if kinds in (("iban",), ("card_form",)):
            return _start(m, kinds[0], key)
        rest = tuple(k for k in kinds if k != "phone")
        new = _let(_kind(m, rest), lambda kind: _pseudonym(m, kind, rest, key))
        found = _let(new, lambda new: F.array(_piece(m, F.when(new != m, new))))
        return F.when(m.startswith("+"), _start(m, "phone", key)).otherwise(found) if "phone" in kinds else found

    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), one)
    between = F.transform(F.split(text, pattern, -1), lambda p: F.array(_piece(p)))
    pieces = F.flatten(F.zip_with(between, found, lambda p, f: F.concat(p, F.coalesce(f, F.array().cast("array<struct<s:string,new:string>>")))))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<s:string,new:string>>").alias("out"))
    return F.aggregate(pieces, start, lambda a, p: F.when(p["new"].isNull(), F.struct(F.concat(a["text"], p["s"]).alias("text"), a["out"].alias("out"))).otherwise(
        F.struct(F.lit("").alias("text"), F.concat(a["out"], F.array(_piece(a["text"]), p)).alias("out"))), lambda a: F.concat(a["out"], F.array(_piece(a["text"]))))


def session_key(spark: SparkSession) -> str:
    """The key that the session's configuration holds. Without one, a random key of this application: pseudonyms then agree within it alone and
    nobody can reverse them."""
    known = spark.conf.get(KEY_CONF, None) or spark.sparkContext.getConf().get(KEY_CONF)
    app = spark.sparkContext.applicationId
    return known or _OWN.setdefault(app, secrets.token_hex(32))


def pseudonymized(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of docs as __row (a struct), with __text, its text with pseudonyms, and __n, how many were put in. key: a secret; without it
    that of the session."""
    key = key or session_key(docs.sparkSession)
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    t = F.col(f"__row.{text}")
    some = t.rlike("[0-9@=:]|AKIA") & t.rlike(ANY)  # each pattern needs one of the former
    df = df.withColumn("__found", F.when(some, F.array(_piece(t))))
    for kinds in PASSES:
        pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
        search = lambda p: F.when(p["new"].isNull() & p["s"].rlike(pattern), _searched(p["s"], kinds, key)).otherwise(F.array(p))  # noqa: B023, E731
        df = df.withColumn("__found", F.flatten(F.transform("__found", search)))
    joined = F.array_join(F.transform("__found", lambda p: F.coalesce(p["new"], p["s"])), "")
    changed = F.size(F.filter("__found", lambda p: p["new"] != p["s"]))
    return df.select("__row", F.when(F.col("__found").isNull(), t).otherwise(joined).alias("__text"), F.when(F.col("__found").isNull(), 0).otherwise(changed).cast("long").alias("__n"))
