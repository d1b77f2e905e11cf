"""Format-preserving pseudonyms for personal data, with built-in functions only.

A value that a detector finds and its check confirms becomes a vector of positions, each with a radix: a
digit has 10, a letter as many as its alphabet, an IPv4 byte 256, a date two positions with 189 x 773 = 146,097 days, one whole
Gregorian cycle. A keyed Feistel network over that vector adds to one half, position by position and modulo
the radix, a SHA-256 digest of the other half, and so permutes exactly the values of that format. Check
digits are computed anew, so a valid card number or IBAN maps to a valid one, one to one. Equal values get
equal pseudonyms in all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

ROUNDS = 5

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: kind -> pattern of the whole value. Earlier kinds win where two begin at one place.
DETECTORS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}0-9-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    # What follows a word for a secret: hexadecimal digits, or anything with a digit in it up to a blank, quote, comma or bracket.
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[ ]?[=:][ ]?[\"']?)"
    r"(?:(?i:[0-9a-f]{16,})(?![0-9A-Za-z])|(?=[^\x00-\x20\"',;<>]*[0-9])[^\x00-\x20\"',;<>]{6,})",
    # Forms that name themselves.
    "token": r"(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|sk-(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}"
    r"|xox[baprs]-(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}.-])(?:[12][0-9]{3}-[01][0-9]-[0-3][0-9]|(?:[0-3][0-9]/[01][0-9]|[01][0-9]/[0-3][0-9])/[12][0-9]{3}|[0-3][0-9]\.[01][0-9]\.[12][0-9]{3})(?![\p{L}\p{N}-])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    # Three groups as in America; with a country's number after + or 00 groups of two to five, 8 to 15 digits in all; pairs after 0 and a digit; an area with 0 and one long number.
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|\+(?=(?:[ .()/-]{0,2}[0-9]){8,15}(?![ .-]?[0-9]))[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,5})(?:[ ./-]?[0-9]{2,5}){1,6}"
    r"|00(?=(?:[ ./-]?[0-9]){7,13}(?![ ./-]?[0-9]))[1-9][0-9]{0,2}[ ./-][0-9]{1,5}(?:[ ./-][0-9]{2,8}){1,6}"
    r"|0[0-9](?:[ .-][0-9]{2}){4}"
    r"|\(?0[0-9]{2,4}\)?[ /-][0-9]{5,8})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}])(?<![0-9]\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}])(?!\.[0-9])",
    # Eight groups, or fewer around ::, three digits of one group at least.
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]*[0-9])(?=[0-9a-fA-F:]*[0-9a-fA-F]{3})(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?)(?![\p{L}\p{N}:])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:\.[0-9]{4}){3})(?![\p{L}\p{N}])",
}
ANY = "|".join(DETECTORS.values())

#: First and last code point of alphabets without gaps. A letter becomes one of its own alphabet.
ALPHABETS = (
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x400, 0x40F),
    (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x904, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, _long(0), lambda a, x: a + x)


def feistel(values: Column, radixes: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the vectors with 0 <= values[i] < radixes[i]; both are arrays of longs."""

    def mixed(half: Column, radix: Column, other: Column, turn: Column) -> Column:
        said = F.concat_ws(",", F.lit(key), F.lit(tag), turn.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), "."))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(half) - 1) / 8).cast("int")), lambda b: F.sha2(F.concat_ws("/", said, b.cast("string")), 256))

        def add(digest: Column) -> Column:
            drawn = lambda i: F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
            return F.transform(half, lambda x, i: F.pmod(x + drawn(i), F.get(radix, i)))

        return F.when(F.size(half) == 0, half).otherwise(let(F.array_join(blocks, ""), add))

    def run(v: Column) -> Column:
        n = F.size(v)

        def halves(cut: Column) -> Column:
            a, b = F.slice(v, F.lit(1), cut), F.slice(v, cut + 1, n - cut)
            ra, rb = F.slice(radixes, F.lit(1), cut), F.slice(radixes, cut + 1, n - cut)

            def with_radixes(r: Column) -> Column:
                def turn(acc: Column, i: Column) -> Column:
                    return let(mixed(acc["a"], r["a"], acc["b"], i * 2), lambda left: F.struct(left.alias("a"), mixed(acc["b"], r["b"], left, i * 2 + 1).alias("b")))

                done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), turn)
                return let(done, lambda d: F.concat(d["a"], d["b"]))

            return let(F.struct(ra.alias("a"), rb.alias("b")), with_radixes)

        return let(F.floor(n / 2).cast("int"), halves)

    return let(values, run)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _alnum(s: Column, key: str, tag: str, hexadecimal: bool = False) -> Column:
    """Permutes digits and letters within their alphabets, or hexadecimal digits within theirs; the rest stays.

    A letter or digit of no alphabet listed becomes one of a to z, which is keyed too but not one to one. What parts groups
    doesn't matter: a number with and without spaces gets the same new digits.
    """
    movable = "[0-9a-fA-F]" if hexadecimal else r"[\p{L}\p{N}]"

    def by_alphabet(code: Column, of: Callable[[int, int], Column], other: Column) -> Column:
        found = None
        for first, last in ALPHABETS:
            test = code.between(first, last)
            found = F.when(test, of(first, last)) if found is None else found.when(test, of(first, last))
        return found.otherwise(other)

    def kind(c: Column) -> tuple[Column, Column]:
        if hexadecimal:
            return F.conv(c, 16, 10).cast("long"), _long(16)
        code = F.ascii(c).cast("long")
        return by_alphabet(code, lambda first, _: code - first, F.pmod(code, _long(26))), by_alphabet(code, lambda first, last: _long(last - first + 1), _long(26))

    def shown(c: Column, v: Column) -> Column:
        if hexadecimal:
            return F.when(c.rlike("[A-F]"), F.upper(F.conv(v.cast("string"), 10, 16))).otherwise(F.lower(F.conv(v.cast("string"), 10, 16)))
        code = by_alphabet(F.ascii(c).cast("long"), lambda first, _: v + first, v + 0x61)
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def permuted(moved: Column) -> Column:
        new = feistel(F.transform(moved, lambda c: kind(c)[0]), F.transform(moved, lambda c: kind(c)[1]), key, tag)

        def merged(n: Column) -> Column:
            place = lambda i: F.char_length(F.regexp_replace(F.substr(s, F.lit(1), i), movable.replace("[", "[^", 1), ""))
            put = F.transform(_chars(s), lambda c, i: F.when(c.rlike(movable), shown(c, F.get(n, place(i + 1) - 1))).otherwise(c))
            return F.array_join(put, "")

        return F.when(F.size(moved) == 0, s).otherwise(let(new, merged))

    return let(F.filter(_chars(s), lambda c: c.rlike(movable)), permuted)


def _digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def summed(d: Column) -> Column:
        doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return _sum(F.transform(d, lambda x, i: F.when((F.size(d) - 1 - i) % 2 == 1, doubled(x)).otherwise(x)))

    return let(F.transform(_chars(digits), lambda c: c.cast("long")), summed)


def _card(s: Column, key: str) -> Column:
    digits = _digits_only(s)
    first = F.substr(digits, F.lit(1), F.lit(1))

    def checked(body: Column) -> Column:
        number = F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, _long(10)).cast("string"))
        grouped = lambda n: F.array_join(
            F.transform(_chars(s), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(n, F.char_length(_digits_only(F.substr(s, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""
        )
        return let(number, grouped)

    inner = F.substr(digits, F.lit(2), F.char_length(digits) - 2)
    return F.when(_luhn(digits) % 10 == 0, let(F.concat(first, _alnum(inner, key, "card")), checked))


def _mod97(s: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")
    return F.aggregate(_chars(s), _long(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), _long(10)).otherwise(_long(100)) + value(c)) % 97)


def _iban(s: Column, key: str) -> Column:
    country = F.substr(s, F.lit(1), F.lit(2))
    rest = F.substr(s, F.lit(5))
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = _mod97(plain(F.concat(rest, F.substr(s, F.lit(1), F.lit(4))))) == 1
    new = lambda body: F.concat(country, F.lpad((98 - _mod97(F.concat(plain(body), country, F.lit("00")))).cast("string"), 2, "0"), body)
    return F.when(valid, let(_alnum(rest, key, "iban"), new))


def _phone(s: Column, key: str) -> Column:
    country = F.regexp_extract(s, r"^(?:\+[0-9]{1,3}(?=[ .(-])|00[1-9][0-9]{0,2}(?=[ ./-]))", 0)
    return F.concat(country, _alnum(F.substr(s, F.char_length(country) + 1), key, "phone"))


def _email(s: Column, key: str) -> Column:
    """A new name, and a new domain below the same top level: domains name people too."""
    domain = F.substring_index(s, "@", -1)
    top = F.substring_index(domain, ".", -1)
    own = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(top) - 1)
    return F.concat(_alnum(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), _alnum(own, key, "domain"), F.lit("."), top)


#: A long secret is permuted in parts of so many characters.
SECRET_PART = 128


def _opaque(value: Column, key: str) -> Column:
    """Hexadecimal digits as such, anything else by its letters and digits, part by part."""
    parts = lambda hexadecimal: F.array_join(F.transform(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{SECRET_PART}}}"), F.lit(0)), lambda p: _alnum(p, key, "secret", hexadecimal)), "")
    return F.when(value.rlike("^[0-9a-fA-F]{16,}$"), parts(True)).otherwise(parts(False))


def _after(s: Column, before: str, key: str) -> Column:
    return let(F.regexp_extract(s, before, 0), lambda kept: F.concat(kept, let(F.substr(s, F.char_length(kept) + 1), lambda value: _opaque(value, key))))


def _secret(s: Column, key: str) -> Column:
    return _after(s, "^[^=:]*[=:][ ]?[\"']?", key)


def _token(s: Column, key: str) -> Column:
    return _after(s, "^(?:AKIA|ASIA|sk-|gh[pousr]_|xox[baprs]-|eyJ)", key)


def _ipv6(s: Column, key: str) -> Column:
    return _alnum(s, key, "ipv6", hexadecimal=True)


def _ip(s: Column, key: str) -> Column:
    parts = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    return F.array_join(F.transform(feistel(parts, F.array(*[_long(256)] * 4), key, "ip"), lambda x: x.cast("string")), ".")


def _ssn(s: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    parts = F.transform(F.split(s, "-"), lambda x: x.cast("long"))

    def new(p: Column) -> Column:
        valid = (p[0] > 0) & (p[0] < 900) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        v = F.array(p[0] - F.when(p[0] > 666, _long(2)).otherwise(_long(1)), p[1] - 1, p[2] - 1)
        shown = lambda n: F.concat_ws(
            "-", F.lpad((n[0] + F.when(n[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((n[1] + 1).cast("string"), 2, "0"), F.lpad((n[2] + 1).cast("string"), 4, "0")
        )
        return F.when(valid, let(feistel(v, F.array(_long(898), _long(99), _long(9999)), key, "ssn"), shown))

    return let(parts, new)


def _date(s: Column, key: str) -> Column:
    """Days of 1800 to 2199, shown as they were: year first, or day first with dots or slashes, or month first where only that is a day."""
    part = lambda at, n: F.substr(s, F.lit(at), F.lit(n))
    start = F.make_date(F.lit(1800), F.lit(1), F.lit(1))
    first = F.when(s.rlike("^[0-9]{4}-"), s).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
    month_first = F.when(s.contains("/"), F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))

    def of_days(days: Column) -> Column:
        day = F.coalesce(days["day"], days["american"])
        pattern = F.when(s.rlike("^[0-9]{4}-"), F.lit("yyyy-MM-dd")).when(s.contains("."), F.lit("dd.MM.yyyy")).when(days["day"].isNull(), F.lit("MM/dd/yyyy")).otherwise(F.lit("dd/MM/yyyy"))

        def shown(n: Column) -> Column:
            return F.call_function("date_format", F.date_add(start, (n[0] * 773 + n[1]).cast("int")), pattern)

        inside = day.isNotNull() & (day >= 0) & (day < 146_097)
        v = F.array(F.floor(day / 773).cast("long"), day % 773)
        return F.when(inside, let(feistel(v, F.array(_long(189), _long(773)), key, "date"), shown))

    since = lambda iso: F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), start).cast("long")
    return let(F.struct(since(first).alias("day"), since(month_first).alias("american")), of_days)


#: Each kind's pseudonym; null for what its check refuses.
_NEW: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "token": _token, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "ipv6": _ipv6, "card": _card,
}


def pseudonyms(text: Column, key: str) -> Column:
    """The text with pseudonyms, and what was replaced: a struct of text and found, an array of (kind, pseudonym)."""

    def each(m: Column) -> Column:
        kind = None
        for k, pattern in DETECTORS.items():
            kind = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(k)) if kind is None else kind.when(m.rlike(f"^(?:{pattern})$"), F.lit(k))

        def replaced(k: Column) -> Column:
            new = None
            for name, f in _NEW.items():
                new = F.when(k == name, f(m, key)) if new is None else new.when(k == name, f(m, key))
            return let(new, lambda n: F.struct(F.when(n.isNotNull(), k).alias("kind"), F.coalesce(n, m).alias("pseudonym")))

        return let(kind, replaced)

    def woven(found: Column) -> Column:
        between = F.split(text, ANY, -1)
        whole = F.zip_with(between, found, lambda t, f: F.concat(t, F.coalesce(f["pseudonym"], F.lit(""))))
        return F.struct(F.array_join(whole, "").alias("text"), F.filter(found, lambda f: f["kind"].isNotNull()).alias("found"))

    nothing = F.struct(text.alias("text"), F.array().cast("array<struct<kind:string,pseudonym:string>>").alias("found"))
    return F.when(text.rlike("[0-9@=:]"), let(F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), each), woven)).otherwise(nothing)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with pseudonyms in text and the column pii, an array of (kind, pseudonym) in the order of the text.

    A null text stays null with an empty pii; an empty one stays empty; a text of any length is read whole. All other
    columns stay, but one that is already named pii is replaced. A value that its permutation maps to itself counts. Numbers that fail their check digits and dates that no calendar has stay.
    Repeated rows and equal values get equal pseudonyms; an empty table stays empty.
    """
    helper = unused("_pii", docs)
    new = docs.withColumn(helper, pseudonyms(F.col("text"), key))
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return new.withColumns({"text": F.col(f"{helper}.text"), "pii": F.coalesce(F.col(f"{helper}.found"), empty)}).drop(helper)
