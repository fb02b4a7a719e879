"""Format-preserving pseudonyms for personal data: keyed Feistel networks inside each format.

Found and validated: e-mail addresses, payment card numbers (13 to 19 digits, Luhn check digit),
telephone numbers with country code (also after 00) and those of three, three and four digits, IPv4
addresses (parts up to 255), IBANs (mod 97; of the countries in `IBAN_LENGTHS` also in groups), US social security numbers, and calendar dates from 1900 to 2099 (year-month-day with - or /, and day.month.year).

Each value is permuted within its format, so separators and lengths stay (but for the parts of an
address, which stay under 256), card numbers keep a right check digit, IBANs right check digits, and
dates are dates. A permutation depends on the key and the
format only: equal values get equal pseudonyms in every document, different values different ones,
and with the key the way back is open. Values that fail validation are left as they are.

Where a card in a usual grouping is followed by a short number, the longer number is taken if its
check digit is right and the card itself otherwise; the pseudonym is drawn again while it would make the longer number right.
Not found: dates in other forms (month/day/year, names of months, single digits), and other telephone
numbers without a country code.

Round functions are SHA-256 of key, format, round and the other half. Everything is a column
expression; a text is split at its findings and joined again, row by row, without a shuffle.

Defined cases: a null text stays null, an empty one empty. Numbers that touch letters or digits are
not taken. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CARD_STEPS = 16

# Characters in all, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBANS = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_GROUPED = r"(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})"
_SHORT = r"[ -][0-9]{1,3}"  # a number after a card that may also be its end

# The formats, in the order in which they are tried at a place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + _IBANS + r"|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\w])"
             r"|(?<![\w+.-])00[1-9][0-9]{0,2}[ -](?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\w-])"
             r"|(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![ -]?[\w-])",
    "card": r"(?<![\w-])(?:" + _GROUPED + "(?:" + _SHORT + r"(?![\w-]|[ ./:][0-9]))?(?![\w-])"
            r"|(?!(?:[0-9]{1,6}[ -]){1,2}" + _GROUPED + r"(?![\w-]))[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
DATE_DAYS = (17, 4297)  # 1900-01-01 to 2099-12-31 has 17 * 4297 days


def _draw(key: str, kind: str, turn: int, *known: Column) -> Column:
    """A number below 2^48 from the key and what is known."""
    text = F.concat_ws("|", F.lit(f"{key}|{kind}|{turn}"), *[k.cast("string") for k in known])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, kind: str, tweak: Column, back: bool) -> tuple[Column, Column]:
    """Permutes pairs (left below the first size, right below the second), half by half.

    Each round is bound in a lambda, so that a round's value is worked out once.
    """
    def turned(s: Column, turn: int) -> Column:
        if turn % 2:
            moved = _draw(key, kind, turn, tweak, s["l"])
            new = F.pmod(s["r"] - moved if back else s["r"] + moved, sizes[1])
            return F.struct(s["l"].alias("l"), new.alias("r"))
        moved = _draw(key, kind, turn, tweak, s["r"])
        new = F.pmod(s["l"] - moved if back else s["l"] + moved, sizes[0])
        return F.struct(new.alias("l"), s["r"].alias("r"))

    return _rounds(left, right, turned, back)


def _rounds(left: Column, right: Column, turned: Callable[[Column, int], Column], back: bool) -> tuple[Column, Column]:
    state = F.array(F.struct(left.alias("l"), right.alias("r")))
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        state = F.transform(state, partial(lambda t, s: turned(s, t), turn))
    return state[0]["l"], state[0]["r"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once and written once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits(value: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permutes a string of 1 to 36 digits among those of its length."""
    n = F.length(value)
    cut = F.floor(n / 2).cast("int")
    left, right = F.substring(value, F.lit(1), cut), F.substring(value, cut + 1, n)
    number = lambda x: F.when(F.length(x) == 0, F.lit(0).cast("long")).otherwise(x.cast("long"))
    l, r = _feistel(number(left), number(right), (_power(cut), _power(n - cut)), key, kind, n, back)
    return F.concat(F.when(cut > 0, F.lpad(l.cast("string"), cut, "0")).otherwise(""), F.lpad(r.cast("string"), n - cut, "0"))


def refill(shape: Column, new: Column, kind: str = "[0-9]") -> Column:
    """`shape` with its digits (or what `kind` matches) replaced by those of `new`, in order."""
    parts = F.split(shape, kind, -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(new), F.lit(1))),
        lambda i: F.concat(F.substring(new, i, F.lit(1)), F.coalesce(F.get(parts, i), F.lit("")))), ""))


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_digit(body: Column) -> Column:
    """Check digit that follows `body`."""
    figures = F.split(F.reverse(body), "")
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(-total, F.lit(10)).cast("string")


def _card_alone(value: Column, key: str, back: bool) -> Column:
    plain = _only_digits(value)
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    return _let(digits(body, key, "card", back), lambda new: _let(
        F.concat(new, _luhn_digit(new)), lambda whole: refill(value, whole)))


def _right(value: Column) -> Column:
    plain = _only_digits(value)
    return F.length(plain).between(13, 19) & (F.right(plain, F.lit(1)) == _luhn_digit(F.substring(plain, F.lit(1), F.length(plain) - 1)))


def _card(value: Column, key: str, back: bool) -> Column:
    """The whole number if its check digit is right, else the card before a short number at its end."""
    whole = _right(value)
    card = F.when(whole, value).otherwise(F.regexp_extract(value, f"^({_GROUPED}){_SHORT}$", 1))
    tail = F.substring(value, F.length(card) + 1, F.length(value))
    # Walks on while card and tail together would pass for one number; one step in ten does.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(CARD_STEPS)), F.struct(card.alias("card"), F.lit(True).alias("on")), lambda s, _: F.when(
        s["on"], F.transform(F.array(_card_alone(s["card"], key, back)), lambda c: F.struct(
            c.alias("card"), ((tail != "") & _right(F.concat(c, tail))).alias("on")))[0]).otherwise(s))["card"]
    # One walk serves both: with an empty tail it ends after the first step.
    return F.when(whole | ((card != "") & _right(card)), F.concat(walked, tail)).otherwise(value)


def _mod97(characters: Column) -> Column:
    """Letters count as 10 to 35."""
    return F.aggregate(F.split(characters, ""), F.lit(0), lambda a, d: F.when(
        d.between("A", "Z"), a * 100 + F.ascii(d) - 55).otherwise(a * 10 + d.cast("int")) % 97)


def _iban(value: Column, key: str, back: bool) -> Column:
    """Digits and letters of the account move each within their kind; blanks stay."""
    country, rest = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    figures, letters = _only_digits(rest), F.regexp_replace(rest, "[^A-Z]", "")
    shape = F.regexp_replace(F.regexp_replace(F.replace(rest, F.lit(" "), F.lit("")), "[A-Z]", "A"), "[0-9]", "9")
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = _mod97(F.concat(plain(rest), country, F.substring(value, 3, 2))) == 1
    checked = lambda new: F.concat(country, F.lpad((98 - _mod97(F.concat(plain(new), country, F.lit("00")))).cast("string"), 2, "0"), new)
    moved = _let(F.when(figures == "", "").otherwise(digits(figures, key, "iban", back)), lambda new: refill(rest, new))
    turned = _let(_moved_letters(letters, key, "iban", F.concat(country, shape), back), lambda new: _let(moved, lambda old: refill(old, new, "[A-Z]")))
    return F.when(valid, _let(F.when(letters == "", moved).otherwise(turned), checked)).otherwise(value)


def _ipv4(value: Column, key: str, back: bool) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    two = F.lit(65536).cast("long")
    l, r = _feistel((part[0] * 256 + part[1]).cast("long"), (part[2] * 256 + part[3]).cast("long"), (two, two), key, "ipv4", F.lit(""), back)
    join = F.concat_ws(".", *[x.cast("string") for h in (l, r) for x in (F.shiftright(h, 8), h % 256)])
    return F.when(F.array_max(part) <= 255, join).otherwise(value)


def _date(value: Column, key: str, back: bool) -> Column:
    dotted, mark = value.contains("."), F.substring(value, 5, 1)
    iso = F.when(dotted, F.regexp_replace(value, r"(..)\.(..)\.(....)", "$3-$2-$1")).otherwise(F.replace(value, F.lit("/"), F.lit("-")))
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")).cast("long")
    low, high = DATE_DAYS
    l, r = _feistel(F.floor(day / high), day % high, (F.lit(low).cast("long"), F.lit(high).cast("long")), key, "date", F.lit(""), back)
    new = F.date_add(F.lit("1900-01-01").cast("date"), (l * high + r).cast("int"))
    shown = F.when(dotted, F.date_format(new, "dd.MM.yyyy")).otherwise(F.concat_ws("", *[
        F.date_format(new, "yyyy"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "dd")]))
    return F.when((day >= 0) & (day < low * high), shown).otherwise(value)


def _moved_letters(local: Column, key: str, kind: str, domain: Column, back: bool) -> Column:
    """Letters and digits of `local` move within their own kind; `domain` is part of the key."""
    cut = F.ceil(F.length(local) / 2).cast("int")
    def moved(text: Column, other: Column, turn: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}|{turn}"), domain, other), 256)

        def shift(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(digest, (i * 2) % 64 + 1, F.lit(2)), 16, 10).cast("int") * (-1 if back else 1)
            code = F.ascii(c)
            for first, last in (("a", "z"), ("A", "Z"), ("0", "9")):
                yield F.when(c.between(first, last), F.char((F.pmod(code - ord(first) + by, F.lit(ord(last) - ord(first) + 1)) + ord(first)).cast("int")))

        letters = F.transform(F.split(text, ""), lambda c, i: F.coalesce(*shift(c, i), c))
        return F.when(F.length(text) > 0, F.array_join(letters, "")).otherwise("")

    def turned(s: Column, turn: int) -> Column:
        if turn % 2:
            return F.struct(s["l"].alias("l"), moved(s["r"], s["l"], turn).alias("r"))
        return F.struct(moved(s["l"], s["r"], turn).alias("l"), s["r"].alias("r"))

    left, right = _rounds(F.substring(local, F.lit(1), cut), F.substring(local, cut + 1, F.length(local)), turned, back)
    return F.concat(left, right)


def _email(value: Column, key: str, back: bool) -> Column:
    domain = F.substring_index(value, "@", -1)
    return F.concat(_moved_letters(F.substring_index(value, "@", 1), key, "email", F.lower(domain), back), F.lit("@"), domain)


def _phone(value: Column, key: str, back: bool) -> Column:
    """The country code (digits before the first separator) stays; the others are permuted."""
    head = F.regexp_extract(value, r"^(?:\+|00)[0-9]{1,3}(?=[ (-])|^\+[0-9]", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, refill(rest, digits(_only_digits(rest), key, "phone", back)))


def _ssn(value: Column, key: str, back: bool) -> Column:
    return refill(value, digits(_only_digits(value), key, "ssn", back))


HANDLERS: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


def findings(text: Column | str) -> Column:
    """Texts that have one of the formats, in order. Every format has a digit or an @, so other texts are not searched."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))).when(
        text.isNotNull(), F.array().cast("array<string>"))


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The value's pseudonym (or with `back` its original)."""
    out = value
    for kind in reversed(FORMATS):
        out = F.when(value.rlike(f"^(?:{FORMATS[kind]})$"), HANDLERS[kind](value, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """`docs` with `text` rewritten; other columns as they are."""
    text = F.col("text")
    found = findings(text)
    between = F.split(text, PATTERN, -1)
    mapped = F.transform(found, lambda v: pseudonym(v, key, back))
    joined = F.array_join(F.flatten(F.zip_with(between, mapped, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    new = F.when(F.size(found) == 0, text).otherwise(joined)
    return docs.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
