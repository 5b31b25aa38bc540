"""Personal data under format-preserving pseudonyms, in DataFrame functions only.

One regular expression finds candidates; a candidate counts once it is valid: card numbers and IBANs by their check digits,
network addresses by their parts, dates by the calendar, social numbers by their areas. The digits of a valid value go
through a keyed Feistel network, again and again until they are valid as the value was (cycle walking), so the pseudonym
is valid too, no two values share one, and equal values get equal pseudonyms in all documents, whatever punctuation they
are written with; dates that can only be read month first (12/31/1999) are permuted among themselves, so that their
pseudonyms can be read that way too, and telephone numbers whose area and exchange can be dialled among themselves. E-mail
addresses, which have no numeric format, become keyed digests. Each document is handled by itself; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates from FIRST_DAY on, DAYS of them (to 2099-12-31), are permuted among each other.
FIRST_DAY = "1900-01-01"
DAYS = 73_049

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
#: With a country code and groups of at most 15 digits together, or ten digits in the groups 3-3-4; PHONE's first form leaves digits after it alone.
PHONE = (
    r"(?:(?:\+[0-9]{1,3}[ .-]?|(?<![0-9A-Za-z])(?=\())\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|\+[1-9](?:[0-9]{7,14}|[0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9]{1,4})"
    r"(?:(?:[ .-]?[0-9]{2}){3,4}(?![0-9])|(?:[ .-]?[0-9]{3,4}){2}(?![0-9])|[ .-]?[0-9]{2,3}[ .-]?[0-9]{3,5}(?![0-9])|[ .-]?[0-9]{5,8}))(?![0-9])"
    r"|(?<![0-9A-Za-z.+-])(?:1[ .-])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9A-Za-z]|[.-][0-9]))"
)
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5})(?![0-9A-Za-z])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
#: A time of day may follow a date.
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?=T[0-9]{2}:[0-9]{2}|(?![0-9A-Za-z/-]))"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2}(?: [0-9]{4}){0,5}(?: [0-9]{1,4})?)(?![0-9A-Za-z])"
#: All eight groups, or :: with three groups or more.
ADDRESS_6 = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=(?:[0-9A-Fa-f]*:)?(?::?[0-9A-Fa-f]{1,4}){3})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:]|\.[0-9])"
)
#: A candidate's first characters are tested first, so that other characters cost few comparisons.
NUMBERS = "(?=[0-9+(]|[A-Z]{2}[0-9]{2}|[A-Fa-f][0-9A-Fa-f]{0,3}:)(?:" + "|".join((ADDRESS_6, PHONE, DATE, SOCIAL, CARD, ADDRESS, IBAN)) + ")"
#: For the texts that have an "@".
PATTERN = EMAIL + "|" + NUMBERS
KINDS = ("email", "phone", "date", "social", "card", "address", "iban")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(key: str, tweak: Column, turn: Column, half: Column) -> Column:
    """60 bits of a digest that is keyed at both ends."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half.cast("string"), F.lit(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of pairs below (left_size, right_size), as struct a, b. Sizes are at most 10 ** 10."""

    def turn(state: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        return F.struct(state["b"].alias("a"), ((state["a"] + _round(key, tweak, i, state["b"])) % size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of each length, 2 to 20."""

    def permuted(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        mixed = feistel(d.substr(F.lit(1), u), d.substr(u + 1, n - u), _power(u), _power(n - u), key, F.concat(F.lit(kind), n.cast("string")))
        return _let(mixed, lambda m: F.concat(F.lpad(m["a"].cast("string"), u, "0"), F.lpad(m["b"].cast("string"), n - u, "0")))

    return _let(digits, permuted)


def _walk(digits: Column, key: str, kind: str, good: Callable[[Column], Column]) -> Column:
    """Permute digits until what comes out is good as often as what went in: a permutation of the good ones, and of the others."""

    def walked(d: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            nxt = permute_digits(state["d"], key, kind)
            return F.when(state["done"], state).otherwise(_let(nxt, lambda x: F.struct(x.alias("d"), (good(x) == good(d)).alias("done"))))

        start = F.struct(d.alias("d"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["d"]

    return _let(digits, walked)


def _digit(digits: Column, i: Column) -> Column:
    return digits.substr(i, F.lit(1)).cast("int")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and cast out by nines."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def value(i: Column) -> Column:
            x = _digit(d, i)
            return F.when((n - i) % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

        return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b)

    return _let(digits, total)


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by these, in order."""

    def filled(d: Column) -> Column:
        def at(i: Column) -> Column:
            seen = F.length(F.regexp_replace(shape.substr(F.lit(1), i), "[^0-9]", ""))
            return F.when(shape.substr(i, F.lit(1)).rlike("[0-9]"), d.substr(seen, F.lit(1))).otherwise(shape.substr(i, F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")

    return _let(digits, filled)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _day(value: Column) -> Column:
    """Days from FIRST_DAY to a date in one of the formats; null if there is no such day or it is out of range.

    A date with strokes is read day first, and month first if there is no such day.
    """
    parsed = F.coalesce(
        F.when(value.rlike(r"^[0-9]{4}-"), F.try_to_date(value, "yyyy-M-d")),
        F.when(value.contains("/"), F.coalesce(F.try_to_date(value, "d/M/yyyy"), F.try_to_date(value, "M/d/yyyy"))),
        F.when(value.contains("."), F.try_to_date(value, "d.M.yyyy")),
    )
    day = F.datediff(parsed, F.to_date(F.lit(FIRST_DAY)))
    return F.when(day.between(0, DAYS - 1), day)


def is_social(digits: Column) -> Column:
    """Whether nine digits are a social number: areas 000, 666 and from 900 on, group 00 and serial 0000 are never given."""
    return digits.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _dialled(digits: Column) -> Column:
    """Whether a number's first digit, and of ten digits the exchange's too, is 2 or more."""
    return digits.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$|^[2-9](?![0-9]{9}$)")


def _checked(text: Column) -> Column:
    """The remainder by 97 of an IBAN whose first four characters are moved to the end, letters read as 10 to 35."""
    moved = F.concat(text.substr(F.lit(5), F.length(text)), text.substr(F.lit(1), F.lit(4)))

    def value(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), value)


def _groups(value: Column) -> Column:
    """The eight 16-bit numbers of an address with colons."""
    sides = F.split(F.lower(value), "::")
    part = lambda k: F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda g: g != "")

    def filled(ends: Column) -> Column:
        missing = F.lit(8) - F.size(ends["a"]) - F.size(ends["b"])
        return F.transform(F.concat(ends["a"], F.array_repeat(F.lit("0"), missing), ends["b"]), lambda g: F.conv(g, 16, 10).cast("long"))

    return _let(F.struct(part(0).alias("a"), part(1).alias("b")), filled)


def _month_first(value: Column) -> Column:
    """Whether a date can be read month first only: its second number is beyond 12."""
    return value.rlike(r"/(?:1[3-9]|[23][0-9])/")


def _permute_day(day: Column, key: str, late: Column | None = None) -> Column:
    """Walk the cycle of a permutation of 5-digit numbers until a number below DAYS comes; if late, a day of the month beyond 12."""

    def step(state: Column, _: Column) -> Column:
        nxt = permute_digits(F.lpad(state["day"].cast("string"), 5, "0"), key, "date").cast("int")
        done = nxt < DAYS
        if late is not None:
            done = done & (~late | (F.dayofmonth(F.date_add(F.to_date(F.lit(FIRST_DAY)), nxt)) > 12))
        return F.when(state["done"], state).otherwise(F.struct(nxt.alias("day"), done.alias("done")))

    start = F.struct(day.cast("int").alias("day"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["day"]


def kind_of(value: Column) -> Column:
    """Which kind of personal data a candidate is; null if it isn't valid."""
    digits = _only_digits(value)
    octets = F.split(value, r"\.")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.contains(":"), F.when(F.size(_groups(value)) == 8, F.lit("address")))
        .when(value.rlike("^[A-Z]"), _let(F.replace(value, F.lit(" "), F.lit("")), lambda v: F.when(F.length(v).between(15, 34) & (_checked(v) == 1), F.lit("iban"))))
        .when(value.rlike(r"^[+(]"), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(value.rlike(r"^(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), F.lit("phone"))
        .when(value.rlike(r"^(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})$"), F.when(_day(value).isNotNull(), F.lit("date")))
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(is_social(digits), F.lit("social")))
        .when(value.contains("."), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("address")))
        .when(luhn_sum(digits) % 10 == 0, F.lit("card"))
    )


def _card(digits: Column, key: str) -> Column:
    body = permute_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
    return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def _address(value: Column, key: str) -> Column:
    def permuted(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("address"))
        return _let(pair, lambda p: F.concat_ws(".", *(x.cast("string") for half in (p["a"], p["b"]) for x in (F.floor(half / 256), half % 256))))

    return _let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), permuted)


def _phone(value: Column, digits: Column, key: str) -> Column:
    """The last ten digits permuted; of a shorter number with a country code, all but the first two."""
    prefix = F.greatest(F.length(digits) - 10, F.when(value.startswith("+") & (F.length(digits) < 11), 2).otherwise(0))
    return F.concat(digits.substr(F.lit(1), prefix), _walk(digits.substr(prefix + 1, F.lit(10)), key, "phone", _dialled))


def _date(value: Column, key: str) -> Column:
    """Months and days get two digits. A date that can only be read month first becomes another such date."""
    late = _month_first(value)
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), _permute_day(_day(value), key, late))
    return _let(
        day,
        lambda d: F.when(late, F.date_format(d, "MM/dd/yyyy")).when(value.contains("/"), F.date_format(d, "dd/MM/yyyy")).when(value.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")),
    )


def _email(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value), F.lit(key)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 32), F.lit("@example.invalid"))


def _iban(value: Column, key: str) -> Column:
    """Country and letters stay; the account's digits are permuted, by twenty from the right, and the check digits follow."""
    plain = F.replace(value, F.lit(" "), F.lit(""))

    def permuted(v: Column) -> Column:
        digits = _only_digits(v.substr(F.lit(5), F.length(v)))

        def parts(d: Column) -> Column:
            cut = F.greatest(F.length(d) - 20, F.lit(0))
            low = F.when(F.length(d) - cut > 1, permute_digits(d.substr(cut + 1, F.lit(20)), key, "iban")).otherwise(d)
            return F.concat(F.when(cut > 1, permute_digits(d.substr(F.lit(1), cut), key, "iban")).otherwise(d.substr(F.lit(1), cut)), low)

        body = _refill(v.substr(F.lit(5), F.length(v)), _let(digits, parts))
        return _let(body, lambda b: F.concat(F.lpad((98 - _checked(F.concat(v.substr(F.lit(1), F.lit(2)), F.lit("00"), b))).cast("string"), 2, "0"), _only_digits(b)))

    return _refill(value, _let(plain, permuted))


def _address_6(value: Column, key: str) -> Column:
    """Both halves permuted, the second under the first: all eight groups, written out."""

    def permuted(g: Column) -> Column:
        half = lambda k, tweak: feistel(g[k] * 65536 + g[k + 1], g[k + 2] * 65536 + g[k + 3], F.lit(1 << 32), F.lit(1 << 32), key, tweak)
        both = F.array(half(0, F.lit("address6")), half(4, F.concat_ws(":", F.lit("address6"), *(g[k].cast("string") for k in range(4)))))
        words = lambda h: F.array(*(F.lower(F.hex(x.cast("long"))) for side in ("a", "b") for x in (F.floor(h[side] / 65536), h[side] % 65536)))
        return F.concat_ws(":", F.flatten(F.transform(both, words)))

    return _let(_groups(value), permuted)


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value; other values stay as they are."""
    digits = _only_digits(value)
    return (
        F.when(kind == "email", _email(value, key))
        .when(kind == "phone", _refill(value, _phone(value, digits, key)))
        .when(kind == "date", _date(value, key))
        .when(kind == "social", _refill(value, _walk(digits, key, "social", is_social)))
        .when(kind == "card", _refill(value, _card(digits, key)))
        .when((kind == "address") & value.contains(":"), _address_6(value, key))
        .when(kind == "address", _address(value, key))
        .when(kind == "iban", _iban(value, key))
        .otherwise(value)
    )


def pseudonymize(docs: DataFrame, key: str, *, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with pseudonyms in text, and how many values of each kind got one (pii_email, pii_phone, ..., n_pii).

    The key decides the permutations; keep it secret. A null text stays null and has counts 0, an empty one stays empty.
    Candidates that fail validation stay as they are. Rows are neither merged nor dropped, and other columns keep their
    values; columns with the counts' names are replaced. With counts=False only the text changes.
    """
    names = [f"pii_{k}" for k in KINDS]
    kept = docs.drop(*names, "n_pii") if counts else docs
    none = F.expr("CAST(array() AS array<string>)")
    value = F.col(text)

    def by_pattern(use: Callable[[str], Column]) -> Column:
        return F.when(value.contains("@"), use(PATTERN)).when(value.rlike("[0-9]|::"), use(NUMBERS))

    found = kept.withColumn("__found", F.coalesce(by_pattern(lambda p: F.regexp_extract_all(value, F.lit(p), F.lit(0))), none))
    kinds = found.withColumn("__kinds", F.transform("__found", kind_of))
    fresh = kinds.withColumn("__new", F.zip_with("__found", "__kinds", lambda v, k: pseudonym(v, k, key)))
    gaps = fresh.withColumn("__gaps", F.when(F.size("__found") > 0, by_pattern(lambda p: F.split(value, p, -1))).otherwise(none))
    joined = F.array_join(F.zip_with("__gaps", "__new", lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    out = gaps.withColumn(text, F.when(F.size("__found") > 0, joined).otherwise(value))
    if counts:
        for k, name in zip(KINDS, names, strict=True):
            out = out.withColumn(name, (F.size("__kinds") - F.size(F.array_remove(F.array_compact("__kinds"), k)) - F.size(F.filter("__kinds", F.isnull))).cast("long"))
        out = out.withColumn("n_pii", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return out.drop("__found", "__kinds", "__new", "__gaps")
