"""Format-preserving pseudonyms for personal numbers and dates: keyed Feistel permutations, all in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import let, packed, unpacked

ROUNDS = 10
#: First day and length of the range of dates: 400 years, a whole Gregorian cycle of 146,097 = 189 * 773 days.
FIRST_DAY, DAYS, DAY_SPLIT = "1800-01-01", 146_097, 773

#: By kind, in the order in which they are tried. No text, however long, makes the matcher recurse deeply or read the same
#: stretch again and again: repetitions are bounded, and what stands before an @ is looked at from its beginning only. It may have
#: any length and letters of any script; an address has 127 labels at most, as names of hosts have. Numbers with more parts than
#: an address of the internet has are none.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{M}\p{N}-]{1,63}+\.){1,126}\p{L}{2,24}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.\d)",
    "phone": r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
#: A match begins and ends where no letter or digit touches it.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + r")(?![\p{L}\p{N}])"


def _mixed(key: str, tweak: Column, i: Column, x: Column) -> Column:
    """Round function: a 60-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Keyed permutation of the pairs (left < a, right < b): struct l, r."""

    def step(s: Column, i: Column) -> Column:
        new_l = F.struct(((s["l"] + _mixed(key, tweak, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
        new_r = F.struct(s["l"].alias("l"), ((s["r"] + _mixed(key, tweak, i, s["l"])) % b).alias("r"))
        return F.when(i % 2 == 0, new_l).otherwise(new_r)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _fill(layout: Column, chars: Column, slot: str) -> Column:
    """layout with its characters of class ``slot`` replaced, in order, by those of chars."""

    def step(s: Column, c: Column) -> Column:
        put = F.struct(F.concat(s["s"], F.substr(chars, s["k"], F.lit(1))).alias("s"), (s["k"] + 1).alias("k"))
        return F.when(c.rlike(slot), put).otherwise(F.struct(F.concat(s["s"], c).alias("s"), s["k"].alias("k")))

    return F.aggregate(_chars(layout), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda s: s["s"])


def permute_digits(key: str, tweak: str, digits: Column) -> Column:
    """A digit string of up to 30 digits to another of the same length."""
    n = F.length(digits)
    la = F.floor(n / 2).cast("int")
    left = F.coalesce(F.when(la > 0, F.substr(digits, F.lit(1), la)).cast("long"), F.lit(0).cast("long"))
    right = F.substr(digits, la + 1, n - la).cast("long")
    size = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    out = feistel(key, F.concat(F.lit(f"{tweak}:"), n.cast("string")), left, right, size(la), size(n - la))
    return let(out, lambda s: F.concat(F.when(la > 0, F.lpad(s["l"].cast("string"), la, F.lit("0"))).otherwise(F.lit("")), F.lpad(s["r"].cast("string"), n - la, F.lit("0"))))


def permute_text(key: str, tweak: str, s: Column) -> Column:
    """A string to another whose characters are of the same classes in the same places: a-z, A-Z, 0-9; others stay."""
    half = F.floor(F.length(s) / 2).cast("int")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), F.length(s).cast("string"), i.cast("string"), other), 256)

        def one(c: Column, j: Column) -> Column:
            add = F.conv(F.substr(stream, j % 30 * 2 + 1, F.lit(4)), 16, 10).cast("int")
            turn = lambda first, n: F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + add) % n)
            return F.when(c.rlike("^[a-z]$"), turn("a", 26)).when(c.rlike("^[A-Z]$"), turn("A", 26)).when(c.rlike("^[0-9]$"), turn("0", 10)).otherwise(c)

        return F.array_join(F.transform(_chars(part), one), "")

    def step(t: Column, i: Column) -> Column:
        left = F.struct(shifted(t["l"], t["r"], i).alias("l"), t["r"].alias("r"))
        right = F.struct(t["l"].alias("l"), shifted(t["r"], t["l"], i).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda t: F.concat(t["l"], t["r"]))


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes body + digit pass the Luhn test."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["twice"], 2).otherwise(1)
        return F.struct((acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~acc["twice"]).alias("twice"))

    total = F.aggregate(F.reverse(_chars(body)), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("twice")), step, lambda acc: acc["sum"])
    return F.pmod(-total, F.lit(10)).cast("string")


def _card(key: str, m: Column) -> Column:
    """First digit, length and layout stay, the last digit is the new check digit."""

    def one(d: Column) -> Column:
        body = lambda: permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2))
        new = let(F.concat(F.substr(d, F.lit(1), F.lit(1)), body()), lambda b: F.concat(b, _luhn_digit(b)))
        return F.when(F.call_function("luhn_check", d), _fill(m, new, "^[0-9]$"))

    return let(_digits(m), one)


def _mod97(s: Column) -> Column:
    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(s), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    """Country and letters stay, the account's digits are permuted, the two check digits are new."""

    def one(s: Column) -> Column:
        body = F.substr(s, F.lit(5), F.length(s))
        country = F.substr(s, F.lit(1), F.lit(2))
        new_body = _fill(body, permute_digits(key, "iban", _digits(body)), "^[0-9]$")
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = let(new_body, lambda b: F.concat(country, check(b), b))
        valid = (_mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1) & F.length(s).between(15, 34) & (F.length(_digits(body)) > 0)
        return F.when(valid, _fill(m, whole, "^[A-Z0-9]$"))

    return let(F.regexp_replace(m, " ", ""), one)


def _phone(key: str, m: Column) -> Column:
    """Area and exchange, 200 to 999 each, and line are permuted; country code and layout stay."""

    def one(d: Column) -> Column:
        n = lambda at, size: F.substr(d, F.lit(at), F.lit(size)).cast("int")
        new = feistel(key, F.lit("phone"), (n(1, 3) - 200) * 800 + n(4, 3) - 200, n(7, 4), F.lit(640_000), F.lit(10_000))
        pad = lambda x, k: F.lpad(F.floor(x).cast("string"), k, "0")
        ten = let(new, lambda s: F.concat(pad(s["l"] / 800 + 200, 3), pad(s["l"] % 800 + 200, 3), pad(s["r"], 4)))
        head = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
        return F.when((n(1, 3) >= 200) & (n(4, 3) >= 200), _fill(m, F.concat(head, ten), "^[0-9]$"))

    return let(F.right(_digits(m), F.lit(10)), one)


def _ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    n = lambda at, size: F.substr(m, F.lit(at), F.lit(size)).cast("int")
    area, group, serial = n(1, 3), n(5, 2), n(8, 4)
    new = feistel(key, F.lit("ssn"), (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
    pad = lambda x, k: F.lpad(x.cast("int").cast("string"), k, "0")
    back = lambda a: a + F.when(a + 1 >= 666, 2).otherwise(1)
    out = let(new, lambda s: F.concat(pad(back(F.floor(s["l"] / 99)), 3), F.lit("-"), pad(s["l"] % 99 + 1, 2), F.lit("-"), pad(s["r"] + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), out)


def _ip(key: str, m: Column) -> Column:
    def one(p: Column) -> Column:
        n = lambda i: F.element_at(p, i).cast("int")
        new = feistel(key, F.lit("ip"), n(1) * 256 + n(2), n(3) * 256 + n(4), F.lit(65_536), F.lit(65_536))
        octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(F.forall(p, lambda x: (x.cast("int") <= 255) & ~x.rlike("^0[0-9]")), let(new, lambda s: F.concat_ws(".", octets(s["l"]), octets(s["r"]))))

    return let(F.split(m, r"\."), one)


def _date(key: str, m: Column) -> Column:
    """ISO dates, and month/day/year or day.month.year; each keeps its order, separators and padding."""

    def from_iso(iso: Column, write) -> Column:
        x = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
        new = feistel(key, F.lit("date"), F.floor(x / DAY_SPLIT), x % DAY_SPLIT, F.lit(DAYS // DAY_SPLIT), F.lit(DAY_SPLIT))
        day = lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAY_SPLIT + s["r"]).cast("int"))
        return F.when((x >= 0) & (x < DAYS), let(new, lambda s: write(day(s))))

    def parted(at: dict[str, int], separator: str):
        """Day, month and year at these places; a day or month of one digit has no leading zero afterwards either."""

        def one(p: Column) -> Column:
            x = {k: F.element_at(p, i) for k, i in at.items()}
            iso = F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0"))
            part = lambda day, k, wide: F.when(F.length(x[k]) == 1, F.date_format(day, wide[0])).otherwise(F.date_format(day, wide))
            texts = lambda day: {"d": part(day, "d", "dd"), "m": part(day, "m", "MM"), "y": F.date_format(day, "yyyy")}
            return from_iso(iso, lambda day: F.concat_ws(separator, *[texts(day)[k] for k in sorted(at, key=at.get)]))

        return one

    iso = from_iso(m, lambda d: F.date_format(d, "yyyy-MM-dd"))
    return F.when(m.contains("-"), iso).when(m.contains("/"), let(F.split(m, "/"), parted({"m": 1, "d": 2, "y": 3}, "/"))).otherwise(let(F.split(m, r"\."), parted({"d": 1, "m": 2, "y": 3}, ".")))


def _email(key: str, m: Column) -> Column:
    """The part before the @ is permuted character by character; the address's host stays."""
    return F.concat(permute_text(key, "email", F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1))


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """docs plus ``found`` (kinds of the replaced values, in order) and ``safe_text``.

    Values that look like e-mail addresses, IBANs, dates, US social security numbers, IPv4 addresses, North American
    phone numbers or payment cards are replaced if they are valid (checksums, ranges, calendar); all others stay.
    Each kind's format is permuted onto itself, so different values get different pseudonyms and equal values the
    same one in every document, whatever their separators. Dates keep order, separators and the padding of each part.

    Null text stays null and has nothing found; other columns pass through, nulls and repeated rows too; a column of
    docs named ``found`` or ``safe_text`` gives way to the new one. An empty table gives an empty result.
    """

    def one(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        new = F.lit(None).cast("string")
        for name in reversed(PATTERNS):
            is_it = m.rlike(f"^(?:{PATTERNS[name]})$")
            kind, new = F.when(is_it, F.lit(name)).otherwise(kind), F.when(is_it, MAKERS[name](key, m)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"), m.alias("old"))

    out = packed(docs, text=F.col("text"), hits=F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")))
    out = out.withColumn("made", F.transform("hits", one))
    between = F.split("text", PATTERN, -1)
    parts = F.zip_with(between, F.transform("made", lambda x: F.coalesce(x["new"], x["old"])), lambda p, x: F.concat(p, F.coalesce(x, F.lit(""))))
    kinds = F.transform(F.filter("made", lambda x: x["new"].isNotNull()), lambda x: x["kind"])
    out = out.withColumn("kinds", kinds).withColumn("safe", F.when(F.size("kinds") > 0, F.array_join(parts, "")).otherwise(F.col("text")))
    return unpacked(out, docs, found=F.col("kinds"), safe_text=F.col("safe"))
