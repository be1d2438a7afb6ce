"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their own check (Luhn, mod 97, octets, calendar,
ranges) and e-mail addresses, phone numbers and access keys are replaced by a
keyed permutation of their own format, a Feistel network whose rounds are taken from
SHA-256 of the key.  A value always becomes the same pseudonym, in every
document, two values never become one, and the pseudonym passes the same check.

- cards (13 to 19 digits together, in fours, or as 4-6-5): all digits but the last are permuted and the check digit is worked out anew;
- IBANs, together or in groups of four: the account part is permuted, and the two check digits are made to fit;
- IPv4: the 32-bit number is permuted;
- social security numbers: the valid ones are permuted among themselves;
- dates of 1900 to 2099 (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy): days are permuted;
- phone numbers of ten digits (3-3-4), with or without a country code: the digits but the country code are permuted;
- e-mail addresses, of any length, and access keys: letters and digits keep their kind; an address keeps its domain.

What looks like a number but fails its check stays as it is, and so does what
is written in other shapes than these.

Defined results: null text stays null, with 0 replacements; texts are read whole;
repeated rows each give a row; an empty table gives an empty result; other
columns are kept, whatever their names, but for ``count_col``, if there is one already.  A permutation
can map a value to itself, once in as many cases as its format has values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import unused

_B, _E = r"(?<![\w])", r"(?![\w])"
#: Patterns by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "key": _B + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{40})" + _E,
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _E,
    "phone": r"(?<![\w])(?:\+[0-9]{1,3}[ \-.]?)?\([0-9]{3}\) ?[0-9]{3}[ \-.]?[0-9]{4}" + _E + r"|(?<![\w.\-])(?:\+[0-9]{1,3}[ \-.])?[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}(?![\w\-]|\.[0-9])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w.\-/])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![\w\-/]|\.[0-9])",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "card": r"(?<![\w\-])(?:[0-9]{4}([ \-]))[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\w\-])|(?<![\w\-])[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5}(?![\w\-])|(?<![\w])[0-9]{13,19}" + _E,
}
#: What every text with a match holds: only keys can do without a digit and an @.
_ANY = r"[0-9@]|AKIA|gh[pousr]_|[a-f]{40}"
ROUNDS = 8


def _prf(key: Column, *parts) -> Column:
    """60 bits of SHA-256 of the key and the parts, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel_pair(key: Column, tag: str, left: Column, right: Column, a: int | Column, b: int | Column) -> Column:
    """A permutation of the pairs (left below a, right below b), as struct(l, r)."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s, t):
        return F.struct(
            F.when(t % 2 == 0, F.pmod(s["l"] + _prf(key, tag, t, s["r"]), a)).otherwise(s["l"]).cast("long").alias("l"),
            F.when(t % 2 == 1, F.pmod(s["r"] + _prf(key, tag, t, s["l"]), b)).otherwise(s["r"]).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, by a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel_text(key: Column, tag: str, value: Column) -> Column:
    """A permutation of the strings with the same letters, capitals and digits in the same places; other characters stay.

    A round shifts each character of one half by sixteen bits of a keystream: a
    digest of the key, the round and the other half, and of it one more for
    every sixteen characters.
    """
    half = F.floor(F.length(value) / 2).cast("int")

    def shift(part: Column, other: Column, t: Column) -> Column:
        def stream(seed):
            return F.transform(F.sequence(F.lit(0), F.floor((F.length(part) - 1) / 16).cast("int")), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 256))

        def turned(digests):
            def one(c, i):
                k = F.conv(F.substring(F.get(digests, F.floor(i / 16).cast("int")), i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
                code = F.ascii(c)
                turn = lambda first, n: F.char(F.lit(first) + (code - first + k) % n)
                return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(part, "", F.length(part)), one), "")

        seed = F.sha2(F.concat_ws("|", key, F.lit(tag), t.cast("string"), other), 256)
        return F.when(F.length(part) == 0, part).otherwise(_bound(seed, lambda x: _bound(stream(x), turned)))

    def step(s, t):
        left, right = F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s))
        return F.when(t % 2 == 0, F.concat(shift(left, right, t), right)).otherwise(F.concat(left, shift(right, left, t)))

    # one character alone has no other half: it is shifted by the key
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), value, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(pattern: Column, digits: Column) -> Column:
    """The digits put in place of those of ``pattern``, whose other characters stay."""
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda i: F.when(F.substring(pattern, i, F.lit(1)).between("0", "9"), F.substring(digits, F.length(_digits(F.substring(pattern, F.lit(1), i))), F.lit(1))).otherwise(F.substring(pattern, i, F.lit(1)))),
        "",
    )


def _card(key: Column, m: Column) -> Column:
    digits = _digits(m)
    head = feistel_text(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
    whole = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda x: F.call_function("luhn_check", x)), F.lit(0))
    return F.when(F.call_function("luhn_check", digits), _refill(m, whole)).otherwise(m)


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN's rearranged form; letters count 10 to 35."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def step(r, c):
        n = F.ascii(c)
        return F.when(c.between("0", "9"), (r * 10 + n - 48) % 97).otherwise((r * 100 + n - 55) % 97).cast("int")

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1))), F.lit(0), step)


def _iban(key: Column, m: Column) -> Column:
    def fitted(value):
        account = feistel_text(key, "iban", F.substring(value, F.lit(5), F.length(value)))
        return _bound(account, lambda x: F.concat(F.substring(value, 1, 2), F.lpad((F.lit(98) - _mod97(F.concat(F.substring(value, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x))

    def spaced(parts):
        """Groups of four; up to two more words of capitals may follow, which are no part of it."""
        whole = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))), ""))
        valid = F.get(F.filter(whole, lambda x: (F.length(x) >= 15) & (_mod97(x) == 1)), F.lit(0))
        return _bound(valid, lambda x: F.when(x.isNotNull(), F.concat(F.regexp_replace(fitted(x), "(.{4})(?=.)", "$1 "), F.substring(m, F.length(F.regexp_replace(x, "(.{4})(?=.)", "$1 ")) + 1, F.length(m)))).otherwise(m))

    return F.when(F.instr(m, " ") > 0, _bound(F.split(m, " "), spaced)).when(_mod97(m) == 1, fitted(m)).otherwise(m)


def _ipv4(key: Column, m: Column) -> Column:
    o = F.split(m, r"\.")
    octet = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
    valid = F.greatest(*octet) <= 255
    p = feistel_pair(key, "ipv4", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536)
    # the pair is bound once, by a fold over an array of one
    text = F.get(F.transform(F.array(p), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)), F.lit(0))
    return F.when(valid, text).otherwise(m)


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    p = feistel_pair(key, "ssn", left, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = F.get(F.transform(F.array(p), lambda s: F.concat_ws("-", pad(s["l"] + 1 + F.when(s["l"] + 1 >= 666, 1).otherwise(0), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))), F.lit(0))
    return F.when(valid, text).otherwise(m)


def _date(key: Column, m: Column) -> Column:
    """Of the 73,049 = 17 * 4297 days of 1900 to 2099."""
    iso = F.when(F.substring(m, 5, 1) == "-", m).when(F.substring(m, 3, 1) == ".", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    first = F.to_date(F.lit("1900-01-01"))
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), first)
    p = feistel_pair(key, "date", F.floor(day / 4297), day % 4297, 17, 4297)

    def write(s):
        d = F.date_add(first, (s["l"] * 4297 + s["r"]).cast("int"))
        return F.when(F.substring(m, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).when(F.substring(m, 3, 1) == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))

    return F.when(day.between(0, 73048), F.get(F.transform(F.array(p), write), F.lit(0))).otherwise(m)


def _phone(key: Column, m: Column) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    return F.concat(code, feistel_text(key, "phone", F.substring(m, F.length(code) + 1, F.length(m))))


def _email(key: Column, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(key, "email", local), F.substring(m, F.length(local) + 1, F.length(m)))


def _key(key: Column, m: Column) -> Column:
    """Hexadecimal keys keep to their digits; of others the prefix stays."""
    prefix = F.regexp_extract(m, r"^(?:AKIA|gh[pousr]_)", 0)
    half = lambda a: F.conv(F.substring(m, a, 10), 16, 10).cast("long")
    n = 1 << 40
    pairs = [feistel_pair(key, f"hex{i}", half(1 + 20 * i), half(11 + 20 * i), n, n) for i in (0, 1)]
    text = F.array_join(F.transform(F.array(*pairs), lambda s: F.concat(F.lpad(F.lower(F.hex(s["l"])), 10, "0"), F.lpad(F.lower(F.hex(s["r"])), 10, "0"))), "")
    return F.when(prefix != "", F.concat(prefix, feistel_text(key, "key", F.substring(m, F.length(prefix) + 1, F.length(m))))).otherwise(text)


def pseudonym(match: Column, key: Column) -> Column:
    """The pseudonym of one match of any of the patterns."""
    whole = lambda kind: match.rlike(f"^(?:{PATTERNS[kind]})$")
    by = {"email": _email, "key": _key, "iban": _iban, "phone": _phone, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card}
    out = None
    for kind in PATTERNS:
        test, then = whole(kind), by[kind](key, match)
        out = F.when(test, then) if out is None else out.when(test, then)
    return out.otherwise(match)


def pseudonymise(df: DataFrame, key: str, *, text: str = "text", count_col: str | None = "n_replaced") -> DataFrame:
    """``df`` with personal data in ``text`` replaced; ``count_col``: how many values changed.

    key: the secret that the permutation depends on.
    """
    # groups of a pattern are for repeated separators, numbered by their place among all
    pattern = "|".join(PATTERNS.values())
    keep = [c for c in df.columns if c != count_col]
    whole_, found_, new_, done_, changed_ = unused([*df.columns, count_col or text], "whole", "found", "new", "done", "changed")
    body = F.col(f"`{text}`").cast("string")
    found = F.when(body.rlike(_ANY), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    names = [F.col(f"`{c}`") for c in keep if c != text]
    one = df.select(*names, body.alias(whole_), found.alias(found_))
    # only rows with a match are split and put together again
    new = F.when(F.size(found_) > 0, F.transform(found_, lambda m: pseudonym(m, F.lit(key))))
    two = one.select("*", new.alias(new_))
    between = F.split(whole_, pattern, -1)
    parts = F.transform(F.arrays_zip(between.alias("a"), F.col(new_).alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit(""))))
    done = F.when(F.size(found_) > 0, F.array_join(parts, "")).otherwise(F.col(whole_))
    changed = F.when(F.size(found_) > 0, F.size(F.filter(F.arrays_zip(F.col(found_).alias("a"), F.col(new_).alias("b")), lambda z: z["a"] != z["b"]))).otherwise(0)
    three = two.select(*names, done.alias(done_), changed.cast("long").alias(changed_))
    out = [F.col(done_).alias(c) if c == text else F.col(f"`{c}`") for c in keep]
    return three.select(*out, *([F.col(changed_).alias(count_col)] if count_col else []))
