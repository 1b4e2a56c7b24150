"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found in every whole text: e-mail addresses, payment card numbers (13 to 19 digits, Luhn), IBANs (mod 97), IPv4 addresses,
calendar dates, telephone numbers (10 to 15 digits in a telephone's layout, or 7 and more after a plus sign), nine-digit identifiers
(3-2-4 digits; no area 000, 666 or 9xx, no group 00, no serial 0000) and long
hexadecimal secrets. Numbers that nothing tells from others, such as seven or ten digits in a row, stay. A run of numbers that is none of these as a whole is split at its spaces, and the parts are joined so
that values cover the most digits; of a failed card in its layout no part is a telephone number. What fails its validation stays as it is.

Numbers and dates go through a keyed Feistel network over exactly their domain: the two halves of the digits (or the two
factors of the day count) are added to, in turn, a keyed hash of the other half, modulo their own size. So a
card becomes another card of that length with a valid check digit, a date another date in the same layout, and equal values
stay equal in all documents. Dates are days from 1900-01-01 on, 73,000 of them (= 365 x 200). Addresses and secrets
become keyed digests in their layout. Null texts stay null; empty texts stay empty. Rows are rewritten one by one: repeated rows have
equal results, ids take no part, other columns are kept under their names, whatever these are, but for a column with the name of
``found_col``, which gives way to the findings. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DAYS, YEAR_DAYS = 73_000, 365
# What is looked for, in the order in which alternatives are tried.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"  # possessive groups are matched in a loop, others by recursion
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
OTHER_DATE = r"(?<![\d./])\d{2}(?:/\d{2}/|\.\d{2}\.)\d{4}(?!\d|[./]\d)"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?=\d*[A-Fa-f])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
CARD = r"(?<![\w+(])(?:\d{4}([ \-])\d{4}\{n}\d{4}\{n}\d{4}(?:\{n}\d{3})?|\d{4}([ \-])\d{6}\{m}\d{5})(?!\w|[.\-]\d)"
PHONE = r"(?<![\w+(])(?:\+\d{1,3} )?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[.\-]\d{4}(?!\w|[.\-]\d)"
IDENTIFIER = r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
# A loose run ends before a value with a layout of its own.
LAYOUT = r"\d{4}-\d{2}-\d{2}(?![\d\-])|\d{2}(?:/\d{2}/|\.\d{2}\.)\d{4}(?!\d|[./]\d)|(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)|\d{4} \d{4} \d{4} \d{4}(?!\w|[.\-]\d)|\d{4}-\d{4}-\d{4}-\d{4}(?!\w|[.\-]\d)|\(?\d{3}\)?[ .\-]\d{3}[.\-]\d{4}(?!\w|[.\-]\d)"
NUMBER = r"(?<![\w+(])(?:\+?\(?)\d(?:(?![ ().\-]?[ ](?:" + LAYOUT + r"))[ ().\-]{0,2}\d){6,199}(?!\w|[.\-]\d)"
PATTERN = "|".join([EMAIL, ISO_DATE, OTHER_DATE, IPV4, IBAN, SECRET, CARD.replace("{n}", "1").replace("{m}", "2"), PHONE, NUMBER])
MOST_DIGITS = 19  # of one value
CARD_LAYOUT = r"^(\d{4}([ \-])\d{4}\2\d{4}\2\d{4}|\d{4}([ \-])\d{6}\3\d{5})"
# What tells a card and a telephone from a row of numbers, among the parts of a run.
CARD_PART = r"^\d{4}([ \-]?\d{3,7})+$"
TELEPHONE = r"^(\+|\(|0\d)|\)|\d-\d|^\d{3}[. ]\d{3}[. ]\d{4}$"
# What a part has to look like to be asked what it is, and what a run has to hold to be split: a telephone's signs, or groups as of a card.
LIKELY = r"^(\+|\(|0\d|\d{4}[ \-]?\d{3,7}[ \-]?\d{3}|\d{3}[. ]\d{3}[. ]\d{4} *$)|\)|\d-\d"
SPLIT = r"^[0-9 +().\-]+$"
HOLDS = r"(?:^| )(?:[+(]|0\d|\d{4}[ \-]?\d{3,7}[ \-]?\d{3}|\d{3}[. ]\d{3}[. ]\d{4}(?!\d))|\)|\d-\d"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated and planned once however often it stands in it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prf(key: str, tweak: Column, round_no: Column, half: Column) -> Column:
    """A keyed 60-bit number of a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, round_no.cast("string"), half.cast("string"), F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, left: Column, right: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. left * right - 1."""
    start = F.struct(((x - F.pmod(x, right)) / right).cast("long").alias("l"), F.pmod(x, right).cast("long").alias("r"))

    def step(s, i):
        l = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(prf(key, tweak, i, s["r"]), left), left)).otherwise(s["l"])
        r = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(prf(key, tweak, i, s["l"]), right), right)).otherwise(s["r"])
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * right + s["r"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A digit string of 2 to 18 digits -> another of that length."""
    n = F.length(digits).cast("int")
    low = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("long"), _power(n - low), _power(low), key, F.concat(F.lit(tweak), n.cast("string"))).cast("string"), n, "0")


def _digit_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; every second digit counts double, beginning ``doubled_from_right`` places from the right."""
    cells = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == doubled_from_right, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(cells, F.lit(0), lambda a, x: a + x)


def is_luhn(digits: Column) -> Column:
    return F.pmod(_digit_sum(digits, 1), F.lit(10)) == 0


def permute_card(digits: Column, key: str) -> Column:
    """All but the check digit permuted, the check digit made anew."""
    body = permute_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
    return F.concat(body, F.pmod(10 - F.pmod(_digit_sum(body, 0), F.lit(10)), F.lit(10)).cast("string"))


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's letters and digits, letters as 10 to 35."""
    cells = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(cells, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def is_iban(compact: Column) -> Column:
    return F.length(compact).between(15, 34) & (_mod97(F.concat(compact.substr(F.lit(5), F.lit(40)), compact.substr(F.lit(1), F.lit(4)))) == 1)


def permute_iban(compact: Column, key: str) -> Column:
    """The account's digits permuted in place (its last 16 at most), check digits made anew."""
    country, account = compact.substr(F.lit(1), F.lit(2)), compact.substr(F.lit(5), F.lit(40))
    digits = F.regexp_replace(account, "[^0-9]", "")
    keep = F.greatest(F.lit(0), F.length(digits) - 16)
    fresh = F.concat(digits.substr(F.lit(1), keep), permute_digits(F.when(F.length(digits) >= 2, digits.substr(keep + 1, F.lit(16))).otherwise("00"), key, "iban"))
    account = refill(account, fresh)
    check = 98 - _mod97(F.concat(account, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


def refill(layout: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """``layout`` with its characters of ``kind`` replaced, in order, by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    cells = F.filter(F.split(layout, ""), lambda c: c != "")

    def step(s, c):
        return F.struct(F.concat(s["out"], F.when(c.rlike(kind), digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(c.rlike(kind), 1).otherwise(0)).alias("at"))

    return F.aggregate(cells, start, step, lambda s: s["out"])


def _date_parts(m: Column) -> tuple[Column, Column]:
    """(date or null, layout): day first, month first where that is no date."""
    iso = F.try_to_date(m, "yyyy-MM-dd")
    flat = F.regexp_replace(m, "[./]", "-")
    first, second = F.try_to_date(flat, "dd-MM-yyyy"), F.try_to_date(flat, "MM-dd-yyyy")
    return F.coalesce(iso, first, second), F.when(iso.isNotNull(), "yyyy-MM-dd").when(first.isNotNull(), "dd-MM-yyyy").otherwise("MM-dd-yyyy")


def permute_date(m: Column, key: str) -> Column:
    return let(F.struct(*(c.alias(n) for c, n in zip(_date_parts(m), ("day", "layout"), strict=True))), lambda d: _moved_date(m, d["day"], d["layout"], key))


def _moved_date(m: Column, day: Column, layout: Column, key: str) -> Column:
    n = feistel(F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long"), F.lit(YEAR_DAYS), F.lit(DAYS // YEAR_DAYS), key, F.lit("date"))
    written = lambda day: F.when(layout == "yyyy-MM-dd", F.date_format(day, "yyyyMMdd")).when(layout == "dd-MM-yyyy", F.date_format(day, "ddMMyyyy")).otherwise(F.date_format(day, "MMddyyyy"))
    return refill(m, let(F.date_add(F.lit("1900-01-01").cast("date"), n.cast("int")), written))


def permute_identifier(digits: Column, key: str) -> Column:
    """A valid nine-digit identifier -> another: areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area, group, serial = (digits.substr(F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
    x = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    n = feistel(x, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("identifier"))
    high = F.floor(n / 9999).cast("long")
    area = F.floor(high / 99).cast("long") + 1
    area = area + F.when(area > 665, 1).otherwise(0)
    return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad((F.pmod(high, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))


def permute_ipv4(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, "\\."), i).cast("long")
    n = feistel(part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * 256 + part(4), F.lit(1 << 16).cast("long"), F.lit(1 << 16).cast("long"), key, F.lit("ipv4"))
    return F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))


def kind_of(m: Column) -> Column:
    """What a match is, after its validation; null for none."""
    digits, compact = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, " ", "")
    n = F.length(digits)
    is_day = let(F.datediff(_date_parts(m)[0], F.lit("1900-01-01").cast("date")), lambda since: (since >= 0) & (since < DAYS))
    octets = F.forall(F.split(m, "\\."), lambda o: o.cast("int") <= 255)
    phone = (m.rlike(r"^\+") & n.between(7, 15)) | (n.between(10, 15) & m.rlike(r"[ ().\-]"))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), F.when(is_day, "date"))
        .when(m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), F.when(octets, "ipv4"))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}") & ~m.rlike("^[0-9A-F]{32,}$"), F.when(is_iban(compact), "iban"))
        .when(m.rlike("^[0-9A-Fa-f]{32,}$"), "secret")
        .when(n.between(13, 19) & is_luhn(digits), "card")
        .when(phone, "phone")
        .when(m.rlike(IDENTIFIER), "identifier")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    digits, compact = F.regexp_replace(m, "[^0-9]", ""), F.regexp_replace(m, " ", "")
    mac = F.sha2(F.concat_ws("|", F.lit(key), F.lower(m), F.lit(key)), 256)
    hexes = F.substring(F.repeat(mac, 8), 1, 512).substr(F.lit(1), F.length(m))
    return (
        F.when(kind == "email", F.concat(F.lit("user."), F.substring(mac, 1, 16), F.lit("@example.org")))
        .when(kind == "date", permute_date(m, key))
        .when(kind == "ipv4", permute_ipv4(m, key))
        .when(kind == "iban", refill(m, permute_iban(compact, key), "[A-Z0-9]"))
        .when(kind == "secret", F.when(m.rlike("[A-F]"), F.upper(hexes)).otherwise(hexes))
        .when(kind == "card", refill(m, permute_card(digits, key)))
        .when(kind == "identifier", refill(m, permute_identifier(digits, key)))
        .when(kind == "phone", refill(m, permute_digits(digits, key, "phone")))
        .otherwise(m)
    )


def values_of(m: Column) -> Column:
    """A match as the values it holds, (v, kind), each with the spaces after it: itself, or the parts of a run that is no value as a whole.

    A run without anything that a telephone or a card needs is not looked into; of the others only parts of 7 to 19 digits that look like one are asked what they are.
    """
    tokens = F.regexp_extract_all(m, F.lit("[^ ]+ *"), 0)
    empty = F.array().cast("array<struct<v:string,kind:string>>")
    start = F.array(F.struct(F.lit(0).alias("seen"), F.lit(0).alias("digits"), F.lit(0).alias("fewer"), empty.alias("parts")))

    def step(best, j):
        last = F.element_at(tokens, j)

        def ending(seen):
            def part_from(i):
                before = F.get(best, i)
                n = seen - before["seen"]
                single = i == j - 1

                def judged(part):
                    def chosen(kind):
                        good = F.when(kind == "card", F.rtrim(part).rlike(CARD_PART)).when(kind == "phone", F.rtrim(part).rlike(TELEPHONE) & ~m.rlike(CARD_LAYOUT)).otherwise(kind.isNotNull())
                        return let(F.coalesce(good, F.lit(False)), lambda good: F.when(good | single, F.struct(
                            seen.alias("seen"), (before["digits"] + F.when(good, n).otherwise(0)).alias("digits"), (before["fewer"] - 1).alias("fewer"),
                            F.concat(before["parts"], F.array(F.struct(part.alias("v"), F.when(good, kind).alias("kind")))).alias("parts"))))

                    likely = (n.between(7, MOST_DIGITS) & part.rlike(LIKELY)) | (single & part.rlike(r"\d[.\-]\d"))
                    return F.when(likely, let(kind_of(F.rtrim(part)), chosen)).when(single, chosen(F.lit(None).cast("string")))

                return F.when(single, let(last, judged)).when(n.between(7, MOST_DIGITS), let(F.array_join(F.slice(tokens, i + 1, j - i), ""), judged))

            return F.array_max(F.transform(F.sequence(F.greatest(F.lit(0), j - MOST_DIGITS), j - 1), part_from))

        seen = F.element_at(best, -1)["seen"] + F.length(F.regexp_replace(last, "[^0-9]", ""))
        return F.concat(best, F.array(let(seen, ending)))

    split = F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step, lambda best: F.element_at(best, -1)["parts"])
    return let(kind_of(m), lambda kind: F.when(kind.isNull() & m.contains(" ") & m.rlike(SPLIT) & m.rlike(HOLDS), split).otherwise(F.array(F.struct(m.alias("v"), kind.alias("kind")))))


def pseudonymise(documents: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """``documents`` with ``text_col`` rewritten; adds ``found_col`` (kind and pseudonym of each value found, in order)."""
    source = F.col(f"`{text_col}`")
    raw, new, changed = (f"{name}_{uuid.uuid4().hex}" for name in ("raw", "new", "changed"))  # the table may have any other name
    found = F.regexp_extract_all(source, F.lit(PATTERN), 0)
    parts = F.flatten(F.transform(found, lambda m, i: F.transform(values_of(m), lambda v: F.struct(i.alias("at"), v["v"].alias("v"), v["kind"].alias("kind")))))
    rows = documents.withColumn(raw, parts)
    rows = rows.withColumn(new, F.transform(raw, lambda x: F.struct(x["kind"].alias("kind"), pseudonym(F.rtrim(x["v"]), x["kind"], key).alias("value"), x["at"].alias("at"), F.regexp_extract(x["v"], " *$", 0).alias("space"))))
    between = F.split(source, PATTERN, -1)
    text = F.when(F.size(F.filter(new, lambda x: x["kind"].isNotNull())) > 0, F.array_join(F.transform(between, lambda s, i: F.concat(s, F.array_join(F.transform(F.filter(new, lambda x: x["at"] == i), lambda x: F.concat(x["value"], x["space"])), ""))), "")).otherwise(source)
    rows = rows.withColumn(changed, text)
    findings = F.transform(F.filter(new, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    return rows.select(*(F.col(changed).alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns if c != found_col), findings.alias(found_col))
