"""Personal data as format-preserving Feistel pseudonyms, in DataFrame functions only.

Each value is validated for its kind (card numbers by Luhn, IBANs by mod 97, dates by the calendar, addresses by octet,
telephone and social security numbers by their fields). Patterns match what is valid only, so nothing invalid hides a
value that overlaps it. What a pattern cannot tell is found first: every stretch of whole groups that is a valid card
number or IBAN, from every place where one can start; these strings join the pattern of their text. Then one scan takes
the leftmost value, by kind and of one kind the longest (IBANs: that of its country's length). A valid value is permuted by a keyed Feistel network within its own format, so the result is again valid, keeps its
separators, and equal values get equal pseudonyms in every document. What is not valid stays as it is.

Numbers of fixed fields are two halves with moduli (A, B); a round adds a keyed hash of one half to the
other and takes the rest. E-mail names, account parts and secrets are two halves of characters shifted
within their class (0-9, a-f, g-z, A-F, G-Z) by a keyed hash of the other half. Each round can be undone,
so different values never share a pseudonym. E-mail domains and the label before a secret are kept.

Defined results. Null texts stay null with n_pii 0; texts without values are returned unchanged.
Repeated rows are treated alike. There is no shuffle and no state: a row costs its own length, and a
lost executor's rows are computed again to the same result. Extra columns are kept; kinds and n_pii replace
columns so named. Dates outside 1800 to 2199 stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

ROUNDS = 8
#: Repeated groups are possessive or bounded: a greedy one without bound recurses once for each turn, and a long text then overflows the stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
#: Years 1800 to 2199 with hyphens are days of the calendar here, as a card number can start like one that is not; the time of day can follow after T.
_DAY = r"(?:1[89]|2[01])[0-9]{2}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|[12][0-9]))(?<!(?:[02468][1235679]|[13579][01345789]|1800|1900|2100)-02-29)"
DATE = rf"(?<![A-Za-z0-9./-])(?:{_DAY}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})(?![A-SU-Za-su-z0-9/-]|[Tt](?![0-9]))"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
ADDRESS = rf"(?<![A-Za-z0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[A-Za-z0-9])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])"
PHONE = r"(?<![A-Za-z0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![A-Za-z0-9])"
#: International numbers: the country code stays, seven to twelve digits after it are permuted.
_ONE = r"[ .()-]{0,3}[0-9]"
WORLD = rf"(?<![A-Za-z0-9+])\+[2-9][0-9]{{0,2}}(?:[ .-]?\(?[0-9]{{1,4}}\)?){{2,5}}(?<=\+(?:[0-9]{{3}}|[0-9]{{1,2}}(?![0-9])){_ONE * 7}{f'(?:{_ONE})?' * 5}\)?)(?![A-Za-z0-9])"
#: What needs no look at the digits but the pattern's; card numbers and IBANs are added for each text.
PATTERN = "|".join((EMAIL, SECRET, DATE, ADDRESS, SSN, PHONE, WORLD))
#: Length of each country's IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
CLASSES = (("0", "9"), ("a", "f"), ("g", "z"), ("A", "F"), ("G", "Z"))


def _digest(key: str, tweak: str, i: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), value).cast("binary"), 256)


def feistel(key: str, tweak: str, a: Column, b: Column, mod_a: Column, mod_b: Column, back: bool = False) -> Column:
    """Struct (a, b) permuted within mod_a x mod_b; ``back`` undoes it. Both halves below 2**59."""
    step = lambda v: F.conv(F.substring(v, 1, 14), 16, 10).cast("long")
    sign = -1 if back else 1

    def round_(acc: Column, i: Column) -> Column:
        x, y = acc["a"], acc["b"]
        even = F.pmod(x + sign * F.pmod(step(_digest(key, tweak, i, y.cast("string"))), mod_a), mod_a)
        odd = F.pmod(y + sign * F.pmod(step(_digest(key, tweak, i, x.cast("string"))), mod_b), mod_b)
        first = i % 2 == 0
        return F.struct(F.when(first, even).otherwise(x).alias("a"), F.when(first, y).otherwise(odd).alias("b"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), round_)


def _pow10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute_digits(key: str, tweak: str, digits: Column, back: bool = False) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    out = feistel(key, tweak, digits.substr(F.lit(1), u), digits.substr(u + 1, n - u), _pow10(u), _pow10(n - u), back)
    return F.aggregate(F.array(out), F.lit(""), lambda _, o: F.concat(F.lpad(o["a"].cast("string"), u, "0"), F.lpad(o["b"].cast("string"), n - u, "0")))


def permute_chars(key: str, tweak: str, text: Column, back: bool = False) -> Column:
    """Letters and digits shifted within their class; other characters and the length stay."""
    n = F.length(text)
    u = F.greatest(F.lit(1), F.floor(n / 2)).cast("int")
    sign = -1 if back else 1

    def shifted(half: Column, other: Column, i: Column) -> Column:
        stream = _digest(key, tweak, i, other)

        def one(c: Column, at: Column) -> Column:
            step = F.conv(F.substring(stream, F.pmod(at, F.lit(31)) * 2 + 1, 4), 16, 10).cast("int")
            out = c
            for low, high in CLASSES:
                size = ord(high) - ord(low) + 1
                out = F.when(c.between(low, high), F.chr(F.pmod(F.ascii(c) - ord(low) + sign * F.pmod(step, F.lit(size)), F.lit(size)) + ord(low))).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def round_(acc: Column, i: Column) -> Column:
        first = i % 2 == 0
        return F.struct(
            F.when(first, shifted(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"),
            F.when(first, acc["b"]).otherwise(shifted(acc["b"], acc["a"], i)).alias("b"),
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(text.substr(F.lit(1), u).alias("a"), text.substr(u + 1, n).alias("b"))
    return F.aggregate(order, start, round_, lambda acc: F.concat(acc["a"], acc["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """Puts ``digits`` in the places of the digits of ``shape``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, digits.substr(acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, put, lambda acc: acc["s"])


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum, the last digit counting once."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(account: Column) -> Column:
    """The rest of an account number (letters as 10 to 35) by 97."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)

    return F.aggregate(F.split(account, ""), F.lit(0), add)


def _bind(value: Column, body) -> Column:  # noqa: ANN001
    """Evaluates ``value`` once and uses it in ``body``."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _two(v: Column, n: int) -> Column:
    return F.lpad(v.cast("string"), n, "0")


def _card(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        body = permute_digits(key, "card", d.substr(F.lit(1), F.length(d) - 1))
        return F.when(luhn_sum(d) % 10 == 0, _bind(body, lambda b: _refill(m, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))))

    return _bind(_digits(m), made)


def _date(key: str, m: Column) -> Column:
    """146097 days of a 400-year cycle are 189 x 773. Day and month are told apart by a value over 12, else month first."""
    epoch = F.lit("1800-01-01").cast("date")
    day_first = (F.substring(m, 1, 2) > "12")
    shapes = ((m.rlike(r"\A[0-9]{4}-"), "yyyy-MM-dd"), (m.rlike(r"\A[0-9]{4}/"), "yyyy/MM/dd"), (m.rlike(r"\A[0-9]{2}\."), "dd.MM.yyyy"), (day_first, "dd/MM/yyyy"), (~day_first, "MM/dd/yyyy"))

    def permuted(fmt: str) -> Column:
        def moved(d: Column) -> Column:
            return _bind(feistel(key, "date", F.floor(d / 773), d % 773, F.lit(189), F.lit(773)), lambda o: F.date_format(F.date_add(epoch, (o["a"] * 773 + o["b"]).cast("int")), fmt))

        return _bind(F.date_diff(F.try_to_date(m, fmt), epoch), lambda d: F.when(d.between(0, 146096), moved(d)))

    out = None
    for where, fmt in shapes:
        out = F.when(where, permuted(fmt)) if out is None else out.when(where, permuted(fmt))
    return out


def _address(key: str, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))

    def made(p: Column) -> Column:
        out = feistel(key, "address", p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536))
        text = _bind(out, lambda o: F.array_join(F.array(*[F.floor(o[h] / 256) if top else o[h] % 256 for h in ("a", "b") for top in (True, False)]).cast("array<string>"), "."))
        return F.when(F.forall(p, lambda v: v <= 255), text)

    return _bind(parts, made)


def _ssn(key: str, m: Column) -> Column:
    def made(d: Column) -> Column:
        area, group, serial = d.substr(1, 3).cast("int"), d.substr(4, 2).cast("int"), d.substr(6, 4).cast("int")
        index = area - 1 - (area > 666).cast("int")  # 001 to 899 without 666
        out = feistel(key, "ssn", index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
        text = _bind(out, lambda o: _bind(F.floor(o["a"] / 99), lambda x: F.concat_ws("-", _two(x + 1 + (x >= 665).cast("int"), 3), _two(o["a"] % 99 + 1, 2), _two(o["b"] + 1, 4))))
        return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text)

    return _bind(_digits(m), made)


def _phone(key: str, m: Column) -> Column:
    """The ten last digits; area and exchange keep starting with 2 to 9."""
    def made(all_: Column) -> Column:
        d = F.substring(all_, -10, 10)
        out = feistel(key, "phone", (d.substr(1, 3).cast("int") - 200) * 800 + d.substr(4, 3).cast("int") - 200, d.substr(7, 4).cast("int"), F.lit(640000), F.lit(10000))
        new = _bind(out, lambda o: F.concat((F.floor(o["a"] / 800) + 200).cast("string"), (o["a"] % 800 + 200).cast("string"), _two(o["b"], 4)))
        return _bind(F.concat(all_.substr(F.lit(1), F.length(all_) - 10), new), lambda n: _refill(m, n))

    return _bind(_digits(m), made)


def _world(key: str, m: Column) -> Column:
    def made(all_: Column) -> Column:
        code = F.length(_digits(F.regexp_extract(m, r"\A\+[0-9]{1,3}", 0)))
        rest = all_.substr(code + 1, F.length(all_))
        new = F.concat(all_.substr(F.lit(1), code), permute_digits(key, "world", rest))
        return F.when(F.length(rest).between(7, 12), _bind(new, lambda n: _refill(m, n)))

    return _bind(_digits(m), made)


def _iban(key: str, m: Column) -> Column:
    def made(c: Column) -> Column:
        body = permute_chars(key, "iban", c.substr(F.lit(5), F.length(c)))
        country = c.substr(1, 2)
        new = _bind(body, lambda b: F.concat(country, _two(98 - _mod97(F.concat(b, country, F.lit("00"))), 2), b))
        return F.when(_mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4))) == 1, _bind(new, lambda n: _respaced(m, n)))

    return _bind(F.regexp_replace(m, " ", ""), made)


def _respaced(shape: Column, chars: Column) -> Column:
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        return F.struct(F.concat(acc["s"], F.when((c == " ") | (c == ""), c).otherwise(chars.substr(acc["i"], F.lit(1)))).alias("s"), (acc["i"] + ((c != " ") & (c != "")).cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, put, lambda acc: acc["s"])


def _email(key: str, m: Column) -> Column:
    return F.concat(permute_chars(key, "email", F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]{8,}\z", 0)
    return _bind(value, lambda v: F.concat(m.substr(F.lit(1), F.length(m) - F.length(v)), permute_chars(key, "secret", v)))


#: Kinds in the order in which a found string is tried: name, whole pattern, pseudonym (null: not valid).
KINDS = (
    ("secret", SECRET, _secret), ("email", EMAIL, _email), ("date", DATE, _date), ("address", ADDRESS, _address), ("ssn", SSN, _ssn),
    ("phone", PHONE, _phone), ("world", WORLD, _world), ("card", CARD, _card), ("iban", IBAN, _iban),
)


def pseudonym(key: str, m: Column) -> Column:
    """Struct (kind, text) for a found string; null if it is not valid."""
    out = None
    for kind, pattern, make in KINDS:
        it = m.rlike(rf"\A(?:{pattern})\z")
        made = _bind(make(key, m), _named(kind))
        out = F.when(it, made) if out is None else out.when(it, made)
    return out


def _named(kind: str):  # noqa: ANN202
    return lambda p: F.when(p.isNotNull(), F.struct(F.lit(kind).alias("kind"), p.alias("text")))


def _stretches(c: Column, pattern: str, least: int, valid) -> Column:  # noqa: ANN001
    """Distinct stretches of whole groups of at least ``least`` characters, from every start of ``pattern``, that are valid."""
    longest = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=({pattern}))"), 1))
    # a stretch ends where a group does
    ends = lambda s: F.filter(F.sequence(F.lit(least), F.length(s)), lambda n: ~s.substr(n, F.lit(1)).isin(" ", "-") & s.substr(n + 1, F.lit(1)).isin(" ", "-", ""))
    return F.array_distinct(F.filter(F.flatten(F.transform(longest, lambda s: F.transform(ends(s), lambda n: s.substr(F.lit(1), n)))), valid))


def _valid_card(s: Column) -> Column:
    return _bind(_digits(s), lambda d: F.when(F.length(d) >= 13, luhn_sum(d) % 10 == 0).otherwise(False))


def _valid_iban(s: Column) -> Column:
    return _bind(F.regexp_replace(s, " ", ""), lambda c: F.when(F.length(c) >= 15, _mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4))) == 1).otherwise(False))


def _numbers(c: Column) -> Column:
    """The valid card numbers and IBANs of a text in the order in which one place tries them."""
    cards = F.when(c.rlike(CARD), _stretches(c, CARD, 13, _valid_card)).otherwise(F.array().cast("array<string>"))
    ibans = F.when(c.rlike(IBAN), _stretches(c, IBAN, 15, _valid_iban)).otherwise(F.array().cast("array<string>"))
    right = F.create_map(*[F.lit(x) for n, countries in IBAN_LENGTHS.items() for country in countries.split() for x in (country, n)])
    fits = lambda s: F.coalesce(F.element_at(right, s.substr(1, 2)) == F.length(F.regexp_replace(s, " ", "")), F.lit(False))
    ranked = F.transform(F.concat(cards, ibans), lambda s: F.struct((~fits(s)).cast("int").alias("other"), (-F.length(s)).alias("n"), s.alias("s")))
    return F.transform(F.array_sort(ranked), lambda r: r["s"])


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces ``text`` and adds n_pii (values replaced) and kinds (sorted, distinct, comma-joined)."""
    kept = [c for c in docs.columns if c not in ("n_pii", "kinds")]
    numbers, pattern, found, new = (fresh(docs, n) for n in ("_numbers", "_pattern", "_found", "_new"))
    c = F.col(f"`{text}`")
    out = docs.select(*[F.col(f"`{k}`") for k in kept], F.when(c.rlike("[0-9]"), _numbers(c)).alias(numbers))
    # the numbers consist of letters, digits, blanks and hyphens, which stand for themselves in a pattern
    own = F.concat(F.lit(PATTERN + "|(?<![A-Za-z0-9])(?:"), F.array_join(numbers, "|"), F.lit(")(?![A-Za-z0-9])"))
    out = out.withColumn(pattern, F.when(F.size(numbers) > 0, own).when(c.rlike("[0-9@=:]") & c.rlike(PATTERN), F.lit(PATTERN)))
    out = out.withColumn(found, F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(c, F.col(pattern), F.lit(0))))
    made = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(key, m).alias("made")))
    out = out.withColumn(new, made)
    joined = F.array_join(F.flatten(F.zip_with(F.split(c, F.col(pattern), -1), new, lambda piece, m: F.array(piece, F.coalesce(m["made"]["text"], m["old"], F.lit(""))))), "")
    valid = F.filter(F.transform(new, lambda m: m["made"]["kind"]), lambda k: k.isNotNull())
    # numbers, pattern, found and new are each used more than once, so the optimizer computes them once in projections of their own
    return out.select(
        *[F.when(F.size(found) > 0, joined).otherwise(c).alias(text) if k == text else F.col(f"`{k}`") for k in kept],
        F.coalesce(F.when(F.col(new).isNotNull(), F.size(valid)), F.lit(0)).cast("long").alias("n_pii"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(valid)), ","), F.lit("")).alias("kinds"),
    )
