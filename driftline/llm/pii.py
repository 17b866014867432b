"""Personal data: format-preserving pseudonyms of validated numbers and dates.

Candidates are found by one pattern, checked (Luhn digits of payment cards, remainders of
IBANs, ranges of phone numbers, social security numbers, IPv4 addresses and calendar days,
forms of mail addresses and of hexadecimal keys), and what stands the check is replaced by
another valid value of the same format. What fails it stays as it is.

The value without its separators is split into two halves, and ROUNDS Feistel rounds add a
keyed hash of one half to the other, in turn. A half is a whole number below a modulus
(numbers and dates) or a string whose characters move within their class (mail names, IBAN
accounts, keys), so a round is undone by subtracting, the permutation is one-to-one on the
valid values, and a value has the same pseudonym wherever and however it is written: equal
values stay linked across documents. restore() undoes it with the key.

    card    13 to 19 digits, plain or grouped; the first digit stays, the last is computed
    phone   North American numbers, also bare: area and exchange stay in 2-9xx; others after + keep 3 digits
    ssn     area, group and serial within what is issued
    ipv4    first number 1 to 223
    date    1900 to 2084, as Y-M-D, Y/M/D, D.M.Y, M/D/Y, or D/M/Y if the day is beyond 12
    iban    country and length stay, check digits are computed
    email   the name before @; the domain stays
    key     32, 40 or 64 hexadecimal digits in one case, letters and digits both

Days written with two digits each move among all 67571 = 197 * 343 days. If month or day has
one digit, or the date can be read as D/M/Y only, a day moves among those of the same widths
and reading, so that it takes as many characters: year and day of the year are the halves, and
29 February, which few years have, moves among leap years. Such a day need not be linked with
the same day in other widths. A key that the rounds leave without letters or without digits
goes through them again until it has both; three such passes in a row, at odds below 10^-19, end that.
After +1 only North American numbers are valid.

A number ends where a character other than A-Z, a-z, 0-9 stands; longer runs are no match.
All is done with SQL functions in the row: no shuffle, no Python.

Defined cases: a null text stays null with no finds; empty texts stay empty; very long texts
are read whole; repeated rows are changed alike; an empty table gives an empty result; other
columns are kept, but those named like the counts, which are replaced. Groups joined by single
spaces are taken from the left. The key is a parameter and part of the plan: give a secret one.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

ROUNDS = 8
KEY = "not a secret: give your own"
KINDS = ("card", "phone", "ssn", "ipv4", "date", "iban", "email", "key")

_TAIL = "[0-9A-Za-z]*"
#: Candidates, the first that fits from the left; an alphanumeric before or behind is taken along, so that the check refuses it.
CANDIDATE = "|".join((
    r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){1,8}",
    r"[A-Za-z]?[0-9a-fA-F]{32,}" + _TAIL,
    r"(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}" + _TAIL,
    r"\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}" + _TAIL,
    r"\+[0-9]{8,15}" + _TAIL,
    r"[0-9A-Za-z]?[0-9]{4}(?: [0-9]{4}){3}" + _TAIL,
    r"[0-9A-Za-z]?[0-9]{4} [0-9]{6} [0-9]{5}" + _TAIL,
    r"[0-9A-Za-z]?[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?" + _TAIL,
    r"[A-Za-z]{0,3}[0-9]" + _TAIL + r"(?:[-./][0-9A-Za-z]+){0,40}",
))

#: The same for Java, without going back in mail names that end without @.
_FAST = CANDIDATE.replace("{1,64}@", "{1,64}+@")

#: What a whole candidate must look like, before the arithmetic checks.
FORMS = {
    "email": r"^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,63}$",
    "key": r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$",
    "phone": r"^(\+?1[ .-]?)?\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[-. ][0-9]{4}$|^(1-)?[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}$|^(1\.)?[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4}$|^[2-9][0-9]{2}[2-9][0-9]{6}$|^\+[1-9][0-9 .-]*$",
    "card": r"^[1-9][0-9]{12,18}$|^[1-9][0-9]{3}( [0-9]{4}){3}$|^[1-9][0-9]{3}(-[0-9]{4}){3}$|^[1-9][0-9]{3}( [0-9]{6} |-[0-9]{6}-)[0-9]{5}$",
    "ssn": r"^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$",
    "ipv4": r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "date": r"^(19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}(T[0-9]{2})?$|^(19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}$|^[0-9]{1,2}\.[0-9]{1,2}\.(19|20)[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/(19|20)[0-9]{2}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$|^[A-Z]{2}[0-9]{2}( [0-9A-Z]{4}){2,7}( [0-9A-Z]{1,3})?$",
}
LAST_YEAR, DATE_P, DATE_Q = 2084, 197, 343
NANP = "^1[2-9][0-9]{2}[2-9][0-9]{6}$"

#: Dates that are read as D/M/Y, and those whose month or day has one digit.
DAY_FIRST = "^(1[3-9]|[23][0-9])/"
SHORT_MONTH = "^[0-9]{4}[-/][0-9][-/]|[.][0-9][.]|^[0-9]/"
SHORT_DAY = "^[0-9]{4}[-/][0-9]{1,2}[-/][0-9](T|$)|^[0-9][.]|^[0-9]{1,2}/[0-9]/"
YEARS, LEAP_P, LEAP_Q = LAST_YEAR - 1899, 2, 23


def _days(last_month: int, first: int, last: int) -> list[int]:
    """The days of an ordinary year within the bounds, as month * 100 + day."""
    year = (datetime.date(2001, 1, 1) + datetime.timedelta(n) for n in range(365))
    return [t.month * 100 + t.day for t in year if t.month <= last_month and first <= t.day <= last]


#: Days by widths and reading; dates with both widths 2 are in none.
DAYS = {"day first, short month": _days(9, 13, 31), "day first": _days(12, 13, 31), "short both": _days(9, 1, 9), "short month": _days(9, 1, 31), "short day": _days(12, 1, 9)}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with value bound to name, so that it is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _luhn(digits: str) -> str:
    """The Luhn sum of a string of digits, the last being the check digit."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + case when i % 2 = 0 then {d} when {d} > 4 then 2 * {d} - 9 else 2 * {d} end)"


def _mod97(chars: str) -> str:
    """The remainder of letters and digits read as a number, A being 10."""
    step = "case when c between '0' and '9' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end"
    return f"aggregate(filter(split({chars}, ''), c -> c <> ''), 0, (s, c) -> {step})"


def _part(c: str, i: int) -> str:
    """The i-th of three numbers of a date, or of four of an address."""
    return f"cast(split(regexp_replace({c}, 'T.*', ''), '[-./]')[{i}] as int)"


def _order(m: str) -> tuple[str, str, str]:
    """Where year, month and day stand: 0, 1 or 2."""
    iso, day_first = f"{m} rlike '^[0-9]{{4}}'", f"({m} like '%.%' or {m} rlike '{DAY_FIRST}')"
    return f"case when {iso} then 0 else 2 end", f"case when {iso} or {day_first} then 1 else 0 end", f"case when {iso} then 2 when {day_first} then 0 else 1 end"


def _widths(matches) -> str:
    """The class of DAYS of a date, '' if none; matches(pattern) tests the date in SQL."""
    return f"""case when {matches(DAY_FIRST)} then case when {matches('/[0-9]/')} then 'day first, short month' else 'day first' end
      when {matches(SHORT_MONTH)} then case when {matches(SHORT_DAY)} then 'short both' else 'short month' end when {matches(SHORT_DAY)} then 'short day' else '' end"""


def _valid(kind: str) -> str:
    """The arithmetic check of candidate m; its digits are d, its letters and digits w."""
    if kind == "card":
        return f"{_luhn('d')} % 10 = 0"
    if kind == "iban":
        return f"length(w) between 15 and 34 and {_mod97('substr(w, 5) || substr(w, 1, 4)')} = 1"
    if kind == "key":
        return "m rlike '[a-fA-F]' and m rlike '[0-9]'"
    if kind == "phone":
        return f"m not like '+%' or case when d like '1%' then d rlike '{NANP}' else length(d) between 8 and 15 end"
    if kind == "ssn":
        return "substr(m, 1, 3) not in ('000', '666') and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'"
    if kind == "ipv4":
        return f"{_part('m', 0)} between 1 and 223 and greatest({_part('m', 1)}, {_part('m', 2)}, {_part('m', 3)}) < 256 and not m rlike '(^|\\\\.)0[0-9]'"
    if kind == "date":
        parts = "split(regexp_replace(m, 'T.*', ''), '[-./]')"
        y, mo, day = (f"cast({parts}[{at}] as int)" for at in _order("m"))
        leap = f"({y} % 4 = 0 and ({y} % 100 <> 0 or {y} % 400 = 0))"
        days = f"case when {mo} in (4, 6, 9, 11) then 30 when {mo} = 2 and {leap} then 29 when {mo} = 2 then 28 else 31 end"
        return f"{y} <= {LAST_YEAR} and {mo} between 1 and 12 and {day} between 1 and {days}"
    return "true"


def _kind() -> str:
    return "case " + " ".join(f"when m rlike {_quoted(form)} and ({_valid(kind)}) then '{kind}'" for kind, form in FORMS.items()) + " end"


def _halves() -> str:
    """struct(a, b, p, q, l, r, tweak): the halves of x as numbers below p and q, or as strings, and what keeps families of values apart."""
    def number(a, b, p, q, tweak="''"):
        return f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint), 'p', cast({p} as bigint), 'q', cast({q} as bigint), 'l', '', 'r', '', 'tweak', {tweak})"

    def text(s, tweak="''"):
        half = f"cast(length({s}) / 2 as int)"
        return f"named_struct('a', 0L, 'b', 0L, 'p', 1L, 'q', 1L, 'l', substr({s}, 1, {half}), 'r', substr({s}, {half} + 1), 'tweak', {tweak})"

    def digits(s, tweak):
        half = f"cast(length({s}) / 2 as int)"
        return number(f"substr({s}, 1, {half})", f"substr({s}, {half} + 1)", f"pow(10, {half})", f"pow(10, length({s}) - {half})", tweak)

    ten = "right(x.d, 10)"
    y, mo, d = (f"cast(x.parts[{at}] as int)" for at in _order("x.m"))
    day = f"datediff(make_date({y}, {mo}, {d}), date'1900-01-01')"
    leap = f"({y} - 1904) div 4"
    narrow = " ".join(f"when cls = '{name}' then {number(f'{y} - 1900', f'array_position(array({str(days)[1:-1]}), {mo} * 100 + {d}) - 1', YEARS, len(days), 'cls')}" for name, days in DAYS.items())
    date = _let("cls", _widths(lambda p: f"x.m rlike '{p}'"), f"""case when cls = '' then {number(f"floor({day} / {DATE_Q})", f"{day} % {DATE_Q}", DATE_P, DATE_Q)}
      when {mo} = 2 and {d} = 29 then {number(f"{leap} div {LEAP_Q}", f"{leap} % {LEAP_Q}", LEAP_P, LEAP_Q, "cls || ' leap'")} {narrow} end""")
    area = "cast(substr(x.m, 1, 3) as int)"
    return f"""case x.kind
      when 'card' then {digits("substr(x.d, 2, length(x.d) - 2)", "substr(x.d, 1, 1) || length(x.d)")}
      when 'phone' then case when x.nanp then {number(f"cast(left({ten}, 3) as int) - 200", f"cast(right({ten}, 7) as int) - 2000000", 800, 8000000)}
                             else {digits("substr(x.d, 4)", "substr(x.d, 1, 3) || length(x.d)")} end
      when 'ssn' then {number(f"{area} - 1 - case when {area} > 666 then 1 else 0 end", "(cast(substr(x.m, 5, 2) as int) - 1) * 9999 + cast(substr(x.m, 8) as int) - 1", 898, 99 * 9999)}
      when 'ipv4' then {number(f"{_part('x.m', 0)} - 1", f"({_part('x.m', 1)} * 256 + {_part('x.m', 2)}) * 256 + {_part('x.m', 3)}", 223, 256**3)}
      when 'date' then {date}
      when 'iban' then {text("substr(x.w, 5)", "substr(x.w, 1, 2)")}
      when 'email' then {text("substring_index(x.m, '@', 1)", "lower(substring_index(x.m, '@', -1))")}
      when 'key' then {text("x.m")} end"""


def _shifted(s: str, half: str, sign: str) -> str:
    """String s with each character moved on within its class, by four hexadecimal digits of the hash of the other half."""
    hashed = f"sha2(concat_ws('|', key, 0, x.kind, x.h.tweak, i, length({s}), {half}), 256) || sha2(concat_ws('|', key, 1, x.kind, x.h.tweak, i, length({s}), {half}), 256)"
    by = f"{sign} cast(conv(substr(h, 4 * j - 3, 4), 16, 10) as int)"

    def within(first: str, n: int) -> str:
        return f"chr(pmod(ascii(c) - ascii('{first}') {by}, {n}) + ascii('{first}'))"

    hexa = f"substr(x.digits, pmod(instr(x.digits, c) - 1 {by}, 16) + 1, 1)"
    moved = f"case when x.kind = 'key' then {hexa} when c between '0' and '9' then {within('0', 10)} when c between 'a' and 'z' then {within('a', 26)} when c between 'A' and 'Z' then {within('A', 26)} else c end"
    each = f"array_join(transform(sequence(1, length({s})), j -> {_let('c', f'substr({s}, j, 1)', moved)}), '')"
    return f"case when {s} = '' then '' else {_let('h', hashed, each)} end"


def _rounds(inverse: bool) -> str:
    """struct(a, b, l, r) after all rounds: even ones change a and l, odd ones b and r."""
    sign, order = ("-", f"sequence({ROUNDS - 1}, 0)") if inverse else ("+", f"sequence(0, {ROUNDS - 1})")

    def moved(own: str, other: str, modulus: str) -> str:
        return f"pmod(s.{own} {sign} cast(conv(substr(sha2(concat_ws('|', key, x.kind, x.h.tweak, i, s.{other}), 256), 1, 15), 16, 10) as bigint), x.h.{modulus})"

    state = "named_struct('a', {}, 'b', {}, 'l', {}, 'r', {})"
    even = state.format(moved("a", "b", "p"), "s.b", _shifted("s.l", "s.r", sign), "s.r")
    odd = state.format("s.a", moved("b", "a", "q"), "s.l", _shifted("s.r", "s.l", sign))
    once = f"aggregate({order}, t, (s, i) -> case when i % 2 = 0 then {even} else {odd} end)"
    done = "n > 1 and (x.kind <> 'key' or (t.l || t.r) rlike '[a-fA-F]' and (t.l || t.r) rlike '[0-9]')"
    return f"aggregate(sequence(1, 3), {state.format('x.h.a', 'x.h.b', 'x.h.l', 'x.h.r')}, (t, n) -> case when {done} then t else {once} end)"


def _filled(chars: str) -> str:
    """The candidate with its letters and digits replaced, in order, by those of chars."""
    at = "length(regexp_replace(substr(x.m, 1, j), '[^0-9A-Za-z]', ''))"
    return f"array_join(transform(sequence(1, length(x.m)), j -> case when substr(x.m, j, 1) rlike '[0-9A-Za-z]' then substr({chars}, {at}, 1) else substr(x.m, j, 1) end), '')"


def _written() -> str:
    """The new value y of x in the format of the old."""
    def padded(n, modulus):
        return f"case when {modulus} = 1 then '' else lpad(cast({n} as string), length(cast({modulus} as string)) - 1, '0') end"

    middle = f"{padded('x.y.a', 'x.h.p')} || {padded('x.y.b', 'x.h.q')}"
    card = _let("body", f"substr(x.d, 1, 1) || {middle}", _let("n", "body || cast((10 - " + _luhn("(body || '0')") + " % 10) % 10 as string)", _filled("n")))
    nanp = "left(x.d, length(x.d) - 10) || cast(x.y.a + 200 as string) || cast(x.y.b + 2000000 as string)"
    phone = _let("n", f"case when x.nanp then {nanp} else substr(x.d, 1, 3) || {middle} end", _filled("n"))
    area = "cast(x.y.a + 1 + case when x.y.a + 1 > 665 then 1 else 0 end as string)"
    ssn = f"lpad({area}, 3, '0') || '-' || lpad(cast(x.y.b div 9999 + 1 as string), 2, '0') || '-' || lpad(cast(x.y.b % 9999 + 1 as string), 4, '0')"
    ipv4 = "concat_ws('.', x.y.a + 1, x.y.b div 65536, x.y.b div 256 % 256, x.y.b % 256)"
    y, mo, day = _order("x.m")
    new = f"array(case ({y}) when 0 then year(t) when 2 then case when ({mo}) = 0 then month(t) else day(t) end end, case when ({mo}) = 1 then month(t) else day(t) end, case when ({y}) = 2 then year(t) else day(t) end)"
    each = "transform(n, (v, k) -> lpad(cast(v as string), greatest(length(x.parts[k]), length(cast(v as string))), '0'))"
    mark = "case when x.m like '%-%' then '-' when x.m like '%.%' then '.' else '/' end"
    narrow = " ".join(f"when x.h.tweak = '{name}' then {_let('md', f'array({str(days)[1:-1]})[cast(x.y.b as int)]', 'make_date(cast(x.y.a + 1900 as int), md div 100, md % 100)')}" for name, days in DAYS.items())
    moved = f"case when x.h.tweak = '' then date_add(date'1900-01-01', cast(x.y.a * {DATE_Q} + x.y.b as int)) {narrow} else make_date(cast(1904 + 4 * (x.y.a * {LEAP_Q} + x.y.b) as int), 2, 29) end"
    date = _let("t", moved, f"array_join({_let('n', new, each)}, {mark}) || case when x.m like '%T%' then right(x.m, 3) else '' end")
    account = "x.y.l || x.y.r"
    remainder = _mod97(f"({account} || left(x.w, 2) || '00')")
    iban = _let("n", f"left(x.w, 2) || lpad(cast(98 - {remainder} as string), 2, '0') || {account}", _filled("n"))
    return f"""case x.kind when 'card' then {card} when 'phone' then {phone} when 'ssn' then {ssn} when 'ipv4' then {ipv4} when 'date' then {date}
      when 'iban' then {iban} when 'email' then x.y.l || x.y.r || '@' || substring_index(x.m, '@', -1) when 'key' then x.y.l || x.y.r end"""


def _changed(docs: DataFrame, key: str, inverse: bool) -> DataFrame:
    counts = [f"n_{kind}" for kind in KINDS]
    out = docs.drop("n_pseudonyms", *counts)
    columns = out.columns
    own = F.struct(*[F.col(c) if c != "text" else F.col(c).cast("string").alias(c) for c in columns])
    df = out.select(own.alias("row")).withColumn("found", F.expr(f"case when row.text rlike '[0-9@]' then regexp_extract_all(row.text, {_quoted(_FAST)}, 0) when row.text is not null then array() end"))
    nanp = "(m not like '+%' or d like '1%')"
    parts = "split(regexp_replace(m, 'T.*', ''), '[-./]')"
    judged = "named_struct('m', m, 'd', d, 'w', w, 'kind', " + _kind() + f", 'nanp', {nanp}, 'parts', {parts}, 'digits', case when m rlike '[A-F]' then '0123456789ABCDEF' else '0123456789abcdef' end)"
    df = df.withColumn("found", F.expr("transform(found, m -> " + _let("d", "regexp_replace(m, '[^0-9]', '')", _let("w", "regexp_replace(m, '[^0-9A-Z]', '')", judged)) + ")"))
    fields = "'m', x.m, 'd', x.d, 'w', x.w, 'kind', x.kind, 'nanp', x.nanp, 'parts', x.parts, 'digits', x.digits"
    df = df.withColumn("found", F.expr(f"transform(found, x -> named_struct({fields}, 'h', {_halves()}))"))
    rounds = _rounds(inverse).replace("key,", _quoted(key) + ",")
    df = df.withColumn("found", F.expr(f"transform(found, x -> named_struct({fields}, 'h', x.h, 'y', case when x.kind is not null then {rounds} end))"))
    df = df.withColumn("found", F.expr(f"transform(found, x -> named_struct('kind', x.kind, 'm', coalesce({_written()}, x.m)))"))
    gaps = f"split(row.text, {_quoted(_FAST)}, -1)"
    text = F.expr(f"case when not exists(found, x -> x.kind is not null) then row.text else array_join(zip_with({gaps}, found, (g, x) -> g || coalesce(x.m, '')), '') end")
    number = {k: F.coalesce(F.expr(f"size(filter(found, x -> x.kind = '{k}'))"), F.lit(0)).cast("long") for k in KINDS}
    total = F.when(F.col("found").isNull(), 0).otherwise(F.expr("size(filter(found, x -> x.kind is not null))")).cast("long")
    known = F.col("found").isNotNull()
    return df.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in columns],
        total.alias("n_pseudonyms"),
        *[F.when(known, number[k]).otherwise(0).cast("long").alias(f"n_{k}") for k in KINDS],
    )


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with pseudonyms in `text`, their number n_pseudonyms, and that of each kind (n_card, n_phone, ...)."""
    return _changed(docs, key, inverse=False)


def restore(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The texts before pseudonymise() with the same key."""
    return _changed(docs, key, inverse=True)


def op1_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql(key: str = KEY) -> str:
    """The same rows by DuckDB: a row per candidate, a table per round."""
    def re(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def match(kind: str) -> str:
        return f"regexp_matches(m, {re(FORMS[kind])})"

    def luhn(d: str) -> str:
        x = f"({d})[len({d}) - i]::INT"
        return f"list_sum(list_transform(range(0, len({d})), lambda i: CASE WHEN i % 2 = 0 THEN {x} WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END))"

    def mod97(w: str) -> str:
        return f"(list_reduce(list_transform(string_split({w}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN [10, c::INT] ELSE [100, ascii(c) - 55] END), lambda s, c: [0, (s[2] * c[1] + c[2]) % 97], [0, 0]))[2]"

    kinds = {
        "email": "true", "key": "regexp_matches(m, '[a-fA-F]') AND regexp_matches(m, '[0-9]')", "phone": f"m[1] <> '+' OR CASE WHEN d[1] = '1' THEN regexp_matches(d, '{NANP}') ELSE len(d) BETWEEN 8 AND 15 END", "card": f"{luhn('d')} % 10 = 0",
        "ssn": "m[1:3] NOT IN ('000', '666') AND m[5:6] <> '00' AND m[8:11] <> '0000'",
        "ipv4": "c[1]::INT BETWEEN 1 AND 223 AND greatest(c[2]::INT, c[3]::INT, c[4]::INT) < 256 AND NOT regexp_matches(m, '(^|[.])0[0-9]')",
        "date": f"try_cast(c[yy] || '-' || c[mm] || '-' || c[dd] AS DATE) IS NOT NULL AND c[yy]::INT <= {LAST_YEAR}", "iban": f"len(w) BETWEEN 15 AND 34 AND {mod97('w[5:] || w[1:4]')} = 1",
    }
    case = " ".join(f"WHEN {match(k)} THEN CASE WHEN {kinds[k]} THEN '{k}' END" for k in ("email", "key", "phone", "ssn", "ipv4", "date"))
    case = f"CASE {case} WHEN {match('card')} AND {kinds['card']} THEN 'card' WHEN {match('iban')} AND {kinds['iban']} THEN 'iban' END"
    body = "CASE kind WHEN 'email' THEN split_part(m, '@', 1) WHEN 'key' THEN m WHEN 'iban' THEN w[5:] WHEN 'card' THEN d[2:len(d) - 1] WHEN 'phone' THEN d[4:] END"
    day = "date_diff('day', DATE '1900-01-01', (c[yy] || '-' || c[mm] || '-' || c[dd])::DATE)"
    numeric = "kind = 'card' OR kind = 'phone' AND NOT nanp"
    area = "m[1:3]::INT"
    year, md, leap = "c[yy]::INT", "(c[mm]::INT * 100 + c[dd]::INT)", "((c[yy]::INT - 1904) // 4)"
    days = "CASE cls " + " ".join(f"WHEN '{name}' THEN {listed}" for name, listed in DAYS.items()) + " END"
    is_leap, narrow = f"kind = 'date' AND cls <> '' AND {md} = 229", "kind = 'date' AND cls <> ''"
    a = f"CASE WHEN {numeric} THEN (s[1:len(s) // 2])::BIGINT WHEN kind = 'phone' THEN right(d, 10)[1:3]::INT - 200 WHEN kind = 'ssn' THEN {area} - 1 - ({area} > 666)::INT WHEN kind = 'ipv4' THEN c[1]::INT - 1 WHEN {is_leap} THEN {leap} // {LEAP_Q} WHEN {narrow} THEN {year} - 1900 WHEN kind = 'date' THEN {day} // {DATE_Q} END"
    b = f"CASE WHEN {numeric} THEN (s[len(s) // 2 + 1:])::BIGINT WHEN kind = 'phone' THEN right(d, 7)::INT - 2000000 WHEN kind = 'ssn' THEN (m[5:6]::INT - 1) * 9999 + m[8:11]::INT - 1 WHEN kind = 'ipv4' THEN c[2]::INT * 65536 + c[3]::INT * 256 + c[4]::INT WHEN {is_leap} THEN {leap} % {LEAP_Q} WHEN {narrow} THEN list_position({days}, {md}) - 1 WHEN kind = 'date' THEN {day} % {DATE_Q} END"
    p = f"CASE WHEN {numeric} THEN 10 ** (len(s) // 2) WHEN kind = 'phone' THEN 800 WHEN kind = 'ssn' THEN 898 WHEN kind = 'ipv4' THEN 223 WHEN {is_leap} THEN {LEAP_P} WHEN {narrow} THEN {YEARS} ELSE {DATE_P} END"
    q = f"CASE WHEN {numeric} THEN 10 ** (len(s) - len(s) // 2) WHEN kind = 'phone' THEN 8000000 WHEN kind = 'ssn' THEN {99 * 9999} WHEN kind = 'ipv4' THEN {256**3} WHEN {is_leap} THEN {LEAP_Q} WHEN {narrow} THEN len({days}) ELSE {DATE_Q} END"
    tweak = f"CASE WHEN {is_leap} THEN cls || ' leap' WHEN kind = 'date' THEN cls WHEN kind = 'card' THEN d[1] || len(d) WHEN kind = 'phone' AND NOT nanp THEN d[1:3] || len(d) WHEN kind = 'iban' THEN w[1:2] WHEN kind = 'email' THEN lower(split_part(m, '@', 2)) ELSE '' END"
    rounds = ""
    for i in range(ROUNDS):
        x, y, modulus, u, v = ("a", "b", "p", "l", "r") if i % 2 == 0 else ("b", "a", "q", "r", "l")
        number = f"({x} + ('0x' || sha256(concat_ws('|', {re(key)}, kind, tweak, {i}, {y}))[1:15])::BIGINT) % {modulus}"
        h = "||".join(f"sha256(concat_ws('|', {re(key)}, {n}, kind, tweak, {i}, len({u}), {v}))" for n in (0, 1))
        by = "('0x' || h[4 * j - 3:4 * j])::INT"
        letters = [(f"x[j] BETWEEN '{lo}' AND '{hi}'", lo, n) for lo, hi, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26))]
        hexa = f"hexes[(strpos(hexes, x[j]) - 1 + {by}) % 16 + 1]"
        step = f"CASE WHEN kind = 'key' THEN {hexa} " + " ".join(f"WHEN {cond} THEN chr((ascii(x[j]) - {ord(lo)} + {by}) % {n} + {ord(lo)})" for cond, lo, n in letters) + " ELSE x[j] END"
        rounds += f""",
h{i} AS (SELECT *, {u} AS x, {h} AS h FROM r{i}),
r{i + 1} AS (SELECT * EXCLUDE (x, h) REPLACE ({number} AS {x}, coalesce(array_to_string(list_transform(range(1, len({u}) + 1), lambda j: {step}), ''), '') AS {u}) FROM h{i})"""

    def filled(n: str) -> str:
        return f"array_to_string(list_transform(range(1, len(m) + 1), lambda j: CASE WHEN regexp_matches(m[j], '[0-9A-Za-z]') THEN ({n})[len(regexp_replace(m[1:j], '[^0-9A-Za-z]', '', 'g'))] ELSE m[j] END), '')"

    mark = "CASE WHEN contains(m, '-') THEN '-' WHEN contains(m, '.') THEN '.' ELSE '/' END"
    middle = "lpad(a::VARCHAR, (len(s) // 2)::INT, '0') || lpad(b::VARCHAR, (len(s) - len(s) // 2)::INT, '0')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, {re(CANDIDATE)}) AS ms, string_split_regex(text, {re(CANDIDATE)}) AS gaps FROM documents),
e AS (SELECT rid, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m FROM t),
f AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, regexp_replace(m, '[^0-9A-Z]', '', 'g') AS w, string_split_regex(regexp_replace(m, 'T.*', ''), '[-./]') AS c,
  CASE WHEN regexp_matches(m, '^[0-9]{{4}}') THEN 1 ELSE 3 END AS yy, CASE WHEN regexp_matches(m, '^[0-9]{{4}}') OR contains(m, '.') OR regexp_matches(m, '{DAY_FIRST}') THEN 2 ELSE 1 END AS mm,
  CASE WHEN regexp_matches(m, '^[0-9]{{4}}') THEN 3 WHEN contains(m, '.') OR regexp_matches(m, '{DAY_FIRST}') THEN 1 ELSE 2 END AS dd FROM e),
g AS (SELECT *, {case} AS kind, m[1] <> '+' OR d[1] = '1' AS nanp, {_widths(lambda p: f"regexp_matches(m, '{p}')")} AS cls, CASE WHEN regexp_matches(m, '[A-F]') THEN '0123456789ABCDEF' ELSE '0123456789abcdef' END AS hexes FROM f),
s AS (SELECT *, {body} AS s FROM g WHERE kind IS NOT NULL),
r0 AS (SELECT *, {a} AS a, {b} AS b, ({p})::BIGINT AS p, ({q})::BIGINT AS q, {tweak} AS tweak,
  CASE WHEN kind IN ('email', 'key', 'iban') THEN s[1:len(s) // 2] ELSE '' END AS l, CASE WHEN kind IN ('email', 'key', 'iban') THEN s[len(s) // 2 + 1:] ELSE '' END AS r FROM s){rounds},
n AS (SELECT *, CASE kind WHEN 'card' THEN d[1] || {middle} WHEN 'phone' THEN CASE WHEN nanp THEN d[1:len(d) - 10] || (a + 200) || (b + 2000000) ELSE d[1:3] || {middle} END
  WHEN 'ssn' THEN lpad((a + 1 + (a + 1 > 665)::INT)::VARCHAR, 3, '0') || lpad((b // 9999 + 1)::VARCHAR, 2, '0') || lpad((b % 9999 + 1)::VARCHAR, 4, '0')
  WHEN 'iban' THEN w[1:2] || lpad((98 - {mod97("(l || r || w[1:2] || '00')")})::VARCHAR, 2, '0') || l || r END AS new, CASE WHEN kind <> 'date' THEN DATE '1900-01-01' WHEN tweak = '' THEN DATE '1900-01-01' + (a * {DATE_Q} + b)::INT
  WHEN tweak = cls THEN make_date(1900 + a, ({days})[b + 1] // 100, ({days})[b + 1] % 100) ELSE make_date(1904 + 4 * (a * {LEAP_Q} + b), 2, 29) END AS new_day FROM r{ROUNDS}),
o AS (SELECT rid, k, kind, CASE kind WHEN 'card' THEN {filled("new || ((10 - " + luhn("(new || '0')") + " % 10) % 10)")} WHEN 'ipv4' THEN concat_ws('.', a + 1, b // 65536, b // 256 % 256, b % 256)
  WHEN 'date' THEN lpad(x[1], greatest(len(x[1]), len(c[1]))::INT, '0') || {mark} || lpad(x[2], greatest(len(x[2]), len(c[2]))::INT, '0') || {mark} || lpad(x[3], greatest(len(x[3]), len(c[3]))::INT, '0') || CASE WHEN contains(m, 'T') THEN right(m, 3) ELSE '' END
  WHEN 'email' THEN l || r || '@' || split_part(m, '@', 2) WHEN 'key' THEN l || r ELSE {filled('new')} END AS y
  FROM (SELECT *, CASE WHEN yy = 1 THEN [year(new_day)::VARCHAR, month(new_day)::VARCHAR, day(new_day)::VARCHAR] WHEN mm = 2 THEN [day(new_day)::VARCHAR, month(new_day)::VARCHAR, year(new_day)::VARCHAR] ELSE [month(new_day)::VARCHAR, day(new_day)::VARCHAR, year(new_day)::VARCHAR] END AS x FROM n) z),
j AS (SELECT rid, list(coalesce(y, m) ORDER BY k) AS l, count(kind) AS n_pseudonyms{''.join(f", count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)} FROM e LEFT JOIN o USING (rid, k) GROUP BY rid)
SELECT doc_id, CASE WHEN coalesce(n_pseudonyms, 0) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(l[i], '')), '') END AS text,
  coalesce(n_pseudonyms, 0) AS n_pseudonyms{''.join(f", coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)} FROM t LEFT JOIN j USING (rid)
"""


OP1_SQL = _sql()
