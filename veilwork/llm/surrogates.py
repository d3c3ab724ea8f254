"""Surrogates for personal data: keyed, type-consistent replacements that keep distinctness and coreference.

Entities (e-mail addresses, phone, card, account (IBAN), passport, social security and national id numbers, IP and MAC
addresses, birth dates, secrets, person names) are found by one pattern. A mention is split into pieces; pieces that identify someone are replaced, the others (titles, country
codes, top-level domains, key names) stay. A piece's surrogate is drawn from a keyed digest of its kind and canonical
form (case and separators aside), so all mentions of one entity get one surrogate in every document, each in its own
spelling: digits are poured into the mention's format, case follows the mention. Names keep gender and script; card
numbers keep their issuer digit and pass the Luhn test exactly if the original does; account numbers keep their country
and, like national ids with a control letter, their checks hold exactly if the original's do. Birth dates become dates
that are valid in either order of day and month. Private keys keep their frame, tokens their prefix.

Collisions: two entities of a kind with the same surrogate, or a surrogate that is itself an entity found in the
documents, are drawn again with the next attempt number until none is left. Case does not tell surrogates apart. Local
parts are compared as whole addresses, and never stay as they are. Spaces widen with the attempt number, so there are
always enough: names get more list entries, other forms more characters, private addresses the other private ranges, then
all addresses, then those of version 6. Forms without a letter or digit are drawn as letters.

All steps are DataFrame operations. Only documents with an entity meet the entity table; the others pass through.
Null texts stay null. Repeated rows are treated alike. Surrogates depend on the key and on the entities found, never on
the order of rows. An empty table gives an empty result. Other columns are not looked at. Texts of any length are read in
linear time and bounded stack: addresses have up to 64 characters before the sign and 127 labels, private keys up to 16,384
characters or 400 lines; of longer ones the part within these bounds is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import cell, hot_join
from veilwork.session import cut_lineage

#: Given names by gender and script, family names by script, titles by gender.
GIVEN = {
    "f:latin": "Anna Maria Emma Julia Laura Sarah Lisa Elena Sofia Clara Alice Marie Camille Claire Ingrid Helga Carmen Lucia Pilar Isabel Mary Linda Susan Karen Nancy Emily Grace Olivia Charlotte Hannah",
    "m:latin": "John James Robert Michael David Thomas Daniel Peter Paul Mark Hans Klaus Stefan Jürgen Pierre Jean Luc Antoine Carlos Juan Miguel Pedro Diego Javier Henry George Edward Oliver William Jacob",
    "f:cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Ксения Полина Вера Надежда",
    "m:cyrillic": "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел Олег Виктор Юрий Борис Фёдор",
}
FAMILY = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Clark Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schulz Martin Bernard Dubois Laurent Lefebvre Moreau Girard Garcia Rodriguez Martinez Lopez Gonzalez Perez Sanchez Ramirez Torres Flores Rivera Morales Ortiz",
    "cyrillic": "Иванов Петров Сидоров Смирнов Кузнецов Попов Васильев Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов",
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Signora госпожа г-жа", "m": "Mr Herr Monsieur Señor Signor господин г-н"}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _both(lists: dict[str, str]) -> str:
    """All names of the lists, as they are and in capitals."""
    every = " ".join(lists.values())
    return every + " " + every.upper()


_WORD, _LABEL = r"[A-Za-z0-9._%+\-\p{L}\p{M}\p{N}]", r"[A-Za-z0-9\-\p{L}\p{M}\p{N}]"
_BEGIN, _END = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", "-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
_DATE = r"(?:(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])[-/.](?:3[01]|[12]\d|0?[1-9])[-/.](?:(?:19|20)\d{2}|\d{2}))"
#: Kept in front of a secret: a key name, and the prefix of a token.
_PREFIX = r"^((?:(?:AKIA|sk-|gsk_|gh[pousr]_|github_pat_|eyJ)(?=.{16})|[a-z+]+://|Bearer\s+|[A-Za-z_-]+\s*[=:]\s*[\"']?(?:(?:AKIA|sk-|gsk_|gh[pousr]_|github_pat_|eyJ)(?=.{16}))?))"
_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"

_TITLE = _any(" ".join(TITLES.values()))
#: Per kind of mention, in the order in which they are tried.
MENTIONS = {
    "email": rf"{_WORD}{{1,64}}+@{_LABEL}++(?:\.{_LABEL}++){{0,126}}\.(?:xn--[A-Za-z0-9-]+|\p{{L}}{{2,}})",
    "pem": rf"{_BEGIN}(?:[A-Za-z0-9+/=:,.\\\s-]{{1,16384}}?{_END}|(?:\s{{1,8}}+[A-Za-z0-9+/=]{{32,}}+){{1,400}}+(?:\s{{1,8}}+[A-Za-z0-9+/]+={{1,2}})?)",
    "secret": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{8,}"
    r"|sk-[A-Za-z0-9_-]{20,}|gsk_[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|eyJ[A-Za-z0-9_-]{10,512}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
    r"|Bearer\s+[A-Za-z0-9_.~+/-]{20,}=*|(?:mongodb(?:\+srv)?|mysql|postgres(?:ql)?|rediss?|amqps?)://[^\s\"'<>]+",
    "dob": rf"(?=[bdgfnBDGFN])(?iu:born|dob|date\s+of\s+birth|birth\s?date|geboren|geb\.|geburtsdatum|née?|date\s+de\s+naissance|fecha\s+de\s+nacimiento|nacid[oa])(?:\s+(?:on|am|le|el))?\s{{0,3}}[:=]?\s{{0,3}}{_DATE}(?!\d)",
    "iban": r"[A-Z]{2}\d{2}(?=(?:[A-Z ]*\d){8})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "passport": r"[A-Z]{1,2}\d{6,9}(?![\p{L}\p{N}])",
    "mac": r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])",
    "nid": r"\d{2}\.\d{2}\.\d{2}\.\d{3}\.\d{3}\.\d{2}(?!\d)|\d{8}-?[A-Z](?![\p{L}\p{N}])|[XYZ]-?\d{7}-?[A-Z](?![\p{L}\p{N}])",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "name": rf"{_TITLE}\.? {_NAME}(?: {_NAME})?|{_any(_both(GIVEN))} {_any(_both(FAMILY))}(?!\p{{L}})",
}
PATTERN = r"(?<![\p{L}\p{N}_])(?:" + "|".join(MENTIONS.values()) + ")"

_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _piece(kind: Column | str, canon: Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"), text.alias("text"))


def _plain(text: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return _piece(nothing, nothing, text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _month_first(date: Column) -> Column:
    """Whether month comes before day: after a year, or if the second number can be no month."""
    return date.rlike(r"^\d{4}") | (F.split(date, "[-/.]")[1].cast("int") > 12)


def _day(date: Column) -> Column:
    """A date as yyyymmdd; years of two digits are those up to 2026."""
    part = F.split(date, "[-/.]")
    year_first = date.rlike(r"^\d{4}")
    year, a, b = F.when(year_first, part[0]).otherwise(part[2]), F.when(year_first, part[1]).otherwise(part[0]), F.when(year_first, part[2]).otherwise(part[1])
    century = F.when(F.length(year) == 4, "").when(year.cast("int") > 26, "19").otherwise("20")
    month, day = F.when(_month_first(date), a).otherwise(b), F.when(_month_first(date), b).otherwise(a)
    return F.concat(century, year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _dated(date: Column, day: Column) -> Column:
    """The day yyyymmdd in the format of a date; years outside 1927 to 2026 have four digits."""
    part, mark = F.split(date, "[-/.]"), F.regexp_extract(date, "([-/.])", 1)
    year = F.when((F.length(part[2]) == 2) & ~date.rlike(r"^\d{4}") & day.between("1927", "2027"), F.substr(day, F.lit(3), F.lit(2))).otherwise(F.substr(day, F.lit(1), F.lit(4)))
    m, d = F.substr(day, F.lit(5), F.lit(2)), F.substr(day, F.lit(7), F.lit(2))
    first, second = F.when(_month_first(date), m).otherwise(d), F.when(_month_first(date), d).otherwise(m)
    wide = lambda n, like: F.when(F.length(like) == 1, n.cast("int").cast("string")).otherwise(n)
    year_first = F.concat(year, mark, wide(first, part[1]), mark, wide(second, part[2]))
    return F.when(date.rlike(r"^\d{4}"), year_first).otherwise(F.concat(wide(first, part[0]), mark, wide(second, part[1]), mark, year))


def pieces_of(m: Column) -> Column:
    """The pieces of a mention; those without a kind stay as they are."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.array(_piece("local", F.lower(m), local), _plain(F.lit("@")), _piece("domain", F.lower(labels), labels), _plain(top))
    named = F.regexp_extract(m, _PREFIX, 1)
    value = F.substr(m, F.length(named) + 1)
    # hexadecimal digits in capitals are the same secret
    secret = F.array(_plain(named), _piece("secret", F.when(value.rlike("^[0-9A-F]+$"), F.lower(value)).otherwise(value), value))
    begin, end = F.regexp_extract(m, f"^({_BEGIN})", 1), F.regexp_extract(m, f"({_END})$", 1)
    inner = F.substr(m, F.length(begin) + 1, F.length(m) - F.length(begin) - F.length(end))
    pem = F.array(_plain(begin), _piece("secret", inner, inner), _plain(end))
    date = F.regexp_extract(m, f"({_DATE})$", 1)
    dob = F.array(_plain(F.substr(m, F.lit(1), F.length(m) - F.length(date))), _piece("dob", _day(date), date))
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-]))", 1)
    number = F.substr(m, F.length(code) + 1)
    phone = F.array(_plain(code), _piece("phone", _digits(number), number))
    title = F.regexp_extract(m, rf"^({_TITLE}\.? )", 1)
    name = F.substr(m, F.length(title) + 1)
    given, family = F.when(name.contains(" "), F.substring_index(name, " ", 1)), F.substring_index(name, " ", -1)
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    listed = F.when(F.initcap(given).rlike("^" + _any(GIVEN["f:latin"] + " " + GIVEN["f:cyrillic"]) + "$"), "f")
    gender = F.when(title.rlike("^" + _any(TITLES["f"])), "f").when(title != "", "m").otherwise(F.coalesce(listed, F.lit("m")))
    person = F.array(
        _plain(title),
        _piece(F.when(given.isNotNull(), F.concat(F.lit("given:"), gender, F.lit(":"), script)), F.lower(given), F.coalesce(given, F.lit(""))),
        _plain(F.when(given.isNotNull(), " ").otherwise("")),
        _piece(F.concat(F.lit("family:"), script), F.lower(family), family),
    )
    is_a = lambda kind: m.rlike("^(?:" + MENTIONS[kind] + ")$")
    return (
        F.when(is_a("email"), email)
        .when(is_a("pem"), pem)
        .when(is_a("secret"), secret)
        .when(is_a("dob"), dob)
        .when(is_a("iban"), F.array(_piece("iban", F.regexp_replace(m, " ", ""), m)))
        .when(is_a("passport"), F.array(_piece("passport", m, m)))
        .when(is_a("mac"), F.array(_piece("mac", F.lower(F.regexp_replace(m, "[:-]", "")), m)))
        .when(is_a("nid"), F.array(_piece("nid", F.regexp_replace(m, "[.-]", ""), m)))
        .when(is_a("ip"), F.array(_piece("ip", m, m)))
        .when(is_a("ssn"), F.array(_piece("ssn", _digits(m), m)))
        .when(is_a("card"), F.array(_piece("card", _digits(m), m)))
        .when(is_a("phone"), phone)
        .otherwise(person)
    )


# ---- surrogates of canonical forms --------------------------------------------------------------------------------


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit undoubled."""
    last = F.length(digits) - 1
    doubled = F.transform(
        _chars(digits),
        lambda c, i: F.when((last - i) % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def iban_rest(account: Column) -> Column:
    """An account number modulo 97 after its head is moved to the end; 1 if it is valid."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def control_number(digits: Column) -> Column:
    """What a control letter is counted from: the number, X, Y and Z as 0, 1 and 2."""
    return F.pmod(F.translate(digits, "XYZ", "012").cast("decimal(38,0)"), F.lit(23)).cast("int")


def prepared(entities: DataFrame) -> DataFrame:
    """``entities`` with what their surrogates are made from: ``own``, ``hexed`` and ``ten``.

    ``own`` is the part of a canonical form that is replaced: local parts carry their domain to tell addresses apart.
    The columns are stored, so that long forms are read once and not once for every character drawn.
    """
    kind, canon = F.col("kind"), F.col("canon")
    own = F.when(kind == "local", F.substring_index(canon, "@", 1)).otherwise(canon)
    rows = entities.withColumn("own", own)
    hexed = F.col("own").rlike("^[0-9a-f]*[a-f][0-9a-f]*$") & (kind == "secret") | (kind == "mac")
    return cut_lineage(rows.withColumn("hexed", hexed).withColumn("ten", (kind == "phone") & (F.length("own") == 10)))


def surrogate(attempt: int) -> Column:
    """The surrogate of a canonical form, in canonical form, at the given attempt, from the columns of ``prepared`` and the keyed digest
    ``hexes``."""
    kind, own, hexed, ten = F.col("kind"), F.col("own"), F.col("hexed"), F.col("ten") & F.lit(attempt < 3)
    hexes = F.col("hexes")
    # two digest digits per drawn character; longer forms draw from the digest anew
    byte = lambda i: F.conv(F.substr(F.concat(hexes, F.sha2(F.concat(hexes, F.floor(i / 64).cast("string")), 512)), F.when(i < 64, 2 * i + 1).otherwise(129 + 2 * (i % 64)), F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, b: F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1))
    base = F.when(own.rlike(r"[\p{L}\p{M}\p{N}]"), own).otherwise(F.regexp_replace(own, "(?s).", "a"))
    # more characters of the last kind after a few attempts; later where there are billions of forms
    more = F.when(kind.isin("ssn", "card"), max(0, 2 * (attempt - 11))).otherwise(max(0, 2 * (attempt - 2)))
    base = F.concat(base, F.repeat(F.regexp_extract(base, r"([\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}]*+$", 1), more))

    def drawn(c: Column, i: Column) -> Column:
        b = byte(i)
        return (
            F.when((kind == "iban") & (i < 4) | (kind == "nid") & (i == 0) & c.rlike("[XYZ]"), c)
            .when(hexed & c.rlike("[0-9a-f]"), pick(_HEX, b))
            .when(ten & i.isin(0, 3), pick("23456789", b))
            .when((kind == "card") & (i == 0), c)
            .when(c.rlike("[0-9]"), pick(_DIGITS, b))
            .when(c.rlike("[a-z]"), pick(_LOWER, b))
            .when(c.rlike(r"\p{Lu}"), pick(_UPPER, b))
            .when(c.rlike(r"[\p{L}\p{M}]"), pick(_LOWER, b))
            .when(c.rlike(r"\p{N}"), pick(_DIGITS, b))
            .otherwise(c)
        )

    spelled = F.array_join(F.transform(_chars(base), drawn), "")
    body = F.substr(spelled, F.lit(1), F.length(base) - 1)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) + luhn_sum(own), F.lit(10))  # as far from a valid end as the original
    card = F.concat(body, check.cast("string"))
    country, account = F.substr(spelled, F.lit(1), F.lit(2)), F.substr(spelled, F.lit(5))
    due = 98 - iban_rest(F.concat(country, F.lit("00"), account))
    iban = F.concat(country, F.lpad(F.when(iban_rest(own) == 1, due).otherwise(due % 97 + 2).cast("string"), 2, "0"), account)
    # control letters as far from the right one as the original's; other letters than these have a place of their own
    place = F.instr(F.lit(_CONTROL), F.substr(own, F.length(own))) - 1
    off = F.pmod(place - control_number(F.substr(own, F.lit(1), F.length(own) - 1)), F.lit(23))
    stem = F.substr(spelled, F.lit(1), F.length(own) - 1)
    letter = F.substr(F.lit(_CONTROL), F.pmod(control_number(stem) + off, F.lit(23)).cast("int") + 1, F.lit(1))
    nid = F.when(own.rlike("[A-Z]$"), F.concat(stem, F.regexp_replace(F.substr(spelled, F.length(own) + 1), "[A-Z]", "0"), letter)).otherwise(spelled)
    part = lambda i: F.get(F.split(own, r"\."), F.lit(i))
    b = [byte(F.lit(i)) for i in range(4)]
    local = (part(0) == "192") & (part(1) == "168") & F.lit(attempt < 3)
    inner = ((part(0) == "10") | (part(0) == "192") & (part(1) == "168")) & F.lit(attempt < 6) & ~local
    ip = F.concat_ws(
        ".",
        F.when(local, "192").when(inner, "10").otherwise((b[0] % 223 + 1).cast("string")),
        F.when(local, "168").otherwise(b[1].cast("string")),
        b[2].cast("string"),
        (b[3] % 254 + 1).cast("string"),
    )
    if attempt >= 12:
        ip = F.concat(F.lit("fd00:"), F.regexp_replace(F.substr(hexes, F.lit(1), F.lit(24)), "(.{4})(?=.)", "$1:"), F.lit("::"))
    # valid in either order; the years of two digits, then years that nobody was born in
    year = b[0] % 100 + 1927 if attempt < 3 else (b[0] * 256 + b[1]) % 7900 + 2100
    m, d = byte(F.lit(2)) % 12 + 1, byte(F.lit(3)) % 12 + 1
    dob = F.concat(year.cast("string"), F.lpad(F.least(m, d).cast("string"), 2, "0"), F.lpad(F.greatest(m, d).cast("string"), 2, "0"))
    names = F.lit(None).cast("string")
    many = 1 + attempt // 3
    for group, words in {**{"given:" + k: v for k, v in GIVEN.items()}, **{"family:" + k: v for k, v in FAMILY.items()}}.items():
        some = [w.lower() for w in words.split()]
        chosen = F.concat_ws("-", *[F.element_at(F.array(*[F.lit(w) for w in some]), byte(F.lit(i)) % len(some) + 1) for i in range(many)])
        names = F.when(kind == group, chosen).otherwise(names)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "nid", nid).when(kind == "dob", dob).when(kind.contains(":"), names).otherwise(spelled)


def rendered(kind: Column, text: Column, new: Column) -> Column:
    """A surrogate in the spelling of one mention."""
    poured = F.aggregate(
        _chars(text),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substr(new, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))
        ),
    )
    poured = F.concat(poured["out"], F.substr(new, poured["i"]))  # a widened form has more digits than the mention
    cased = F.array_join(F.zip_with(_chars(text), _chars(new), lambda c, n: F.when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n)), "")
    named = F.when((F.upper(text) == text) & (F.length(text) > 1), F.upper(new)).otherwise(F.initcap(F.regexp_replace(new, "-", " ")))
    named = F.when(new.contains("-"), F.regexp_replace(named, " ", "-")).otherwise(named)
    return (
        F.when(kind.isNull(), text)
        .when(kind.isin("phone", "ssn", "card", "iban", "nid"), poured)
        .when(kind == "mac", F.when(F.upper(text) == text, F.upper(poured)).otherwise(poured))
        .when(kind == "dob", _dated(text, new))
        .when(kind.isin("local", "domain"), cased)
        .when(kind.contains(":"), named)
        .when((kind == "secret") & (F.upper(text) == text), F.upper(new))
        .otherwise(new)
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(entity, kind, canon) to (entity, new): distinct surrogates, none of which is an entity itself."""
    columns = ["entity", "kind", "canon", "own", "hexed", "ten"]
    waiting, parts, attempt = prepared(entities.select("entity", "kind", "canon")), [], 0
    name = lambda kind, form: F.concat(kind, F.lit("|"), F.lower(form))
    kind, canon, new = F.col("kind"), F.col("canon"), F.col("new")
    # domains get distinct surrogates that are no real domains, so local parts are compared within their own domain
    real = entities.where(kind != "local").select(name(kind, canon).alias("made")).distinct()
    while True:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, F.lit(str(attempt))), 512)
        # written, so that a long form is hashed once and not for every character drawn
        tried = cut_lineage(waiting.withColumn("hexes", digest)).withColumn("new", surrogate(attempt))
        tried = tried.withColumn("made", name(kind, F.when(kind == "local", F.concat(new, F.lit("@"), F.substring_index(canon, "@", -1))).otherwise(new)))
        used = reduce(DataFrame.union, [p.select("made") for p in parts] + [real]).distinct()
        # the least form of each surrogate takes it, if it is free: both joins are on keys with one row
        lowest = tried.groupBy("made").agg(F.min("canon").alias("canon")).join(used, "made", "left_anti").withColumn("first", F.lit(True))
        fine = F.col("first").isNotNull() & (F.lower(new) != F.lower(F.col("own")))
        judged = cut_lineage(tried.join(lowest, ["made", "canon"], "left").withColumn("fine", fine))
        parts.append(judged.where("fine").select("entity", "kind", "canon", "new", "made"))
        waiting = judged.where(~F.col("fine")).select(*columns)
        if waiting.isEmpty():
            return reduce(DataFrame.union, parts).select("entity", "new")
        attempt += 1


def pseudonymise(docs: DataFrame, key: str = "veil", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_entities, kinds (of its mentions, sorted) and the text with surrogates."""
    slim = docs.select(cell(id_col).alias("doc_id"), cell(text_col).alias("text"))
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    hits = slim.withColumn("m", found).where(F.size("m") > 0)
    hits = cut_lineage(hits.withColumn("row", F.monotonically_increasing_id()))
    mentions = hits.select("row", F.posexplode("m").alias("i", "mention"))
    pieces = mentions.select("row", "i", F.posexplode(pieces_of(F.col("mention"))).alias("j", "p")).select("row", "i", "j", "p.*")
    pieces = cut_lineage(pieces.withColumn("entity", F.coalesce(F.concat("kind", F.lit("|"), "canon"), F.lit(""))))
    entities = cut_lineage(pieces.where("entity != ''").groupBy("entity", "kind", "canon").agg(F.count(F.lit(1)).alias("n")))
    known = cut_lineage(entities.select("entity", "n").join(assign(entities, key), "entity"))
    named = hot_join(pieces.where("entity != ''"), known, "entity", "n", ["row", "i", "j"])
    every = named.unionByName(pieces.where("entity = ''").withColumn("new", F.lit(None).cast("string")))
    put = every.select("row", "i", "j", "kind", rendered(F.col("kind"), F.col("text"), F.col("new")).alias("out"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "out"))), lambda x: x["out"]), "")
    whole = put.groupBy("row", "i").agg(joined.alias("out"), F.collect_set(F.substring_index("kind", ":", 1)).alias("kinds"))
    lists = whole.groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "out"))), lambda x: x["out"]).alias("new"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")
    )
    gaps = F.split("text", PATTERN, -1)
    text = F.array_join(F.zip_with(gaps, "new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = hits.join(lists, "row").select("doc_id", F.size("m").cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"), text.alias("text"))
    same = slim.where(F.col("text").isNull() | ~F.col("text").rlike(PATTERN))
    return changed.unionByName(same.select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"), "text"))
