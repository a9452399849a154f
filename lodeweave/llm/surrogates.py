"""Personal data replaced by surrogates of the same type.

1. Each text is scanned for e-mail addresses, bank accounts, secrets, IP
   addresses, social security, card and phone numbers and names; what is found
   is written once.  Names are found by title, given name or an introduction
   before them, and are taken apart into given names and surnames.
2. Every distinct entity gets a replacement derived from a secret key: the
   same entity has the same one in every document (coreference), whatever
   its spelling.  A given name keeps gender and script, a surname its script,
   so title and surname, full name and surname alone agree; a number keeps its
   grouping, leading digits, valid ranges and check digits, an address its
   shape and case.
3. Replacements are checked: one that is another entity, or that two entities
   share, is drawn again for all but the first of them; entities left after
   MAX_DRAWS rounds get unused values of their space, or of a wider one, by
   rank.  Given names of the lists below change places within their list.
4. The texts are put together again from what lies between the finds, in which
   a surname or given name of a find of the same document is replaced as well.

Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.workspace import materialize

KEY = "change me"
MAX_DRAWS = 20

#: Given names by script and gender; fixed values.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sarah Emma Sofia Marta Elena Clara Alice Nora Ines Lucia Paula Greta Heidi Ingrid Chloe Camille Amelie Carmen Pilar Olivia".split(),
    ("latin", "m"): "John Peter Thomas Daniel Martin Lucas Paul Hugo David Carlos Pablo Diego Hans Karl Otto Stefan Jean Pierre Antoine Michel James Robert William Henry".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Михаил Николай Андрей".split(),
}
#: Titles by gender, and those of either; fixed values.
TITLES = {
    "m": ["Mr.", "Mister", "Herr", "Señor", "Sr.", "Monsieur", "Sir", "господин", "Господин"],
    "f": ["Mrs.", "Ms.", "Miss", "Frau", "Señora", "Sra.", "Madame", "Mme", "госпожа", "Госпожа"],
    None: ["Dr.", "Prof.", "Professor"],
}
#: What stands before a name by which people introduce themselves; fixed values.
CUES = ["my name is ", "My name is ", "ich heiße ", "Ich heiße ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "меня зовут ", "Меня зовут "]
_SYLLABLES = {"latin": "bar den fel gor hal kim lan mer nor pol rin sat tur vel wes zan".split(), "cyrillic": "бар дев гор лан мир нов пол рад сав тур вел зан кир жук лом рог".split()}

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_PRIVATE = r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01]))\."
#: Country codes of phone numbers, a fixed value; beginnings by which secrets are told.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_MARKED = r"AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ"
_HEX = r"^[0-9a-f]+$"

_GIVEN_LIST = [n for names in GIVEN.values() for n in names]
_TITLE_LIST = [t for titles in TITLES.values() for t in titles]
_GIVEN_ANY = "|".join(_GIVEN_LIST)
_TITLE_ANY = "|".join(t.replace(".", "\\.") for t in _TITLE_LIST)
_PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_SURNAME = rf"(?:\p{{Lu}}\. ){{0,2}}(?:(?:von|van|de|del|di|da|der|den|la|le) ){{0,3}}{_PART}"
#: Type to pattern, in the order in which they are tried.  Repeated groups are bounded, since Java recurses over them.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_][\p{L}\p{N}_.+-]*+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![\p{L}\p{N}])",
    "secret": (
        r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}+|github_pat_[0-9A-Za-z_]{20,}+|sk-[0-9A-Za-z_-]{16,}+|xox[abprs]-[0-9A-Za-z-]{10,}+"
        r"|AIza[0-9A-Za-z_-]{30,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{4,}+)"
        r"|(?<![0-9A-Za-z])(?=[0-9A-Za-z]{32})(?:(?=[0-9a-fA-F]*+(?![0-9A-Za-z]))(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,}+"
        r"|(?=[0-9A-Za-z]{40})(?=[A-Za-z]*[0-9])(?=[0-9a-z]*[A-Z])(?=[0-9A-Z]*[a-z])[0-9A-Za-z]{40,}+)(?![0-9A-Za-z])"
        r"|(?<![0-9A-Za-z+/])(?=[0-9A-Za-z+/]{38})[0-9A-Za-z+/]{38,}+={1,2}"
    ),
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]{1,4}:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w])",
    "phone": (
        r"(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|\+(?=(?:[ ./()-]{0,2}\d){8,15})\d{1,3}(?:[ ./-]?\(?\d{1,9}\)?){1,6}(?!\d)"
        r"|0\d(?:[ .-]\d{2}){4}(?![\w-])|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-])|[2-9]\d{2}[2-9]\d{6}(?![\w-]))"
    ),
    "name": (
        rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLE_ANY}) ){{1,3}}(?:{_PART} )?{_SURNAME}|(?:(?:{_GIVEN_ANY}) ){{1,2}}{_SURNAME}"
        rf"|(?<={'|'.join(CUES)}){_PART}(?: {_SURNAME})?)(?![\p{{L}}\p{{N}}])"
    ),
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A word that may be a name by itself.
_WORD = rf"(?<![\p{{L}}\p{{N}}]){_PART}(?![\p{{L}}\p{{N}}])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kind_of(surface: Column) -> Column:
    """The first type whose pattern covers the whole find."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def canonical(kind: Column, surface: Column) -> Column:
    """What all spellings of one entity share.

    E-mail and IPv6 addresses and hexadecimal secrets ignore case, numbers
    their grouping, phone numbers the country code 1.
    """
    digits = _digits(surface)
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10))
    return (
        F.when(kind.isin("email", "ip6"), F.lower(surface))
        .when((kind == "secret") & F.lower(surface).rlike(_HEX), F.lower(surface))
        .when(kind == "phone", F.coalesce(national, F.when(surface.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .otherwise(surface)
    )


def parts_of(kind: Column, surface: Column) -> Column:
    """Array of (kind, text): a name's words, of which titles, initials and particles have no kind; other finds as one."""
    words = F.split(surface, " ")

    def word(w: Column, i: Column) -> Column:
        none = w.isin(*_TITLE_LIST) | w.rlike(r"^(?:\p{Lu}\.|\p{Ll}+)$")
        alone = F.size(F.filter(words, lambda v: ~v.isin(*_TITLE_LIST))) == 1
        last = (i == F.size(words) - 1) & ~(alone & w.isin(*_GIVEN_LIST))
        return F.struct(F.when(~none, F.when(last, "surname").otherwise("given")).alias("kind"), w.alias("text"))

    return F.when(kind == "name", F.transform(words, word)).otherwise(F.array(F.struct(kind.alias("kind"), surface.alias("text"))))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def gender_of(surface: Column) -> Column:
    """``m`` or ``f`` by title, else by the first given name of the lists, else null."""
    words, found = F.split(surface, " "), F.lit(None).cast("string")
    given = {gender: [n for (_, g), names in GIVEN.items() if g == gender for n in names] for gender in ("m", "f")}
    for known in (given, TITLES):
        for gender in ("m", "f"):
            found = F.when(F.arrays_overlap(words, F.array(*(F.lit(n) for n in known[gender]))), F.lit(gender)).otherwise(found)
    return found


def _draw(stream: Column, at) -> Column:
    """The ``at``-th number below 65,536 of a hex stream of 256 digits."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(stream, (place % 64) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (draw % len(values) + 1).cast("int"))


def _kept(kind: Column, entity: Column) -> Column:
    """Characters at the begin of an entity that its replacement keeps."""
    length = lambda pattern: F.length(F.regexp_extract(entity, pattern, 0))
    return (
        F.when(kind == "secret", length(f"^(?:{_MARKED})"))
        .when(kind == "card", 1)
        .when((kind == "phone") & entity.startswith("+"), F.least(length(_COUNTRY) + 1, F.length(entity) - 4))
        .when((kind == "phone") & entity.startswith("0"), 2)
        .when(kind == "iban", 4)
        .when(kind == "ip6", length("^[^:]*:"))
        .otherwise(0)
    )


def _alphabets(hexadecimal: Column) -> list[tuple[str, Column, Column]]:
    """(pattern of a character, the characters it may become, their number)."""
    lower, upper = (F.when(hexadecimal, F.lit(a[:6])).otherwise(F.lit(a)) for a in (_LATIN, _LATIN.upper()))
    size = F.when(hexadecimal, 6).otherwise(26)
    return [("[0-9]", F.lit("0123456789"), F.lit(10)), ("[а-я]", F.lit(_CYRILLIC), F.lit(32)), (r"\p{Ll}", lower, size), (r"\p{Lu}", upper, size)]


def _is_hex(kind: Column, entity: Column) -> Column:
    return (kind == "ip6") | ((kind == "secret") & entity.rlike(_HEX))


def _same_shape(text: Column, stream: Column, kept: Column | int = 0, hexadecimal: Column | None = None) -> Column:
    """``text`` with each letter and digit from place ``kept`` on replaced by one of its kind, script and case."""
    alphabets = _alphabets(F.lit(False) if hexadecimal is None else hexadecimal)

    def change(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters, size in reversed(alphabets):
            out = F.when(c.rlike(f"^{pattern}$"), F.substr(letters, (_draw(stream, i) % size + 1).cast("int"), F.lit(1))).otherwise(out)
        return F.when(i < kept, c).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def _with_check_digit(body: Column) -> Column:
    return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))


def _with_iban_check(iban: Column) -> Column:
    """The account with right check digits: the rest modulo 97 of body, country and 00, letters counting 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(iban, F.lit(5)))


def _stream(*seed: Column) -> Column:
    return F.concat(*(F.sha2(F.concat_ws("\x1e", F.concat_ws("\x1f", *seed), F.lit(str(i))), 256) for i in range(4)))


def _surrogate_domain(domain: Column, key: str) -> Column:
    """The one replacement of a domain; its last label stays."""
    site = F.regexp_replace(domain, r"\.[^.]+$", "")
    return F.concat(_same_shape(site, _stream(F.lit(key), F.lit("domain"), domain)), F.lit("."), F.regexp_extract(domain, r"[^.]+$", 0))


def listed_given(entity: Column, key: str) -> Column:
    """The given name that takes the place of one of the lists: another of its script and gender; null for other names."""
    found = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        shift = F.pmod(F.xxhash64(F.lit(key), F.lit(script), F.lit(gender)), F.lit(len(names) - 1)) + 1
        place = F.array_position(F.array(*(F.lit(n) for n in names)), entity)
        found = F.when(place > 0, _pick(names, place - 1 + shift)).otherwise(found)
    return found


def _syllable_of(script: str, number: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: _pick(_SYLLABLES[script], number(x))


def _ending(kind: Column, gender: Column, script: str) -> Column:
    """What ends an invented given name: a vowel for women."""
    return F.when((kind == "given") & (gender == "f"), F.lit({"latin": "a", "cyrillic": "а"}[script])).otherwise(F.lit(""))


def surrogate(kind: Column, entity: Column, gender: Column, draw: Column, key: str) -> Column:
    """The ``draw``-th replacement of an entity, in canonical form."""
    stream = _stream(F.lit(key), kind, entity, draw.cast("string"))
    shaped = _same_shape(entity, stream, _kept(kind, entity), _is_hex(kind, entity))
    card = F.when(_luhn(entity) == 0, _with_check_digit(F.substr(shaped, F.lit(1), F.length(shaped) - 1))).otherwise(shaped)
    high = lambda i: (_draw(stream, 40 + i) % 8 + 2).cast("string")
    phone = F.when(
        (F.length(entity) == 10) & ~entity.startswith("+") & ~entity.startswith("0"), F.concat(high(0), F.substring(shaped, 2, 2), high(1), F.substring(shaped, 5, 6))
    ).otherwise(shaped)
    ssn = F.concat((_draw(stream, 50) % 8 + 1).cast("string"), F.substring(shaped, 2, 2), F.lpad((_draw(stream, 51) % 99 + 1).cast("string"), 2, "0"), F.lpad((_draw(stream, 52) % 9999 + 1).cast("string"), 4, "0"))
    octet = lambda i: (_draw(stream, i) % 254 + 1).cast("string")
    first, second = F.split_part(entity, F.lit("."), F.lit(1)), F.split_part(entity, F.lit("."), F.lit(2))
    private = entity.rlike(_PRIVATE)
    ip = F.concat_ws(".", F.when((first == "10") | private, first).otherwise(octet(0)), F.when(private, second).otherwise(octet(1)), octet(2), octet(3))
    domain = F.split_part(entity, F.lit("@"), F.lit(2))
    email = F.concat(_same_shape(F.split_part(entity, F.lit("@"), F.lit(1)), stream), F.lit("@"), _surrogate_domain(domain, key))
    names = F.lit(None).cast("string")
    for script in _SYLLABLES:
        many = F.transform(F.sequence(F.lit(0), draw + 2), _syllable_of(script, lambda i: _draw(stream, i + 4)))  # the later drawn, the longer
        whole = F.initcap(F.concat(F.array_join(many, ""), _ending(kind, gender, script)))
        names = F.when(_script(entity) == script, whole).otherwise(names)
    return (
        F.when(kind == "email", email)
        .when(kind.isin("secret", "ip6"), shaped)
        .when(kind == "iban", _with_iban_check(shaped))
        .when(kind == "ip", ip)
        .when(kind == "ssn", ssn)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .otherwise(names)
    )


def _cased(like: Column, text: Column) -> Column:
    """``text`` with capitals where ``like`` has them."""
    letters = F.split(like, "")
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(F.get(letters, i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def _in_format(kind: Column, surface: Column, replacement: Column) -> Column:
    """The canonical ``replacement`` written the way the find was: grouping, country code, case."""
    bare = F.regexp_replace(replacement, r"^\+", "")
    own = F.when(kind == "iban", "[0-9A-Z]").otherwise("[0-9]")
    mine = F.length(F.regexp_replace(surface, F.when(kind == "iban", "[^0-9A-Z]").otherwise(r"\D"), F.lit("")))
    ahead = F.greatest(mine - F.length(bare), F.lit(0))
    counts = lambda c: F.regexp_like(c, own)
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(counts(c) & (acc["k"] >= ahead), F.substr(bare, acc["k"] - ahead + 1, F.lit(1))).otherwise(c)).alias("out"),
        (acc["k"] + F.when(counts(c), 1).otherwise(0)).alias("k"),
    )
    filled = F.aggregate(F.split(surface, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]
    filled = F.concat(filled, F.when(F.length(bare) > mine, F.substr(bare, mine + 1)).otherwise(F.lit("")))
    at = lambda c, i: F.split_part(c, F.lit("@"), F.lit(i))
    email = F.concat(_cased(at(surface, 1), at(replacement, 1)), F.lit("@"), _cased(at(surface, 2), at(replacement, 2)))
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), filled)
        .when(kind == "email", email)
        .when(kind.isin("secret", "ip6"), _cased(surface, replacement))
        .otherwise(replacement)
    )


def _space(kind: Column, entity: Column, gender: Column) -> Column:
    """Names the space of an entity, the values that ``_numbered`` counts."""
    local, domain = F.split_part(entity, F.lit("@"), F.lit(1)), F.split_part(entity, F.lit("@"), F.lit(2))

    def shape(text: Column) -> Column:
        for pattern, letter in (("[а-я]", "а"), (r"\p{Ll}", "a"), (r"\p{Lu}", "A"), ("[0-9]", "0")):
            text = F.regexp_replace(text, f"(?!а){pattern}" if letter == "a" else pattern, letter)
        return text

    first = F.split_part(entity, F.lit("."), F.lit(1))
    ip = F.when(entity.rlike(_PRIVATE), F.concat_ws(".", first, F.split_part(entity, F.lit("."), F.lit(2)))).when(first == "10", first).otherwise(F.lit("any"))
    kept = _kept(kind, entity)
    own = F.concat(F.substr(entity, F.lit(1), kept), shape(F.substr(entity, kept + 1)), F.when(_is_hex(kind, entity), "x").otherwise(""))
    return (
        F.when(kind == "email", F.concat_ws("@", shape(local), domain))
        .when(kind == "ip", ip)
        .when(kind == "card", F.concat(own, F.when(_luhn(entity) == 0, "c").otherwise("")))
        .when(kind.isin("given", "surname"), F.concat(_script(entity), F.when((kind == "given") & (gender == "f"), "f").otherwise("")))
        .otherwise(own)
    )


def _numbered(kind: Column, entity: Column, gender: Column, n: Column, key: str) -> Column:
    """The ``n``-th value of the space of an entity.

    Beyond the space come longer values, for IPv4 addresses those of 10/8,
    then of any range, then IPv6 addresses.
    """
    over = lambda a, b: F.floor(a / b).cast("bigint")
    alphabets = _alphabets(_is_hex(kind, entity))
    high = (kind == "phone") & (F.length(entity) == 10) & ~entity.startswith("+") & ~entity.startswith("0")

    def filled(text: Column, kept: Column) -> tuple[Column, Column]:
        def fill(acc: Column, c: Column) -> Column:
            rest, i = acc["rest"], acc["i"]
            new, left = c, rest
            for pattern, letters, size in reversed(alphabets):
                hit = c.rlike(f"^{pattern}$")
                new = F.when(hit, F.substr(letters, (rest % size + 1).cast("int"), F.lit(1))).otherwise(new)
                left = F.when(hit, over(rest, size)).otherwise(left)
            ranged = high & i.isin(0, 3)
            new = F.when(i < kept, c).when(ranged, (rest % 8 + 2).cast("string")).otherwise(new)
            left = F.when(i < kept, rest).when(ranged, over(rest, 8)).otherwise(left)
            return F.struct(F.concat(acc["out"], new).alias("out"), left.alias("rest"), (i + 1).alias("i"))

        zero = F.struct(F.lit("").alias("out"), n.cast("bigint").alias("rest"), F.lit(0).alias("i"))
        done = F.aggregate(F.split(text, ""), zero, fill)
        return done["out"], done["rest"]

    local, rest = filled(F.split_part(entity, F.lit("@"), F.lit(1)), F.lit(0))
    letters = F.translate(F.conv(rest.cast("string"), 10, 26), "0123456789ABCDEFGHIJKLMNOP", _LATIN)
    email = F.concat(local, F.when(rest > 0, letters).otherwise(F.lit("")), F.lit("@"), _surrogate_domain(F.split_part(entity, F.lit("@"), F.lit(2)), key))
    checked = (kind == "card") & (_luhn(entity) == 0)
    body, rest = filled(F.when(checked, F.substr(entity, F.lit(1), F.length(entity) - 1)).otherwise(entity), _kept(kind, entity))
    body = F.concat(body, F.when(rest > 0, rest.cast("string")).otherwise(F.lit("")))
    other = F.when(checked, _with_check_digit(body)).when(kind == "iban", _with_iban_check(body)).otherwise(body)
    names = F.lit(None).cast("string")
    for script in _SYLLABLES:
        spelled = F.array_join(F.transform(F.split(F.conv(n.cast("string"), 10, 16), ""), _syllable_of(script, lambda d: F.conv(d, 16, 10).cast("int"))), "")
        names = F.when(_script(entity) == script, F.initcap(F.concat(spelled, _ending(kind, gender, script)))).otherwise(names)

    def octets(m: Column, count: int) -> list[Column]:
        return [(over(m, 254 ** (count - 1 - i)) % 254 + 1).cast("string") for i in range(count)]

    n = n.cast("bigint")
    first, second = F.split_part(entity, F.lit("."), F.lit(1)), F.split_part(entity, F.lit("."), F.lit(2))
    private = entity.rlike(_PRIVATE)
    m = F.when(private, n - 254**2).otherwise(n)  # at or beyond 0: a number in 10/8
    beyond = F.when(private | (first == "10"), m - 254**3).otherwise(n)
    last = F.lower(F.lpad(F.hex(beyond), 16, "0"))
    ip = (
        F.when(private & (m < 0), F.concat_ws(".", first, second, *octets(n, 2)))
        .when(beyond < 0, F.concat_ws(".", F.lit("10"), *octets(m, 3)))
        .when(beyond < 254**4, F.concat_ws(".", *octets(beyond, 4)))
        .otherwise(F.concat_ws(":", F.lit("fd00:0:0:0"), *(F.substring(last, 1 + 4 * i, 4) for i in range(4))))
    )
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("given", "surname"), names).otherwise(other)


def _assign_rest(left: DataFrame, real: DataFrame, settled: DataFrame, key: str) -> DataFrame:
    """``settled`` with the entities ``left``: by rank the unused values of their space, of which each round counts through twice as many."""
    settled = settled.select("kind", "entity", "replacement")
    left = left.select("kind", "entity", "gender", _space(F.col("kind"), F.col("entity"), F.col("gender")).alias("space"))
    start, block = 0, 1024
    by_space = lambda order: F.row_number().over(Window.partitionBy("kind", "space").orderBy(order))
    left = materialize(left, "pii")
    while not left.isEmpty():
        sizes = left.groupBy("kind", "space").agg(F.min(F.struct("entity", "gender")).alias("e")).select("kind", "space", "e.entity", "e.gender")
        values = sizes.select("kind", "space", "entity", "gender", F.explode(F.sequence(F.lit(start), F.lit(start + block - 1))).alias("n"))
        values = values.select("kind", "space", "n", _numbered(F.col("kind"), F.col("entity"), F.col("gender"), F.col("n"), key).alias("replacement"))
        unused = values.join(real.union(settled.select("kind", "replacement")), ["kind", "replacement"], "left_anti")
        # A value that two spaces reach is counted in one of them.
        unused = unused.groupBy("kind", "replacement").agg(F.min(F.struct("space", "n")).alias("s")).select("kind", "replacement", "s.space", "s.n")
        ranked = left.withColumn("rank", by_space("entity")).join(unused.withColumn("rank", by_space("n")), ["kind", "space", "rank"])
        won = materialize(ranked.select("kind", "entity", "replacement"), "pii")
        settled = settled.union(won)
        left = materialize(left.join(won, ["kind", "entity"], "left_anti"), "pii")
        start, block = start + block, 2 * block
    return settled


def surrogate_table(entities: DataFrame, key: str = KEY, max_draws: int | None = None) -> DataFrame:
    """(kind, entity, replacement): distinct replacements, none of which is an entity.

    ``entities`` has distinct (kind, entity, gender).  Each round draws for the
    entities still without one; only whether any is left reaches the driver.
    Those left after ``max_draws`` rounds get unused values by rank.  Given
    names of the lists are the exception: they change places among themselves.
    """
    listed = listed_given(F.col("entity"), key)
    places = entities.where((F.col("kind") == "given") & listed.isNotNull()).select("kind", "entity", listed.alias("replacement"))
    entities = entities.where((F.col("kind") != "given") | listed.isNull())
    real = entities.select("kind", F.col("entity").alias("replacement"))
    left, settled = entities, None
    for draw in range(MAX_DRAWS if max_draws is None else max_draws):
        drawn = left.select("kind", "entity", "gender", surrogate(F.col("kind"), F.col("entity"), F.col("gender"), F.lit(draw), key).alias("replacement"))
        drawn = materialize(drawn, "pii")
        taken = real if settled is None else real.union(settled.select("kind", "replacement"))
        free = drawn.join(taken, ["kind", "replacement"], "left_anti")
        won = free.groupBy("kind", "replacement").agg(F.min("entity").alias("entity")).select("kind", "entity", "replacement")
        won = materialize(won, "pii")
        settled = won if settled is None else settled.union(won)
        left = materialize(drawn.join(won, ["kind", "entity"], "left_anti").select("kind", "entity", "gender"), "pii")
        if left.isEmpty():
            return settled.union(places)
    settled = settled if settled is not None else entities.select("kind", "entity", F.lit("").alias("replacement")).limit(0)
    return _assign_rest(left, real, settled, key).union(places)


def find_entities(docs: DataFrame) -> DataFrame:
    """(id, th, pos, part, kind, entity, gender, text) of the finds in ``docs`` (id, th, t), names word by word."""
    found = docs.select("id", "th", F.posexplode(F.regexp_extract_all("t", F.lit(ANY), F.lit(0))).alias("pos", "surface")).distinct()
    found = found.withColumn("kind", F.coalesce(kind_of(F.col("surface")), F.lit("name")))
    found = found.withColumn("gender", F.when(F.col("kind") == "name", gender_of(F.col("surface"))))
    found = found.select("id", "th", "pos", "gender", F.posexplode(parts_of(F.col("kind"), F.col("surface"))).alias("part", "p"))
    kind, text = F.col("p.kind"), F.col("p.text")
    return found.select("id", "th", "pos", "part", kind.alias("kind"), canonical(kind, text).alias("entity"), F.when(kind == "given", F.col("gender")).alias("gender"), text.alias("text"))


def _bare_names(gap: Column, names: Column) -> Column:
    """``gap`` with its words that ``names`` (a map) has replaced."""
    words = F.transform(F.regexp_extract_all(gap, F.lit(_WORD), F.lit(0)), lambda w: F.coalesce(F.element_at(names, w), w))
    return F.array_join(F.zip_with(F.split(gap, _WORD, -1), F.concat(words, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def replace_personal_data(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_entities, text with surrogates.

    ``n_entities`` counts the finds and the names alone that refer to one.
    Null text stays null and has no entities.  Rows that repeat an id are
    treated each by its own text; a null id is an id like any other.  Other
    columns of ``docs`` are not read; an empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    found = materialize(find_entities(text), "pii")
    table = surrogate_table(materialize(found.where("kind is not null").groupBy("kind", "entity").agg(F.min("gender").alias("gender")), "pii"), key)
    each = found.join(table.hint("merge"), ["kind", "entity"], "left").repartition("id", "th")
    piece = F.when(F.col("replacement").isNull(), F.col("text")).otherwise(_in_format(F.col("kind"), F.col("text"), F.col("replacement")))
    name = F.when(F.col("kind").isin("given", "surname"), F.struct(F.col("text").alias("key"), piece.alias("value")))
    each = each.select("id", "th", "pos", F.struct("part", piece.alias("piece")).alias("p"), name.alias("name"))
    finds = each.groupBy("id", "th", "pos").agg(F.array_join(F.array_sort(F.collect_list("p"))["piece"], " ").alias("r"), F.collect_set("name").alias("names"))
    per_doc = finds.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("pos", "r")))["r"].alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    # A word that is both a given name and a surname of the document keeps the first of its two replacements.
    sole = F.filter("names", lambda x, i: (i == 0) | (x["key"] != F.get("names", i - 1)["key"]))
    per_doc = materialize(per_doc.select("id", "th", "r", F.map_from_entries(sole).alias("names")), "pii")
    both = text.alias("d").join(
        per_doc.alias("f").hint("merge"), F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.th") == F.col("f.th")), "left"
    ).select("d.id", "d.t", "f.r", "f.names")
    gaps = F.split("t", ANY, -1)
    both = both.select("id", "t", "r", "names", F.when(F.col("r").isNotNull(), gaps).alias("gaps"))
    named = F.size("names") > 0
    mentions = F.aggregate("gaps", F.lit(0), lambda a, g: a + F.size(F.filter(F.regexp_extract_all(g, F.lit(_WORD), F.lit(0)), lambda w: F.map_contains_key("names", w))))
    between = F.when(named, F.transform("gaps", lambda g: _bare_names(g, F.col("names")))).otherwise(F.col("gaps"))
    rebuilt = F.zip_with(between, F.concat(F.col("r"), F.array(F.lit(""))), lambda gap, r: F.concat(gap, r))
    return both.select(
        F.col("id").alias(id_col),
        F.when(F.col("r").isNull(), 0).otherwise(F.size("r") + F.when(named, mentions).otherwise(0)).cast("long").alias("n_entities"),
        F.when(F.col("r").isNull(), F.col("t")).otherwise(F.array_join(rebuilt, "")).alias("text"),
    )
