"""Surrogates for personal data, in DataFrame operations alone.

Detected are secrets in hexadecimal, e-mail addresses, IBANs, payment cards, social
security numbers, IPv4 addresses, telephone numbers, and names after a title. Each
distinct entity gets a surrogate from a keyed hash (SHA-512 over key, kind, attempt
and value): digit for digit, letter for letter of the same case and script; an IBAN
keeps its country, a card its first digit, an address its top-level domain, and
punctuation stays where it was. Names keep their title; a given name becomes one of
the gender that the title tells (another where it tells none), in the script of the
original; family names are drawn without gender, so that a person's mentions agree.

Mentions of one entity get one surrogate: values are compared without case, and
numbers by their digits alone. A mention in capitals stays in capitals. Surrogates
are checked against one another and against every original of their kind; all but
the least value of a clash, and values that clash with an original, are drawn again
until none clashes. From the WIDEN-th attempt on, a surrogate is longer than its
original, so that a format with few members cannot run out.

Null and empty texts stay as they are. Long texts are taken whole. Repeated rows are
replaced alike. Columns of the input are kept; one named ``n_replaced`` is replaced.
Empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import free_name, written

WIDEN = 6
#: Rows of one character's table: which letters stand in for a letter of a script and case.
_LETTERS = {
    "latin lower": "abcdefghijklmnopqrstuvwxyz",
    "latin upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "accent lower": "àáâäçèéêëíîïñóôöùúûü",
    "accent upper": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    "cyrillic lower": "абвгдежзийклмнопрстуфхцчшщэюя",
    "cyrillic upper": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "greek lower": "αβγδεζηθικλμνξοπρστυφχψω",
    "greek upper": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
_TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "Господин", "Г-н", "Κύριος", "Κος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Госпожа", "Г-жа", "Κυρία", "Κα"),
    "n": ("Dr", "Prof", "Professor", "Docteur", "Доктор"),
}
_GIVEN = {
    "latin m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karim Leon Marco Nils Oscar Pablo Robin Simon Tomas Victor".split(),
    "latin f": "Anna Berta Clara Diana Elena Frida Greta Helga Irina Julia Karla Laura Maria Nadia Olga Paula Rosa Sofia Tessa Vera".split(),
    "latin n": "Alex Andrea Charlie Dana Eden Frankie Jamie Jean Kim Luca Morgan Noa Pat Quinn Remy Robin Sacha Sam Toni Yuki".split(),
    "cyrillic m": "Антон Борис Вадим Глеб Денис Егор Игорь Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур".split(),
    "cyrillic f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Софья Татьяна".split(),
    "cyrillic n": "Саша Женя Валя Слава Шура Паша Валера Тоня".split(),
    "greek m": "Ανδρέας Γιώργος Δημήτρης Κώστας Λεωνίδας Μάριος Νίκος Παύλος Πέτρος Σταύρος".split(),
    "greek f": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία".split(),
    "greek n": "Άγγελος Χαρά Φώτης Ρένα".split(),
}
_PARTS = {
    "latin": "bar ben dor fal gar hol ker lan mar nor pel ros sal ter vin wes".split(),
    "cyrillic": "бар вол гор дан зор кал лук мал нов пол рад сок тар фед ход яр".split(),
    "greek": "αλ βας γερ δημ ζαφ καρ λαμ μαν νικ παπ ρηγ σαρ τσι φωτ χατ ψαρ".split(),
}
_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Tried in this order; a mention's kind is the first that matches all of it.
KINDS = {
    "secret": rf"{_EDGE}[0-9a-fA-F]{{32,128}}{_END}",
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}_+-](?:[\p{L}\p{N}._+-]*+)@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"{_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "card": rf"{_EDGE}(?:\d{{4}}[ -]?){{3}}\d{{1,7}}{_END}",
    "ssn": rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}{_END}",
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]?\d{{3,4}}{_END}|(?<![\p{{L}}\p{{N}}+])\+\d{{7,15}}{_END}",
    "name": rf"{_EDGE}(?:{_TITLE})\.?[  ]{_WORD}(?: {_WORD}){{0,2}}",
}
ALL = "|".join(f"(?:{p})" for p in KINDS.values())
_DIGITS = ("card", "ssn", "phone")


def _kind(mention: Column) -> Column:
    """The first kind that the whole mention is of. Within the mention its surroundings are gone, as the patterns need."""
    return reduce(lambda rest, k: F.when(mention.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(rest), reversed(KINDS), F.lit("name"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _pick(choices, digits: Column, place) -> Column:
    """A member of a list by hexadecimal digits of a hash; place chooses which, and may be a column."""
    at = F.pmod(F.lit(place) * 4, F.lit(124)) + 1 if isinstance(place, int) else F.pmod(place * 4, F.lit(124)) + 1
    number = F.conv(F.substr(digits, at.cast("int"), F.lit(4)), 16, 10).cast("long") + (F.lit(place) if isinstance(place, int) else place)
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))


def _like(value: Column, digits: Column, start: int = 0) -> Column:
    """Character for character another of the same sort, from position start on."""

    def swap(c: Column, i: Column) -> Column:
        out = c
        for sort, pattern in (("greek", r"\p{IsGreek}"), ("cyrillic", r"\p{IsCyrillic}"), ("accent", r"[À-ɏ]"), ("latin", r"[a-zA-Z]")):
            out = F.when(c.rlike(pattern) & c.rlike(r"\p{Lu}"), _pick(_LETTERS[f"{sort} upper"], digits, i)).when(c.rlike(pattern) & c.rlike(r"\p{L}"), _pick(_LETTERS[f"{sort} lower"], digits, i)).otherwise(out)
        return F.when(i < start, c).when(c.rlike(r"\d"), _pick("0123456789", digits, i)).otherwise(out)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), swap), "")


def _fresh(key: str) -> Column:
    """The surrogate of (kind, value) at its attempt."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    h = _hash(key, kind, attempt, value)
    wide = F.greatest(F.lit(0), attempt - (WIDEN - 1)).cast("int")
    more = F.substring(F.translate(h, "abcdef", "012345"), 65, 60)
    digits_more, letters_more = F.substr(more, F.lit(1), wide), F.substr(F.translate(h, "0123456789", "ghijklmnop"), F.lit(65), wide)
    domain = F.element_at(F.split(value, "@"), -1)
    email = F.concat(_like(F.substring_index(value, "@", 1), h), letters_more, F.lit("@"), _like(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.reverse(h)), F.lit("."), F.element_at(F.split(domain, r"\."), -1))
    octets = [F.pmod(F.conv(F.substring(h, 1 + 6 * n, 6), 16, 10).cast("long"), F.lit(254)) + 1 for n in range(4)]
    ip = F.when(wide > 0, F.concat_ws(".", *octets)).otherwise(F.array_join(F.transform(F.split(value, r"\."), lambda o, n: _octet(o, n, h)), "."))
    hexed = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, i: _pick("0123456789abcdef", h, i)), "")
    parts = [_pick(_PARTS[s], h, n) for s in _PARTS for n in (1, 2, 3)]
    by_script = {s: parts[3 * n : 3 * n + 3] for n, s in enumerate(_PARTS)}
    tail = {s: _tail(s, h, wide) for s in _PARTS}
    script = _script(value)
    family = reduce(lambda rest, s: F.when(script == s, F.concat(*by_script[s], tail[s])).otherwise(rest), _PARTS, F.lit(""))
    given = reduce(lambda rest, sg: F.when((script == sg.split()[0]) & (kind == f"given {sg.split()[1]}"), _pick(_GIVEN[sg], h, 1)).otherwise(rest), _GIVEN, F.lit(""))
    # the list of given names is short: from the second attempt on a family part follows
    given = F.when(attempt > 0, F.concat(given, reduce(lambda rest, s: F.when(script == s, F.concat(by_script[s][0], by_script[s][1], tail[s])).otherwise(rest), _PARTS, F.lit("")))).otherwise(given)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", F.concat(hexed, F.substr(h, F.lit(65), wide)))
        .when(kind == "iban", F.concat(_like(value, h, 2), digits_more)).when(kind == "card", F.concat(_like(value, h, 1), digits_more))
        .when(kind.isin("ssn", "phone"), F.concat(_like(value, h), digits_more)).when(kind == "family", F.initcap(family)).otherwise(F.initcap(given))
    )


def _tail(script: str, h: Column, parts: Column) -> Column:
    """So many more parts of a family name."""
    chars = F.filter(F.split(F.substr(h, F.lit(65), parts), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: _pick(_PARTS[script], h, i + 5)), "")


def _octet(octet: Column, n: Column, h: Column) -> Column:
    """A number of as many digits, 255 at most and not 0."""
    number = F.conv(F.substr(h, (n * 6 + 1).cast("int"), F.lit(6)), 16, 10).cast("long")
    size = F.length(octet)
    return (F.when(size == 1, F.pmod(number, F.lit(9)) + 1).when(size == 2, F.pmod(number, F.lit(90)) + 10).otherwise(F.pmod(number, F.lit(155)) + 100)).cast("string")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), without a clash in any kind."""
    originals = entities.select("kind", F.col("value").alias("surrogate")).withColumn("original", F.lit(True))
    done, todo = None, entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = todo.withColumn("surrogate", F.lower(_fresh(key)))
        mine = drawn.select("kind", "value", "attempt", "surrogate", F.lit(False).alias("settled"))
        everything = mine if done is None else mine.unionByName(done.select("kind", "value", F.lit(0).alias("attempt"), "surrogate", F.lit(True).alias("settled")))
        first = everything.groupBy("kind", "surrogate").agg(F.min(F.struct((~F.col("settled")).alias("fresh"), "value")).alias("first"))
        checked = written(
            mine.join(first, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
            .select("kind", "value", "attempt", "surrogate", (F.col("original").isNull() & F.col("first.fresh") & (F.col("first.value") == F.col("value"))).alias("good"))
        )
        good = checked.filter("good").select("kind", "value", "surrogate")
        done = good if done is None else done.unionByName(good)
        todo = checked.filter("NOT good").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done


def _in_case(mention: Column, surrogate: Column) -> Column:
    return F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)


def _in_format(mention: Column, surrogate: Column) -> Column:
    """The mention with its digits replaced in turn; digits left over follow at the end."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    place = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), (i + 1).cast("int")), r"\D", ""))
    body = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substr(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    return F.concat(body, F.substr(surrogate, F.length(F.regexp_replace(mention, r"\D", "")) + 1, F.lit(1000)))


def mentions(df: DataFrame, text: str, key: Column) -> DataFrame:
    """(key, pos, mention, kind, words): every detected mention of every text; words are a name's entities with kind and value."""
    found = df.select(key.alias("key"), F.regexp_extract_all(F.col(text), F.lit(ALL), F.lit(0)).alias("found")).filter(F.size("found") > 0)
    each = found.select("key", F.posexplode("found").alias("pos", "mention"))
    kind = _kind(F.col("mention"))
    return each.dropDuplicates(["key", "pos"]).withColumn("kind", kind)


def _entities(said: DataFrame) -> DataFrame:
    """(key, pos, part, mention, word, kind, value): a name's words are entities of their own, other mentions are one each."""
    name = F.filter(F.split(F.regexp_replace("mention", rf"^(?:{_TITLE})\.?[  ]", ""), " "), lambda w: w != "")
    title = F.regexp_extract("mention", rf"^({_TITLE})", 1)
    gender = reduce(lambda rest, g: F.when(title.isin(*_TITLES[g]), g).otherwise(rest), _TITLES, F.lit("n"))
    parts = F.when(F.col("kind") == "name", name).otherwise(F.array("mention"))
    split = said.select("key", "pos", "mention", "kind", gender.alias("gender"), F.size(parts).alias("of"), F.posexplode(parts).alias("part", "word"))
    kind = F.when(F.col("kind") != "name", F.col("kind")).when((F.col("part") == 0) & (F.col("of") > 1), F.concat(F.lit("given "), F.col("gender"))).otherwise(F.lit("family"))
    value = F.when(F.col("kind").isin(*_DIGITS), F.regexp_replace("word", r"\D", "")).when(F.col("kind") == "iban", F.replace("word", F.lit(" "), F.lit(""))).otherwise(F.lower("word"))
    return split.select("key", "pos", "part", "mention", "word", value.alias("value"), kind.alias("kind"))


def replace_pii(df: DataFrame, key: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with each detected entity replaced in the text, and n_replaced, the number of mentions."""
    row, arr = free_name(df, "pii_row"), free_name(df, "pii_found")
    row_of = F.xxhash64(F.col(id_col), F.col(text))
    said = written(mentions(df, text, row_of))
    parts = _entities(said)
    # kinds of one entity: a card's digits and a telephone's are told apart by kind
    pairs = surrogates(written(parts.select("kind", "value").distinct()), key)
    joined = parts.join(pairs, ["kind", "value"])
    word, surrogate = F.col("word"), F.col("surrogate")
    shown = (
        F.when(F.col("kind").isin(*_DIGITS), _in_format(word, surrogate)).when(F.col("kind") == "iban", _grouped(word, F.upper(surrogate)))
        .when(F.col("kind").startswith("given") | (F.col("kind") == "family"), _in_case(word, F.initcap(surrogate))).otherwise(_in_case(word, surrogate))
    )
    title = F.regexp_extract("mention", rf"^((?:{_TITLE})\.?[  ])", 1)
    lead = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), title).otherwise(F.lit(""))
    whole = joined.groupBy("key", "pos").agg(F.concat(F.first(lead), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", shown.alias("shown")))), lambda x: x["shown"]), " ")).alias("shown"))
    rendered = whole.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]).alias(arr)).withColumnRenamed("key", row)
    kept = df.drop("n_replaced")
    between = F.split(F.col(text), ALL, -1)
    put = F.array_join(F.zip_with(between, F.col(arr), lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
    out = kept.withColumn(row, row_of).join(rendered, row, "left")
    return out.withColumn(text, F.when(F.col(arr).isNull(), F.col(text)).otherwise(put)).withColumn("n_replaced", F.coalesce(F.size(arr), F.lit(0)).cast("long")).drop(row, arr)


def _grouped(mention: Column, surrogate: Column) -> Column:
    """The surrogate with the mention's spaces."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    place = lambda i: F.length(F.replace(F.substr(mention, F.lit(1), (i + 1).cast("int")), F.lit(" "), F.lit("")))
    body = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, place(i), F.lit(1)))), "")
    return F.concat(body, F.substr(surrogate, F.length(F.replace(mention, F.lit(" "), F.lit(""))) + 1, F.lit(1000)))
