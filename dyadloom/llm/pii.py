"""Surrogates for personal data; DataFrame functions only.

Texts are searched once. Found strings are reduced to entities: two spellings of a
telephone number are one, and a person is a given and a family name, so that a short
mention keeps the family name of the full one. Each distinct entity of the corpus gets a
keyed surrogate of its own kind, and surrogates are checked in rounds: one that another
entity has, or that is itself an entity found, is drawn anew. A spelling then takes the
surrogate in its own layout, and texts are rebuilt between the found strings. Entities,
not texts, are compared, so an address in a third of all documents is one row, and only
rows in which something was found are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Tasks among which entities are dealt for drawing, and rounds after which a kind is full.
TASKS, ROUNDS = 64, 60

# Fixed formats of what is looked for, in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"
_QUAD = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])"
_DIALLED = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})"
# where a telephone can end before an address it does, else it has the address's digits too
PHONE = rf"{_DIALLED}(?:(?![ -]{_QUAD})[ .-]?[0-9]{{2,4}}){{2,4}}(?![0-9])|{_DIALLED}(?:[ .-]?[0-9]{{2,4}}){{2,4}}(?![0-9])|(?<![0-9A-Za-z(])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])"
IP = rf"(?<![0-9.]){_QUAD}"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7})(?![0-9])"
_V6 = r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
MEN = ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Господин", "Κύριος")
WOMEN = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Госпожа", "Κυρία")
EITHER = ("Dr", "Prof")
TITLES = "|".join(dict.fromkeys(f(t) for t in sorted((*MEN, *WOMEN, *EITHER), key=len, reverse=True) for f in (str, str.upper)))
#: Given names that are taken for one without a title, if a name follows.
KNOWN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Hans Peter Klaus Wolfgang Jürgen Pierre Jean Michel François José Juan Carlos Antonio Иван Сергей Александр Дмитрий Андрей Γιώργος Κώστας Δημήτρης Νίκος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Alice Anna Ursula Sabine Petra Marie Sophie Isabelle Claire María Carmen Lucía Ana Мария Елена Ольга Наталья Анна Μαρία Ελένη Κατερίνα Σοφία".split(),
}
_WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
_HAN = r"\p{IsHan}{2,4}"
NAME = rf"(?<![\p{{L}}0-9])(?:(?:{TITLES})\.? (?:{_WORD}(?: {_WORD}){{0,2}}|{_HAN})|(?:{'|'.join((*KNOWN['m'], *KNOWN['f']))})(?: {_WORD}){{1,2}}|{_HAN}(?=先生|女士|小姐))"
KINDS = {"email": EMAIL, "name": NAME, "secret": SECRET, "ipv6": _V6, "iban": IBAN, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

#: Syllables of surrogate names, and endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de di fa ga ge ha ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se ta to va".split(),
    "cyrillic": "ба бе бо да де ди фа га ге ха ка ке ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та то ва".split(),
    "greek": "βα βε βο δα δε δι φα γα γε χα κα κε λα λε λι λο μα με μι μο να νε νο ρα ρε ρι ρο σα σε τα το ζα".split(),
    "han": "林 江 山 石 田 木 水 云 文 明 华 国 平 安 民 春 秋 东 南 西 北 中 天 地 光 星 月 青 白 金 玉 海".split(),
}
ENDINGS = {
    "latin": {"m": "rd", "f": "na", "x": "l"},
    "cyrillic": {"m": "н", "f": "на", "x": "ль"},
    "greek": {"m": "ς", "f": "νη", "x": "λι"},
}


# --- expressions ------------------------------------------------------------------------


def kind_of(found: Column) -> Column:
    """The first kind whose format it has. Long numbers are cards, and account numbers
    accounts, only if their check digits say so; else they are nobody's."""
    out = F.lit(None).cast("string")
    gate = {"card": _luhn_holds(_digits(found)), "iban": _mod97(_turned(F.regexp_replace(found, " ", ""))) == 1}
    for kind, pattern in reversed(KINDS.items()):
        is_one = found.rlike(f"^(?:{pattern})$") if kind != "name" else found.rlike(f"^(?:{NAME})$") | found.rlike(f"^{_HAN}$")
        out = F.when(is_one, F.when(gate[kind], F.lit(kind)) if kind in gate else F.lit(kind)).otherwise(out)
    return out


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _canonical(kind: Column, found: Column) -> Column:
    """One string for all spellings of an entity. A telephone number of ten digits is the
    same with and without the code 1 of its country."""
    digits = _digits(found)
    return (
        F.when((kind == "email") | ((kind == "secret") & ~found.startswith("AKIA")) | (kind == "ipv6"), F.lower(found))
        .when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .otherwise(found)
    )


def _turned(account: Column) -> Column:
    """An account number as its check digits are reckoned: country and digits last."""
    return F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _drawn(seed: Column, n: int) -> list[Column]:
    """``n`` numbers below 65536 that follow from ``seed``."""
    hexes = F.concat(*(F.sha2(F.concat_ws("|", F.lit(str(k)), seed), 512) for k in range(-(-n // 32))))
    return [F.conv(F.substring(hexes, 4 * k + 1, 4), 16, 10).cast("int") for k in range(n)]


def _per_character(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Digits for digits, capitals for capitals, small letters for small letters."""
    stream = F.concat(*(F.sha2(F.concat_ws("|", F.lit(str(k)), seed), 512) for k in range(4)))
    number = lambda i: F.conv(F.substr(stream, (i % 128) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    pick = lambda letters, n: F.substr(F.lit(letters), n + 1, F.lit(1))

    def one(i: Column) -> Column:
        c, n = F.substr(text, i + 1, F.lit(1)), number(i)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.when(hexadecimal, pick("abcdef", n % 6)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", n % 26)))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n % 26))
            .otherwise(c)
        )

    return F.when(F.length(text) > 0, F.concat_ws("", F.transform(F.sequence(F.lit(0), F.length(text) - 1), one))).otherwise("")


def _luhn(digits: Column) -> Column:
    """The check digit that makes ``digits`` and it a valid card number."""
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.transform(places, lambda i: value(i) - F.when(value(i) > 9, 9).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return (10 - total % 10) % 10


def _luhn_holds(digits: Column) -> Column:
    n = F.length(digits)
    return F.when(n > 1, _luhn(F.substr(digits, F.lit(1), n - 1)) == F.substr(digits, n).cast("int")).otherwise(F.lit(False))


def _named(kind: Column, entity: Column, seed: Column, nonce: Column) -> Column:
    """A given or family name in the script of ``entity``, in small letters; further draws
    have more syllables, so there are always enough."""
    n = _drawn(seed, 8)
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").when(entity.rlike(r"\p{IsHan}"), "han").otherwise("latin")
    out = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        part = F.array(*(F.element_at(F.array(*map(F.lit, syllables)), k % len(syllables) + 1) for k in n))
        many = F.length(entity) if s == "han" else F.least(F.lit(8), F.when(kind == "family", 3).otherwise(2) + F.floor(nonce / 4).cast("int"))
        end = F.lit("")
        for g, ending in ENDINGS.get(s, {}).items():
            end = F.when(kind == f"given-{g}", ending).otherwise(end)
        out = F.when(script == s, F.concat(F.array_join(F.slice(part, F.lit(1), many), ""), end)).otherwise(out)
    return out


def surrogate(kind: Column, entity: Column, nonce: Column, key: str) -> Column:
    """A keyed draw for an entity; another nonce gives another draw."""
    seed = F.concat_ws("|", F.lit(key), kind, entity, nonce.cast("string"))
    swapped = _per_character(entity, seed, kind.isin("secret", "ipv6"))
    n = _drawn(seed, 4)
    local, domain = F.split_part(entity, F.lit("@"), F.lit(1)), F.split_part(entity, F.lit("@"), F.lit(2))
    ending = F.regexp_extract(domain, r"\.[^.]+$", 0)
    host = F.when(F.size(F.split(domain, r"\.")) > 2, F.concat(_per_character(F.regexp_extract(domain, r"^[^.]+", 0), F.concat(seed, F.lit("host")), F.lit(False)), F.lit("."))).otherwise("")
    # short local parts are too few to differ: two characters more from the second draw on
    more = F.when(nonce > 0, F.concat(F.lit("."), F.lpad(F.hex(n[0]), 4, "0"))).otherwise("")
    mail = F.concat(F.lower(_per_character(local, seed, F.lit(False))), F.lower(more), F.lit("@"), host, F.lit("example"), ending)
    # of a telephone number the first digit, which begins the country's code, stays
    phone = F.concat(F.substring(entity, 1, 1), F.lpad((n[1] % 8 + 2).cast("string"), 1, "0"), F.substr(swapped, F.lit(3)))
    body = F.substr(swapped, F.lit(1), F.length(entity) - 1)
    card = F.concat(body, _luhn(body).cast("string"))
    rest = F.substr(swapped, F.lit(5))
    check = 98 - _mod97(F.concat(rest, F.substring(entity, 1, 2), F.lit("00")))
    octet = F.split(entity, r"\.")
    inner = lambda k: (n[k] % 254 + 1).cast("string")
    # an address of a private range stays in it, any other stays outside of them
    address = (
        F.when(octet[0].isin("10", "127"), F.concat_ws(".", octet[0], inner(1), inner(2), inner(3)))
        .when(entity.rlike(r"^192\.168\."), F.concat_ws(".", octet[0], octet[1], inner(2), inner(3)))
        .when(entity.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", octet[0], octet[1], inner(2), inner(3)))
        .otherwise(F.concat_ws(".", (n[0] % 80 + 20).cast("string"), inner(1), inner(2), inner(3)))
    )
    return (
        F.when(kind == "email", mail)
        .when(kind.startswith("given") | (kind == "family"), _named(kind, entity, seed, nonce))
        .when(kind == "ip", address)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), F.lpad(check.cast("string"), 2, "0"), rest))
        .when(entity.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substr(swapped, F.lit(5))))
        .otherwise(swapped)
    )


def _in_layout(kind: Column, found: Column, entity: Column, own: Column) -> Column:
    """The surrogate as ``found`` was written: its separators, or its capitals."""
    own = F.when((kind == "phone") & (F.length(_digits(found)) == F.length(own) + 1), F.concat(F.lit("1"), own)).otherwise(own)
    shape = F.aggregate(
        F.split(found, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[A-Z0-9]"), F.struct(F.concat(a["out"], F.substr(own, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
    )["out"]
    capital = (kind == "email") | ((kind == "secret") & ~found.startswith("AKIA")) | (kind == "ipv6")
    return F.when(kind.isin("phone", "card", "ssn", "iban") & (found != entity), shape).when(capital & (found == F.upper(found)), F.upper(own)).otherwise(own)


# --- the corpus ---------------------------------------------------------------------------


def _with_names(kinds: DataFrame) -> DataFrame:
    """(found, place, kind, entity, word) of every name: its words, without the title."""
    title = F.regexp_extract("found", rf"^(?:{TITLES})\.? ", 0)
    bare = F.regexp_replace(title, r"\.? $", "")
    words = F.split(F.substr(F.col("found"), F.length(title) + 1), " ")
    upper = lambda names: [f(t) for t in names for f in (str, str.upper)]
    gender = F.when(bare.isin(*upper(MEN)), "m").when(bare.isin(*upper(WOMEN)), "f").when(words[0].isin(*KNOWN["m"]), "m").when(words[0].isin(*KNOWN["f"]), "f").otherwise("x")
    each = kinds.filter("kind = 'name'").select("found", gender.alias("gender"), F.size(words).alias("n"), F.posexplode(words).alias("place", "word"))
    last = F.col("place") == F.col("n") - 1
    return each.select("found", "place", F.when(last, "family").otherwise(F.concat(F.lit("given-"), "gender")).alias("kind"), F.lower("word").alias("entity"), "word")


def entities(found: DataFrame, key: str) -> DataFrame:
    """(kind, entity, own) for the distinct (kind, entity) of ``found``: distinct
    surrogates, none of them an entity itself. One flag a round reaches the driver."""
    every = settle(found.select("kind", "entity").distinct(), "entities")
    taken = every.select("kind", F.col("entity").alias("own"))
    todo, done = every, None
    for nonce in range(ROUNDS):
        drawn = todo.repartition(TASKS, "entity").withColumn("own", surrogate(F.col("kind"), F.col("entity"), F.lit(nonce), key))
        first = Window.partitionBy("kind", "own").orderBy("entity")
        drawn = drawn.withColumn("first", F.row_number().over(first) == 1)
        used = taken if done is None else taken.unionByName(done.select("kind", "own"))
        marked = drawn.join(used.distinct().withColumn("used", F.lit(True)), ["kind", "own"], "left")
        marked = settle(marked.withColumn("good", F.col("first") & F.col("used").isNull()).select("kind", "entity", "own", "good"), "drawn")
        good = marked.filter("good").drop("good")
        done = good if done is None else done.unionByName(good)
        todo = marked.filter("not good").select("kind", "entity")
        if todo.isEmpty():
            return done
    raise ValueError("a kind of entity has no surrogates left; shorten what is matched or widen its format")


def surrogates(kinds: DataFrame, key: str) -> DataFrame:
    """(kind, found, surrogate) of (kind, found)."""
    plain = kinds.filter("kind <> 'name'").withColumn("entity", _canonical(F.col("kind"), F.col("found")))
    words = settle(_with_names(kinds), "words")
    own = entities(plain.select("kind", "entity").unionByName(words.select("kind", "entity")), key)
    spelled = plain.join(own, ["kind", "entity"]).select("kind", "found", _in_layout(F.col("kind"), F.col("found"), F.col("entity"), F.col("own")).alias("surrogate"))
    whole = (F.col("word") == F.upper("word")) & (F.col("word") != F.lower("word"))
    cased = words.join(own, ["kind", "entity"]).select("found", "place", F.when(whole, F.upper("own")).otherwise(F.initcap("own")).alias("own"))
    named = cased.groupBy("found").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "own"))), lambda x: x["own"]), " ").alias("own"))
    named = named.select(F.lit("name").alias("kind"), "found", F.concat(F.regexp_extract("found", rf"^(?:{TITLES})\.? ", 0), F.col("own")).alias("surrogate"))
    # a family or given name alone, for later mentions in a text that has the full one
    alone = cased.join(words.select("found", "place", "word"), ["found", "place"])
    return spelled.unionByName(named).withColumn("words", F.lit(None).cast("array<struct<word:string,own:string>>")).unionByName(
        alone.filter(F.length("word") > 2).groupBy("found").agg(F.collect_set(F.struct("word", "own")).alias("words")).select(F.lit("words").alias("kind"), "found", F.lit(None).cast("string").alias("surrogate"), "words")
    )


def replace(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(texts, mapping): ``texts`` has the columns of ``docs`` with ``text`` rewritten and
    ``n_chars``, if there is one, its new length; a struct ``row`` holds them, beside
    ``n_replaced``. ``mapping`` has (kind, found, surrogate).

    The same ``key`` gives the same surrogates, another one others; whoever has it can
    test guesses, so it is to be kept like a password. Null and empty texts stay, texts
    are searched whole however long, and equal texts come out alike, whatever their ids.
    An empty table gives none. Columns of any name pass.
    """
    if not key:
        raise ValueError("surrogates need a key")
    text = F.col("text").cast("string")
    found = F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    rows = settle(docs.select(F.struct("*").alias("row"), found.alias("found"), F.monotonically_increasing_id().alias("place")), "searched")
    some = rows.filter(F.size("found") > 0)
    kinds = some.select(F.explode(F.array_distinct("found")).alias("found")).distinct()
    kinds = settle(kinds.withColumn("kind", kind_of(F.col("found"))).filter("kind is not null"), "spellings")
    told = settle(surrogates(kinds, key), "mapping")
    mapping = told.filter("kind <> 'words'").drop("words")
    each = some.select("place", F.posexplode("found").alias("nth", "found"))
    alone = some.select("place", F.explode(F.array_distinct("found")).alias("found")).join(told.filter("kind = 'words'").select("found", "words"), "found")
    alone = alone.groupBy("place").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    known = each.join(mapping, "found").groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("nth", "surrogate"))).alias("known")).join(alone, "place", "left")
    old = F.col("row.text").cast("string")
    between = F.transform(F.split(old, ANY), lambda b: F.aggregate(
        F.coalesce("words", F.array().cast("array<struct<word:string,own:string>>")), b,
        lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}0-9])"), w["word"], F.lit(r"(?![\p{L}0-9])")), w["own"]),
    ))
    spelled = F.transform("found", lambda e, k: F.coalesce(F.element_at("known", k), e))
    new = F.concat_ws("", F.zip_with(between, spelled, lambda b, e: F.concat(F.coalesce(b, F.lit("")), F.coalesce(e, F.lit("")))))
    changed = some.join(known, "place").withColumn("new", new)
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(dict(docs.dtypes)["n_chars"]))
    changed = changed.select(row.alias("row"), F.size("known").cast("long").alias("n_replaced"))
    gone = some.join(known.select("place"), "place", "left_anti")
    same = rows.filter(F.size("found") == 0).select("row").unionByName(gone.select("row")).withColumn("n_replaced", F.lit(0).cast("long"))
    return changed.unionByName(same), mapping
