"""Surrogates for personal data, in DataFrame functions only.

Found entities are replaced by keyed stand-ins of their own type and shape: digits stay digits, letters stay letters of
their case, separators stay; addresses of hosts come from a range that is never routed, mail domains end in .example,
card and bank account numbers pass their check, given names keep gender and script. An entity is one whatever the format
of its mentions (digits of a phone number, lower-cased mail address), so all its mentions get one stand-in. A given name
has the gender that the titles before it show, all over the corpus; where they differ or show none, a name of no gender.
The distinct entities of the corpus are checked: where two would share a stand-in, or one is an entity that really occurs,
all but the smallest draw again until none is left. Where a shape has too few stand-ins, further draws are longer with
each round, so this ends. Titles and the country codes of phone numbers stay as they are.

Words of a name that a document holds after a title are replaced wherever that document holds them, but for those that it
also holds in lower case (Mr. Green leaves a Green Park alone if something is green); case counts, SMITH is not Smith.

The key is in no plan: executors read keys made of it, one per kind, from rows, and plans show the rows' columns only.

A secret of separators alone gets letters; one separator over and over (`Password: ______`) is the blank of a form and none.

Contract of `replace_entities`: a null text stays null; every row gives a row, repeats and null ids too; equal texts
get equal replacements for one key within a corpus; all columns of the input are kept, whatever their names, but for one
named `n_entities`, which gives way to the count.
"""

from __future__ import annotations

import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_weighted, stage

#: The session setting that holds the key of the registered query; without it a key is drawn for each run. Spark hides
#: the values of settings with such a name.
KEY_SETTING = "spark.quarterweave.surrogates.secret"
#: From this attempt on a stand-in is `WIDER` characters longer with each attempt, so that no shape runs out of them.
WIDE_FROM, WIDER = 4, 8
#: Types in the order in which they are tried at a position, each with its pattern.
_TITLE_M, _TITLE_F, _TITLE_N = "Mr|Herr|Monsieur|Señor|господин|κύριος|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|госпожа|κυρία|Κυρία", "Dr|Prof"
#: A word of a name; what follows an apostrophe belongs to it if it starts with a capital (O'Neill), not in Smith's.
_NAME = r"\p{Lu}(?:\p{L}+|['’]\p{Lu}\p{L}+)(?:-\p{L}+|['’]\p{Lu}\p{L}+)*"
_WORD = rf"(?<!\p{{L}}){_NAME}(?!\p{{L}})"
#: Country codes: 1 and 7 alone, those of two digits, else three.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "cloud_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])|(?<![0-9])(?:[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5}|3[47][0-9]{13})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9+])(?<![0-9][.-])(?:[0-9]{1,3}[.-]|1 )?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![0-9]|[.-][0-9])",
    "secret": r"""(?<=[=:"']|[=:] )(?<=(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}["']?)(?!(?<same>[_/+.-])\k<same>*+(?![A-Za-z0-9_/+.-]))[A-Za-z0-9_/+.-]{6,}""",
    "name": rf"(?=[DFHMPSгκΚ])(?<!\p{{L}})(?:{_TITLE_M}|{_TITLE_F}|{_TITLE_N})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_GIVEN = {
    "m_latin": "Albert Bruno Carl Dario Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Quentin Robert Simon Tomas",
    "f_latin": "Anna Berta Clara Diana Emma Flora Greta Hanna Irene Julia Klara Laura Maria Nora Olga Paula Rosa Sofia Tina Vera",
    "n_latin": "Alex Andrea Chris Dana Eli Jamie Jules Kim Lee Luca Marian Nico Pat Robin Sam Sasha Toni Vivian Wren Yael",
    "m_cyrillic": "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур Фёдор Юрий Яков",
    "f_cyrillic": "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия",
    "n_cyrillic": "Саша Женя Валя Слава Шура Тоня Паша Вика Юля Лёля Митя Костя Гена Рома Лера Даня Ася Ника Мика Тося",
    "m_greek": "Άγγελος Αλέξης Βασίλης Γιάννης Δημήτρης Θάνος Ηλίας Κώστας Λεωνίδας Μάριος Νίκος Ορέστης Πέτρος Σπύρος Στέφανος Τάσος Φώτης Χρήστος Μιχάλης Σταύρος",
    "f_greek": "Άννα Αθηνά Βάσω Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νεφέλη Ξένια Ουρανία Πηνελόπη Ρένα Σοφία Φανή Χαρά",
    "n_greek": "Άρτεμις Αμβροσία Γεσθημανή Δάφνις Ζήνα Θέμις Ίρις Κάλλια Κλειώ Λίλα Μαρούλι Μέλπω Μυρτώ Νίκη Πάρι Ρέα Σίλια Τόνι Φοίβη Χλόη",
}
_SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra ro".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ро".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρο".split(),
}
_ALPHABETS = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщ", "greek": "αβγδεζηθικλμνξοπρστυφχψωάέ"}
KINDS = [*(k for k in PATTERNS if k != "name"), *(f"{role}_{script}" for role in ("given", "surname") for script in _SYLLABLES)]


def _holds_any(text: Column) -> Column:
    """Whether a text holds an entity; what every type needs is looked for first, as most texts have none of it."""
    maybe = text.contains("@") | text.rlike(r"[0-9]{2}|[0-9]\.[0-9]") | text.contains("AKIA") | text.rlike("[=:]") | text.rlike(PATTERNS["name"])  # what iban needs, two digits in a row, is there
    return F.coalesce(maybe & text.rlike(ANY), F.lit(False))


def _kind(mention: Column) -> Column:
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(rf"^(?:{PATTERNS['cloud_key']})$"), "cloud_key")
        .when(mention.rlike(rf"^(?:{PATTERNS['ip']})$"), "ip")
        .when(mention.rlike(rf"^(?:{PATTERNS['card']})$"), "card")
        .when(mention.rlike(rf"^(?:{PATTERNS['iban']})$"), "iban")
        .when(mention.rlike(rf"^(?:{PATTERNS['ssn']})$"), "ssn")
        .when(mention.rlike(rf"^(?:{PATTERNS['phone']})$"), "phone")
        .when(mention.rlike(rf"^(?:{PATTERNS['name']})$"), "name")
        .otherwise("secret")
    )


def _parts(mention: Column, kind: Column) -> Column:
    """A mention as parts (kind, raw, gender): a name as title, given name and surname, anything else as one."""
    title = F.split(mention, " ")[0]
    gender = F.when(title.rlike(rf"^(?:{_TITLE_M})\.?$"), "m").when(title.rlike(rf"^(?:{_TITLE_F})\.?$"), "f")

    def part(raw: Column, k: Column) -> Column:
        script = F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").when(raw.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        role = F.when(k == 0, F.lit("title")).when(k == F.size(F.split(mention, " ")) - 1, F.concat(F.lit("surname_"), script)).otherwise(F.concat(F.lit("given_"), script))
        return F.struct(role.alias("kind"), raw.alias("raw"), gender.alias("gender"))

    whole = F.struct(kind.alias("kind"), mention.alias("raw"), F.lit(None).cast("string").alias("gender"))
    return F.when(kind == "name", F.transform(F.split(mention, " "), part)).otherwise(F.array(whole))


def _canon(kind: Column, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    abroad = raw.rlike(r"^\+|^[0-9]{1,3}[ .-]?\(|^[0-9]{1,3}[ .-][0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$")  # a country code leads
    return (
        F.when((kind == "phone") & abroad, F.concat(F.lit("+"), digits))
        .when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(raw))
        .otherwise(raw)
    )


def _keys(spark: SparkSession, key: str) -> DataFrame:
    """(kind, key): a key for every kind, a few rows whose values no plan shows."""
    rows = [(k, hmac.new(key.encode(), k.encode(), "sha256").hexdigest()) for k in KINDS]
    return F.broadcast(spark.createDataFrame(rows, "kind string, key string"))


def _stream(kind: Column, canon: Column, attempt: Column, key: Column) -> Column:
    """Hexadecimal digits drawn from the key, hashed in it twice; longer than any entity is, they repeat after 512."""
    inner = [F.sha2(F.concat_ws("\x1f", key, F.lit(str(k)), kind, attempt.cast("string"), canon), 512) for k in range(4)]
    draws = [F.sha2(F.concat_ws("\x1f", key, x), 512) for x in inner]
    return F.repeat(F.concat(*draws), (F.length(canon) / 256).cast("int") + 1)


def _shaped(text: Column, stream: Column) -> Column:
    """`text` with every digit and ASCII letter replaced by one of its class, as the stream says."""

    hexadecimal = text.rlike("^[0-9a-f]{8,}$")

    def one(c: Column, k: Column) -> Column:
        draw = F.conv(F.substring(stream, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
        letter = draw % F.when(hexadecimal, 6).otherwise(26)
        return (
            F.when(c.between("0", "9"), (draw % 10).cast("string"))
            .when(c.between("a", "z"), F.chr(letter + 97))
            .when(c.between("A", "Z"), F.chr(letter + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _pick(words: list[str], stream: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.conv(F.substring(stream, at, 4), 16, 10).cast("int") % len(words) + 1)


def _iban(shaped: Column, canon: Column) -> Column:
    """Country of `canon`, check digits, account of `shaped`: letters count 10 to 35, and all modulo 97 is 1."""
    account = F.substring(shaped, F.lit(5), F.length(canon))
    moved = F.concat(account, F.substring(canon, 1, 2), F.lit("00"))
    number = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + number(c)) % 97)
    return F.concat(F.substring(canon, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), account)


def surrogate(kind: Column, canon: Column, attempt: Column, key: Column | str, gender: Column | None = None) -> Column:
    """The stand-in of an entity; another one for each attempt. A key given as text stands in the plan."""
    key = F.lit(key) if isinstance(key, str) else key
    gender = F.lit(None) if gender is None else gender
    stream = _stream(kind, canon, attempt, key)
    bare = (kind == "secret") & ~canon.rlike("[A-Za-z0-9]")  # nothing in it would change
    shaped = _shaped(F.when(bare, F.regexp_replace(canon, "(?s).", "x")).otherwise(canon), stream)
    # Digits where the format asks for them, else letters; a stream of its own, as that of the shape may be used up.
    longer = F.greatest(attempt - (WIDE_FROM - 1), F.lit(0)) * WIDER
    spare = _stream(F.lit("longer"), F.concat_ws("\x1f", kind, canon), attempt, key)
    form = F.when(kind.isin("card", "ssn", "phone"), F.lit("0")).when(kind.isin("cloud_key", "iban"), F.lit("Z")).otherwise(F.lit("z"))
    suffix = F.when(longer > 0, _shaped(F.repeat(form, longer), spare)).otherwise("")
    for script, letters in _ALPHABETS.items():
        suffix = F.when(kind.endswith(f"_{script}"), F.translate(suffix, "abcdefghijklmnopqrstuvwxyz", letters)).otherwise(suffix)

    def octet(at: int, low: int) -> Column:
        of_host = F.conv(F.substring(stream, at, 2), 16, 10).cast("int") % (256 - low) + low
        of_none = F.conv(F.substring(spare, 2 * at, 4), 16, 10).cast("int") % (744 if low else 1000) + (256 if low else 0)  # numbers no host has
        return F.when(longer > 0, of_none).otherwise(of_host).cast("string")

    domain = _shaped(F.element_at(F.split(canon, "@"), -1), _stream(F.lit("domain"), F.element_at(F.split(canon, "@"), -1), F.lit(0), key))
    body = F.substring(shaped, F.lit(1), F.length(canon) - 1)  # every other digit from its end doubles
    digits = F.transform(F.split(body, ""), lambda c, k: F.when((F.length(canon) - k) % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    check = (10 - F.aggregate(digits, F.lit(0), lambda x, y: x + y) % 10) % 10
    code = F.regexp_extract(canon, _COUNTRY, 1)
    out = (
        F.when(kind == "email", F.concat(F.substring_index(shaped, "@", 1), suffix, F.lit("@"), F.substring_index(domain, ".", 1), F.lit(".example")))
        .when(kind == "cloud_key", F.concat(F.lit("AKIA"), F.substring(shaped, 5, 100)))
        .when(kind == "ip", F.concat_ws(".", octet(1, 240), octet(3, 0), octet(5, 0), octet(7, 0)))
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(kind == "iban", _iban(shaped, canon))
        .when((kind == "phone") & canon.startswith("+"), F.concat(F.lit("+"), code, F.substring(shaped, F.length(code) + 2, F.length(canon))))
    )
    for script, syllables in _SYLLABLES.items():
        # Gives 64 million surnames; further attempts add a syllable.
        more = F.when(attempt > 0, _pick(syllables, stream, 41)).otherwise("")
        out = out.when(kind == f"surname_{script}", F.initcap(F.concat(*[_pick(syllables, stream, 5 * k + 1) for k in range(6)], more)))
        # A list of names runs out soon; then a syllable tells bearers apart.
        extra = F.when(attempt > 1, F.concat(F.lit("-"), F.initcap(F.concat(*[_pick(syllables, stream, 5 * k + 1) for k in range(5)])))).otherwise("")
        given = {g: _pick(_GIVEN[f"{g}_{script}"].split(), stream, 33) for g in "mfn"}
        out = out.when(kind == f"given_{script}", F.concat(F.when(gender == "m", given["m"]).when(gender == "f", given["f"]).otherwise(given["n"]), extra))
    return F.concat(out.otherwise(shaped), F.when(kind.isin("email", "ip"), "").otherwise(suffix))


def _formatted(kind: Column, raw: Column, stand_in: Column) -> Column:
    """The stand-in in the format of one mention: its characters go where the mention has digits (of an account number,
    anything but blanks), those left over to its end."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    open_ = lambda c: F.when(kind == "iban", c != " ").otherwise(c.between("0", "9"))
    stand_in = F.when(kind == "phone", F.ltrim(stand_in, F.lit("+"))).otherwise(stand_in)
    filled = F.aggregate(
        F.split(raw, ""),
        start,
        lambda s, c: F.struct(
            F.concat(s["text"], F.when(open_(c), F.substring(stand_in, s["used"] + 1, F.lit(1))).otherwise(c)).alias("text"),
            (s["used"] + F.when(open_(c), 1).otherwise(0)).alias("used"),
        ),
    )
    filled = F.concat(filled["text"], F.substring(stand_in, filled["used"] + 1, F.length(stand_in)))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), filled).otherwise(stand_in)


def _marks(text: Column, names: Column) -> Column:
    """The entities of a text as (mention, word), in order; where it holds `names`, its capitalised words too."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("mention"), F.lit(False).alias("word")))
    words = lambda gap: F.transform(F.regexp_extract_all(gap, F.lit(_WORD), F.lit(0)), lambda w: F.struct(w.alias("mention"), F.lit(True).alias("word")))
    both = F.zip_with(F.split(text, ANY, -1), found, lambda gap, m: F.concat(words(gap), F.when(m.isNotNull(), F.array(m)).otherwise(F.slice(found, 1, 0))))
    return F.when(names, F.flatten(both)).otherwise(found)


def _gaps(text: Column, names: Column) -> Column:
    """What stands before, between and after `_marks`."""
    gaps = F.split(text, ANY, -1)
    return F.when(names, F.flatten(F.transform(gaps, lambda gap: F.split(gap, _WORD, -1)))).otherwise(gaps)


def _names_again(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """`parts`, where a word that is part of a name of its text has that name's kind. `texts` (p_, t) are those with names."""
    words = parts.where("kind = 'word'")
    small = texts.select("p_", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?<!\p{L})\p{Ll}[\p{L}'’-]*"), F.lit(0)))).alias("small")).distinct()
    roles = parts.where("kind like 'given\\_%' or kind like 'surname\\_%'").groupBy(F.col("p").alias("p_"), F.col("canon").alias("canon_")).agg(F.max("kind").alias("role"))
    roles = roles.join(small.withColumnRenamed("p_", "of"), (F.col("p_") == F.col("of")) & (F.lower("canon_") == F.col("small")), "left_anti")
    counts = words.groupBy(F.col("p").alias("p_"), F.col("canon").alias("canon_")).agg(F.count(F.lit(1)).alias("n_"))
    counts = stage(counts.join(roles, ["p_", "canon_"], "left"), "words")
    total = counts.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    told = join_weighted(words, counts, {"p": "p_", "canon": "canon_"}, "n_", total).drop("n_")
    told = told.withColumn("kind", F.coalesce("role", "kind")).drop("role")
    return parts.where("kind <> 'word'").unionByName(stage(told, "again"))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, stand_in, the other columns) for distinct `entities` (kind, canon, gender, ...), no two of a kind with
    one stand-in and none whose stand-in is an entity itself."""
    more = [c for c in entities.columns if c not in ("kind", "canon", "attempt", "stand_in")]
    of = lambda attempt: surrogate(F.col("kind"), F.col("canon"), attempt, F.col("key"), F.col("gender"))
    keys = _keys(entities.sparkSession, key)
    drawn = stage(entities.join(keys, "kind").select("kind", "canon", *more, F.lit(0).alias("attempt"), of(F.lit(0)).alias("stand_in")), "drawn")
    while True:  # draws get longer, so that sooner or later all differ
        first = drawn.groupBy("kind", "stand_in").agg(F.min("canon").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        real = drawn.select("kind", F.col("canon").alias("stand_in"), F.lit(True).alias("real"))
        checked = drawn.join(first, ["kind", "stand_in"], "left").join(real, ["kind", "stand_in"], "left")
        clash = F.coalesce(F.col("real"), F.lit(False)) | F.coalesce(F.col("canon") > F.col("first"), F.lit(False))
        checked = stage(checked.select("kind", "canon", *more, "attempt", "stand_in", clash.alias("clash")), "checked")
        if not checked.where("clash").limit(1).count():
            return drawn.drop("attempt")
        again = F.col("attempt") + F.col("clash").cast("int")
        anew = F.when(F.col("clash"), of(again)).otherwise(F.col("stand_in"))
        drawn = stage(checked.join(keys, "kind").select("kind", "canon", *more, again.alias("attempt"), anew.alias("stand_in")), "drawn")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with `text_col` replaced, and n_entities long; only texts that hold entities are shuffled.

    `key` is a secret: who has it can test whether a stand-in belongs to an entity.
    """
    if not key:
        raise ValueError("surrogates need a key")
    own = "s_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    name = lambda c: f"{own}{c}"  # noqa: E731  (columns added to those of `docs`)
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    print_, holds = F.xxhash64(text), _holds_any(text)
    names = F.col(name("names"))
    some, none = stage(docs.where(holds).withColumn(name("names"), text.rlike(PATTERNS["name"])), "holders"), docs.where(~holds)  # few texts, which the steps below read
    mentions = some.select(id_.alias("i"), print_.alias("p"), F.posexplode(_marks(text, names)).alias("at", "m")).select("i", "p", "at", "m.*")
    parts = mentions.withColumn("kind", F.when(F.col("word"), "word").otherwise(_kind(F.col("mention")))).select("i", "p", "at", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("part", "x"))
    parts = stage(parts.select("i", "p", "at", "part", "x.kind", "x.raw", "x.gender", _canon(F.col("x.kind"), F.col("x.raw")).alias("canon")), "mentions")
    parts = _names_again(parts, some.where(names).select(print_.alias("p_"), text.alias("t")))
    named = parts.where("kind not in ('title', 'word')")
    entities = named.groupBy("kind", "canon").agg(F.min("gender").alias("g1"), F.max("gender").alias("g2"), F.count(F.lit(1)).alias("n"))
    entities = entities.select("kind", "canon", F.when(F.col("g1") == F.col("g2"), F.col("g1")).alias("gender"), "n")
    table = distinct_surrogates(entities, key).drop("gender").withColumnsRenamed({"kind": "kind_", "canon": "canon_"})
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = join_weighted(named, table, {"kind": "kind_", "canon": "canon_"}, "n", total)
    new = lambda c: F.struct("part", c.alias("new"), (F.col("kind") != "word").alias("is")).alias("x")
    told = told.select("i", "p", "at", new(_formatted(F.col("kind"), F.col("raw"), F.col("stand_in")))).unionByName(parts.where("kind in ('title', 'word')").select("i", "p", "at", new(F.col("raw"))))
    # A mention has three parts at most; a document's mentions are bounded by its text. Sets, as rows may repeat.
    whole = told.groupBy("i", "p", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_set("x")), lambda x: x["new"]), " ").alias("new"), F.max("x.is").cast("long").alias("is"))
    by_doc = whole.groupBy("i", "p").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"), F.sum("is").alias("n"))
    by_doc = by_doc.select(*[F.col(c).alias(name(c)) for c in ("i", "p", "new", "n")])
    joined = some.join(by_doc, id_.eqNullSafe(F.col(name("i"))) & (print_ == F.col(name("p"))))
    rebuilt = F.array_join(F.zip_with(_gaps(text, names), name("new"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = joined.select(*[rebuilt.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns], F.col(name("n")).alias("n_entities"))
    return changed.unionByName(none.select("*", F.lit(0).cast("long").alias("n_entities")))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace_entities(docs.select("doc_id", "text"), session_key(spark)).select("doc_id", "text", "n_entities")
