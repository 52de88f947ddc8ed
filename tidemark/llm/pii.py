"""Personal data replaced by keyed, type-consistent surrogates (DataFrame operations only)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

KEY = "tidemark"
#: Forms of address by the gender they tell, in several languages.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Madam", "Госпожа", "г-жа")
#: Given names and the syllables of surnames by script.
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Noah", "Oscar", "Paul"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Мария"),
    ("m", "greek"): ("Αντώνης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Νίκος"),
    ("f", "greek"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία"),
}
SYLLABLES = {
    "latin": ("ba", "den", "fi", "gor", "hal", "jo", "kem", "lin", "mar", "nov", "pel", "ros", "san", "tor", "vel", "wen"),
    "cyrillic": ("ба", "ден", "ви", "гор", "зал", "жо", "кем", "лин", "мар", "нов", "пел", "рос", "сан", "тор", "вел", "мен"),
    "greek": ("βα", "δεν", "φι", "γορ", "χαλ", "ζο", "κεμ", "λιν", "μαρ", "νοβ", "πελ", "ρος", "σαν", "τορ", "βελ", "μεν"),
}
#: Characters that stand for one another, by class of a regular expression. The first class that fits holds;
#: letters of other scripts become Latin ones, and letters that have upper case keep their case.
ALPHABETS = (
    (r"[0-9]", "0123456789"), (r"[a-zA-Z]", "abcdefghijklmnopqrstuvwxyz"), (r"[\x{0660}-\x{0669}]", "٠١٢٣٤٥٦٧٨٩"), (r"[\x{06F0}-\x{06F9}]", "۰۱۲۳۴۵۶۷۸۹"), (r"[\x{0966}-\x{096F}]", "०१२३४५६७८९"),
    (r"[\x{FF10}-\x{FF19}]", "０１２３４５６７８９"), (r"\p{Nd}", "0123456789"), (r"\p{IsCyrillic}", "абвгдежзийклмнопрстуфхцчшщыэюя"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"\p{IsHan}", "山水火木金土日月人口手目耳心石田花草雨雪"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하"), (r"\p{IsThai}", "กขคงจชซดตถทนบปผพมยรลวสหอ"), (r"\p{IsDevanagari}", "अआइईउऊएकखगघचछजझटठडढणतथदधन"), (r"[\p{L}\p{N}]", "abcdefghijklmnopqrstuvwxyz"),
)
_TITLE = "|".join(MALE + FEMALE)
#: One of these at a place, tried in this order: email, iban, ip, ssn, card, phone, name. Names are one or two capitalised words after
#: a form of address; an address has a letter or digit on both sides of its @. Groups that repeat without a bound are
#: possessive: Java then loops, where it would otherwise recurse once for each repetition and overflow its stack.
PATTERN = (
    r"(?<![\p{L}\p{N}._%+-])[._%+-]*+[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@-*+[\p{L}\p{N}][\p{L}\p{N}-]*+(?:\.[\p{L}\p{N}-]++)++"
    r"|(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
    r"|(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"
    r"|(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
    r"|(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
    r"|(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
    rf"|(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?(?!\p{{L}})"
)
#: Put around matches to cut a text at them; no letter or sign of a regular expression. Texts that hold it are cut by other means.
CUT = "\x01\x02\x01"
#: What any match must contain, to pass over most texts.
HINT = rf"[0-9]|@|(?:{_TITLE})\.? \p{{Lu}}"
#: Replacement rounds with surrogates of the identity's own length; each leaves only those that collided. Where a form is
#: full by then, the surrogates left grow by one character a round, so that rounds end whatever the number of real ids.
SAME_LENGTH = 8


def _kind(match: Column) -> Column:
    """The kind of a match, told again from its form, which the kinds don't share."""
    title = F.regexp_extract(match, rf"^({_TITLE})\.? ", 1)
    gender = F.when(title.isin(*MALE), F.lit("m")).otherwise(F.lit("f"))
    return (
        F.when(match.contains("@"), F.lit("email")).when(title != "", F.concat(F.lit("name_"), gender)).when(match.rlike(r"^[A-Z]{2}\d{2}"), F.lit("iban"))
        .when(match.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit("ip")).when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn")).when(match.rlike(r"^\d{4}([ -]?\d{4}){2}[ -]?\d{1,7}$"), F.lit("card"))
        .otherwise(F.lit("phone"))
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _identities(match: Column, kind: Column) -> Column:
    """array of struct(kind, id): what is the same person or account in whatever form; a name has one for each word."""
    words = F.slice(F.split(match, r"\.? "), 2, 2)
    gender = F.substring(kind, -1, 1)

    def name(word: Column, at: Column) -> Column:
        last = at == F.size(words) - 1
        of = F.when(last, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender))
        return F.struct(F.concat(of, F.lit("_"), _script(word)).alias("kind"), F.lower(word).alias("id"))

    plain = F.when(kind.isin("email", "ip"), F.lower(match)).otherwise(F.regexp_replace(match, r"[^A-Za-z0-9]", ""))
    return F.when(kind.startswith("name"), F.transform(words, name)).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("id"))))


def _number(seed: Column, attempt: Column, salt: Column | str, bits: int = 32) -> Column:
    """A number below 2^bits that the identity's seed, the attempt and the salt decide."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    secret = F.sha2(F.concat_ws("\x1f", seed, attempt.cast("string"), salt), 256)
    return F.conv(F.substring(secret, 1, bits // 4), 16, 10).cast("long")


def _alike(chars: Column, number) -> Column:
    """Letters for letters and digits for digits, of the same case and script; other characters stay."""

    def one(c: Column, at: Column) -> Column:
        of = F.lit(None).cast("string")
        for cls, letters in reversed(ALPHABETS):
            of = F.when(c.rlike(f"^{cls}$"), F.lit(letters)).otherwise(of)
        picked = F.substring(of, F.pmod(number(at), F.length(of).cast("long")).cast("int") + 1, F.lit(1))
        return F.when(of.isNull(), c).when(c.rlike(r"^\p{Lu}$"), F.upper(picked)).otherwise(picked)

    return F.array_join(F.transform(chars, one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, a multiple of 10 for valid card numbers."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + s["odd"])
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (1 - s["odd"]).alias("odd"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")), add, lambda s: s["sum"])


def surrogate(kind: Column, identity: Column, attempt: Column, seed: Column) -> Column:
    """A value of the identity's kind and form: same length, script, case and punctuation; cards keep whether they are valid,
    addresses their top-level domain, numbers of accounts their country, phone numbers their first digit; names are of the
    same gender and script, a further syllable or letter for each attempt. From attempt SAME_LENGTH on values are longer than
    the identity: by a digit at the end for each attempt, a letter at the start of addresses, a number more of ip."""

    def number(salt):
        return _number(seed, attempt, salt)

    extra = F.greatest(F.lit(0), attempt - (SAME_LENGTH - 1)).cast("int")
    chars = F.split(F.concat(identity, F.repeat(F.lit("0"), extra)), "")
    any_form = _alike(chars, number)
    domain = F.regexp_extract(identity, r"\.[^.@]*$", 0)
    before = F.concat(F.repeat(F.lit("a"), extra), F.substring(identity, F.lit(1), F.length(identity) - F.length(domain)))
    email = F.concat(_alike(F.split(before, ""), number), domain)
    octets = F.array_join(F.transform(F.split(F.concat(identity, F.repeat(F.lit(".0"), extra)), r"\."), lambda o, at: (F.pmod(number(at), F.lit(254)) + 1).cast("string")), ".")
    head = F.substring(any_form, F.lit(1), F.length(any_form) - 1)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(luhn_sum(identity), F.lit(10)) == 0, F.concat(head, check)).otherwise(any_form)
    phone = F.concat(F.substring(identity, 1, 1), F.substring(any_form, F.lit(2), F.length(any_form)))
    iban = F.concat(F.substring(identity, 1, 2), F.substring(any_form, F.lit(3), F.length(any_form)))
    cases = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban)
    for (gender, script), names in GIVEN.items():
        picked = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(number("given"), F.lit(len(names))) + 1).cast("int"))
        tail = _syllables(attempt, number, script)
        cases = cases.when(kind == f"given_{gender}_{script}", F.when(attempt == 0, picked).otherwise(F.concat(picked, tail)))
    for script in SYLLABLES:
        cases = cases.when(kind == f"surname_{script}", F.initcap(_syllables(attempt + 3, number, script)))
    return cases.otherwise(any_form)


def _syllables(n: Column, number, script: str) -> Column:
    of = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    one = lambda at: F.element_at(of, (F.pmod(number(at), F.lit(len(SYLLABLES[script]))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")


def assign_surrogates(identities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, id, surrogate) for distinct (kind, id): no two of a kind share a surrogate, and none is a real id of its kind.

    Of those that collide the smallest id keeps its surrogate; the others and those that hit a real id try again, checked
    against all kept so far; after SAME_LENGTH rounds with longer values, of which there are always enough. Each round writes its part to the shared folder; only whether any are left reaches the driver.
    """
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "id"), 256)  # once, so that a long id isn't hashed for each of its characters
    real = materialise(identities.select("kind", "id").withColumn("seed", seed), "identities")
    known = real.select(F.col("kind").alias("kind"), F.lower("id").alias("taken"))
    left, kept = real, None
    for attempt in itertools.count():
        tried = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("id"), F.lit(attempt), F.col("seed"))).withColumn("taken", F.lower("surrogate"))
        first = tried.withColumn("n", F.row_number().over(Window.partitionBy("kind", "taken").orderBy("id")))
        free = first.filter("n = 1").join(known, ["kind", "taken"], "left_anti")
        if kept is not None:
            free = free.join(kept.select("kind", F.lower("surrogate").alias("taken")), ["kind", "taken"], "left_anti")
        free = materialise(free.select("kind", "id", "surrogate"), "surrogates")
        kept = free if kept is None else kept.unionByName(free)
        left = materialise(left.join(free, ["kind", "id"], "left_anti"), "colliding")
        if left.isEmpty():
            return kept


def _render(match: Column, kind: Column, surrogates: Column) -> Column:
    """A surrogate in the form of its match: the title and every separator stay; what a longer surrogate has more follows."""
    title = F.regexp_extract(match, r"^[^ ]+ ", 0)
    one = F.get(surrogates, F.lit(0))

    def put(s: Column, c: Column) -> Column:
        letter = c.rlike(r"^[A-Za-z0-9]$")
        return F.struct((s["at"] + letter.cast("int")).alias("at"), F.concat(s["out"], F.when(letter, F.substring(one, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    spaced = F.aggregate(F.split(match, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), put, lambda s: F.concat(s["out"], F.substring(one, s["at"], F.length(one))))
    return F.when(kind.startswith("name"), F.concat(title, F.array_join(surrogates, " "))).when(kind.isin("email", "ip"), one).otherwise(spaced)


def cut(body: Column) -> Column:
    """A text cut at its entities, in one pass: text between entities at even places, entities at odd ones; null stays one piece."""
    hint = F.coalesce(body.rlike(HINT), F.lit(False))
    pieces, matches = F.split(body, PATTERN, -1), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    twice = F.array_compact(F.flatten(F.zip_with(pieces, matches, lambda p, m: F.array(p, m))))
    return F.when(~hint, F.array(body)).when(~body.contains(CUT), F.split(F.regexp_replace(body, PATTERN, f"{CUT}$0{CUT}"), CUT, -1)).otherwise(twice)


def replace_pii(docs: DataFrame, key_column: str = "doc_id", text: str = "text", key: str = KEY) -> DataFrame:
    """The rows of docs with their own columns, personal data in `text` replaced, and _pii_found, the number of entities.

    One keyed surrogate stands for an entity in all documents, however it is spaced, and for no other. Everything around an
    entity stays as it is, and texts without any are untouched, null ones included. Repeated rows are replaced alike; keys may
    be null; texts and entities may be of any length. The rows are written once, cut at their entities; only those that hold
    one are joined to their surrogates, by key and text hash. An entity in a third of all documents is one row where
    surrogates are made, and Spark splits its side of the join.
    """
    body = F.col(text).cast("string")
    marked = materialise(docs.withColumns({"_pii_parts": cut(body), "_pii_hash": F.xxhash64(body)}).drop(text), "marked")
    holding = marked.filter(F.size("_pii_parts") > 1)
    entities = F.filter("_pii_parts", lambda _, at: at % 2 == 1)
    matches = holding.select(F.col(key_column).alias("doc"), F.col("_pii_hash").alias("hash"), entities.alias("matches")).groupBy("doc", "hash").agg(F.first("matches").alias("matches"))
    matches = matches.select("doc", "hash", F.posexplode("matches").alias("at", "match")).withColumn("kind", _kind(F.col("match")))
    named = materialise(matches.withColumn("ids", _identities(F.col("match"), F.col("kind"))), "entities")
    tokens = named.select("doc", "hash", "at", "match", F.col("kind").alias("form"), F.posexplode("ids").alias("nth", "entity")).select("*", "entity.kind", "entity.id").drop("entity")
    surrogates = assign_surrogates(tokens.select("kind", "id").distinct(), key)
    told = tokens.join(surrogates, ["kind", "id"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["value"])
    whole = told.groupBy("doc", "hash", "at", "match", "form").agg(ordered(F.struct("nth", F.col("surrogate").alias("value"))).alias("parts"))
    rendered = whole.select("doc", "hash", F.struct("at", _render(F.col("match"), F.col("form"), F.col("parts")).alias("value")).alias("new"))
    by_text = rendered.groupBy("doc", "hash").agg(ordered(F.col("new")).alias("_pii_new"))
    by_text = materialise(by_text.withColumnsRenamed({"doc": "_pii_doc", "hash": "_pii_text"}), "replacements")

    def whole_rows(rows: DataFrame, put: Column) -> DataFrame:
        found = F.floor(F.size("_pii_parts") / 2).cast("int").alias("_pii_found")
        return rows.select(*[put.alias(c) if c == text else rows[c] for c in docs.columns], found)

    without = whole_rows(marked.filter(F.size("_pii_parts") == 1), F.get("_pii_parts", F.lit(0)))
    same = holding[key_column].eqNullSafe(by_text["_pii_doc"]) & (holding["_pii_hash"] == by_text["_pii_text"])
    put = F.transform("_pii_parts", lambda p, at: F.when(at % 2 == 1, F.get("_pii_new", F.shiftright(at, 1))).otherwise(p))
    return without.unionByName(whole_rows(holding.join(by_text, same), F.array_join(put, "")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("_pii_found").cast("long").alias("n_entities"))
