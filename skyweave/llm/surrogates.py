"""Surrogates for personal data, with SQL functions alone (operator 7).

Entities are found by one regular expression; card numbers must have a right check digit and
an issuer's first digit, account numbers (IBAN) a right remainder. They are reduced to a
canonical value (an address in lower case, the digits of a number, one word of a name). Each
distinct value gets a surrogate from a keyed SHA-512 stream: digits for digits and letters
for letters where they stood, a valid address, right check digits, the same country code,
and for each word of a name syllables of the same script, given names with an ending of the
same gender; initials and particles (F., von) stay.

Names begin with a title, a known given name or words such as "Name:". A word of a name found
once in a document is replaced wherever it stands in that document with a capital: such
documents' capitalised words are looked up, by a join, among the document's names. Names
in scripts without capitals are not found.

Collision checks keep distinct values distinct: a value whose surrogate another value has,
or which is a value of the corpus itself, takes the next stream until none collides; streams
get longer, so this ends. The surrogates are a table keyed by value, so all mentions of a
value in all documents, however they are formatted, get the same one. Documents with entities
are joined to it by their content's digest; all others pass through and are not moved.

The key is the caller's. The query and the pipeline take it from the setting
``spark.skyweave.surrogates.key``; without one, a session gets a random key, and surrogates
of different sessions differ.

Groups in patterns are repeated a bounded number of times, so texts of any length and make-up
can be matched. Defined results: a null text stays null and has no entities; ids are not
used, so null and repeated ids do not matter; rows of equal text get equal results.
"""

from __future__ import annotations

import secrets as random_bytes
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written
from .spans import matches

#: The session's setting with the key.
KEY = "spark.skyweave.surrogates.key"
#: Attempts after which streams get longer.
ROOMY = 8

_EDGE, _AFTER = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
#: By kind, in the order in which they are tried at one place.
PATTERNS = {
    "login": r"(?<=://)[^\s/@:?#]{1,256}:[^\s/@?#]{1,256}(?=@)",
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@{_LABEL}(?:\.{_LABEL}){{0,126}}\.[A-Za-z]{{2,}}",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_AFTER}",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{{3}}\)?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}){_AFTER}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])",
    "card": rf"{_EDGE}[0-9](?:[ -]?[0-9]){{12,18}}{_AFTER}",
    "name": "",
}
#: Titles by the gender they say.
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Srta Doña Signora Senhora Mevrouw Госпожа Κυρία".split(),
    "m": "Mr Sir Lord Herrn Herr Monsieur Señor Sr Don Signor Senhor Meneer Господин Κύριος".split(),
    "u": "Dr Prof Professor Доктор Профессор".split(),
}
#: Given names that say a gender and begin a name without a title.
GIVEN = {
    "f": "Maria Anna Emma Sophie Laura Julia Elena Carmen Lucia Isabel Alice Charlotte Camille Claire Helen Susan Linda Mary Patricia Jennifer Elizabeth Sarah Katharina Monika Ursula Margaret Barbara Karen Nancy Amanda Chloé Amélie Giulia Francesca Aisha Fatima Layla Zeynep Priya Ananya Mei Yuki Ingrid Astrid Katarzyna Agnieszka Анна Мария Елена Ольга Ελένη".split(),
    "m": "John James Robert Michael William David Richard Thomas Peter Paul Hans Jürgen Klaus Wolfgang Pierre Jean Michel François Juan Carlos José Antonio Miguel Andrew George Charles Daniel Matthew Christopher Steven Kevin Stefan Jürg Marco Luca Giovanni Pedro João Ali Ahmed Mohammed Muhammad Hassan Omar Ibrahim Mehmet Mustafa Raj Arjun Sanjay Wei Hiroshi Kenji Lars Erik Piotr Иван Пётр Сергей Алексей Γιώργος".split(),
}
_CORE = r"(?:(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?|\p{Lu}{2,})"
_CAPITAL = rf"{_CORE}(?:[-'’]{_CORE})?"
#: Words of a name that stay as they are.
_KEPT = r"(?:\p{Lu}\.|von|van|de|der|den|del|della|di|da|dos|du|la|le|zu|ten|ter|bin|al)"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
#: A word with the initials and particles before it, and one that begins no other name and is no suffix; a name has up to 20 of these after its second.
_WORD = rf"(?:(?: {_KEPT}){{0,4}} {_CAPITAL}(?![\p{{L}}]))"
_MORE = rf"(?:(?: {_KEPT}){{0,4}} (?!(?:{_TITLE})\.? \p{{Lu}}|(?:Jr|II|III)(?![\p{{L}}])){_CAPITAL}(?![\p{{L}}]))"
_TITLED = rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:{'|'.join(t for g in TITLES.values() for t in g)})\.?{_WORD}(?:{_WORD}{_MORE}{{0,20}})?"
_GIVEN = rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:{'|'.join(n for g in GIVEN.values() for n in g)}){_WORD}{_MORE}{{0,20}}"
#: What says that a name follows; fixed values.
CUES = "Name|name|NAME|Surname|Vorname|Nachname|Nom|Nombre|Apellido|Nome|Naam|Имя|Όνομα|Patient|Customer|Client|Kunde|Contact|Author"
SAID = "[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Mm]i chiamo"
_PREFIX = rf"(?:(?:{_TITLE})\.? |(?:{CUES}) ?: |(?:{SAID}) )"
_CUED = rf"(?<![\p{{L}}])(?:(?:{CUES}) ?: |(?:{SAID}) )(?!(?:{_TITLE})\.? ){_CAPITAL}(?![\p{{L}}]){_MORE}{{0,20}}"
PATTERNS["name"] = rf"{_TITLED}|{_GIVEN}|{_CUED}"
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A capitalised word that an address does not go on from.
WORD = rf"(?<![\p{{L}}]){_CAPITAL}(?![\p{{L}}])(?![A-Za-z0-9._%+-]{{0,64}}@)"
#: Consonants and vowels of each script, and endings by gender; fixed, 16 consonants each.
SCRIPTS = {
    "latin": ("bdfghjklmnprstvz", "aeio", {"f": "a", "m": "n", "u": "er"}),
    "cyrillic": ("бвгджзклмнпрстфх", "аеио", {"f": "а", "m": "н", "u": "ер"}),
    "greek": ("βγδζθκλμνξπρστφχ", "αειο", {"f": "α", "m": "ν", "u": "ερ"}),
}


def has_entities(text: Column) -> Column:
    """Whether ANY matches; what is looked for first is in every match, so it only saves time."""
    hint = text.contains("@") | text.rlike("[0-9][ .-]?[0-9]") | text.rlike(PATTERNS["name"])
    return F.coalesce(hint & text.rlike(ANY), F.lit(False))


def found(text: Column, named: Column) -> Column:
    """Array of (start, end, value, kind): what may be an entity; of texts with names, also all capitalised words (kind "word").

    Numbers whose check digits are wrong have the kind "none".
    """
    both = F.when(named, matches(text, f"{ANY}|(?:{WORD})")).otherwise(matches(text, ANY))
    return F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _kind(x["value"]).alias("kind")))


def _kind(value: Column) -> Column:
    """A match's kind, by its value: of names all but single words have a space."""
    out = F.when(value.contains(" "), "name").otherwise("word")
    checked = {"card": _is_card(F.regexp_replace(value, "[^0-9]", "")), "iban": _remainder(F.regexp_replace(value, " ", "")) == 1}
    for kind in reversed(KINDS[:-1]):
        bare = PATTERNS[kind].replace("(?<=://)", "").replace("(?=@)", "")  # what stands around a match is not in its value
        out = F.when(value.rlike(f"^(?:{bare})$"), F.when(checked[kind], kind).otherwise("none") if kind in checked else F.lit(kind)).otherwise(out)
    return out


def _is_card(digits: Column) -> Column:
    return digits.rlike("^[2-6]") & (_luhn(digits) % 10 == 0)


def _remainder(account: Column) -> Column:
    """Of an account number by 97, its first four characters last; 1 in a right one."""
    turned = F.concat(account.substr(F.lit(5), F.char_length(account)), account.substr(1, 4))
    add = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _stays(word: Column) -> Column:
    return word.rlike(f"^{_KEPT}$")


def parts(kind: Column, value: Column) -> Column:
    """Array of (kind, value): what of an entity has surrogates of its own, in canonical form.

    A name's words are apart, so that a family name after a title and the same in a full
    name agree; kinds of words tell family from given names, with gender, and the script.
    """
    words = F.filter(F.split(F.regexp_replace(value, f"^{_PREFIX}", ""), " "), lambda w: ~_stays(w))
    title = F.regexp_extract(value, rf"^({_TITLE})\.? ", 1)
    gender = lambda first: F.when(title.isin(TITLES["f"]) | first.isin(GIVEN["f"]), "f").when(title.isin(TITLES["m"]) | first.isin(GIVEN["m"]), "m").otherwise("u")
    name = lambda w, what: F.struct(F.concat_ws(":", what, _script(w)).alias("kind"), F.lower(w).alias("value"))
    own = lambda w: F.when(w.isin(GIVEN["f"]), "given-f").when(w.isin(GIVEN["m"]), "given-m").otherwise("given-u")
    one = lambda v: F.array(F.struct(kind.alias("kind"), v.alias("value")))

    def of_name(w: Column) -> Column:
        given, family = name(w[0], F.concat(F.lit("given-"), gender(w[0]))), name(F.element_at(w, -1), F.lit("family"))
        middle = F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))), lambda x: name(x, own(x)))
        return F.when(F.size(w) > 1, F.concat(F.array(given), middle, F.array(family))).otherwise(F.array(family))

    return (
        F.when(kind == "name", let(words, of_name))
        .when(kind.isin("phone", "ssn", "card"), one(F.regexp_replace(value, "[^0-9]", "")))
        .when(kind == "iban", one(F.regexp_replace(value, " ", "")))
        .when(kind == "login", one(value))
        .otherwise(one(F.lower(value)))
    )


def _luhn(digits: Column) -> Column:
    """The sum that a card number's digits give; a multiple of ten where the check digit is right."""
    n = F.char_length(digits)
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The stand-in of a canonical value; later attempts read other streams."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)
    return let(stream, lambda s: _surrogate(kind, value, attempt, s))


def _surrogate(kind: Column, value: Column, attempt: Column, stream: Column) -> Column:
    at = lambda i: F.conv(stream.substr((i * 2 % 126 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    room = F.greatest(attempt - ROOMY, F.lit(0))  # so many more letters or digits, when others were taken
    digits = F.substring(F.regexp_replace(stream, "[a-f]", ""), 1, 40).substr(F.lit(1), room)
    pick = lambda letters, i: F.substring(F.lit(letters), 1, 1) if len(letters) == 1 else F.lit(letters).substr((at(i) % len(letters) + 1).cast("int"), F.lit(1))

    def alike(text: Column, keep: Column | int = 0) -> Column:
        """Letters for letters and digits for digits from place ``keep`` on."""
        change = lambda c, i: F.when(c.rlike("[0-9]"), (at(i) % 10).cast("string")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i)).when(c.rlike("[A-Z]"), F.upper(pick("abcdefghijklmnopqrstuvwxyz", i))).otherwise(c)
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i < keep, c).otherwise(change(c, i))), "")

    more = F.when(attempt > 0, F.concat(attempt.cast("string"))).otherwise(F.lit(""))
    local = F.concat(alike(F.substring_index(value, "@", 1)), more)
    email = F.concat(local, F.lit("@"), F.concat(F.lit("mail"), (at(F.lit(60)) % 97).cast("string"), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (at(F.lit(61)) % 3 + 1).cast("int"))))
    ip = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (at(i) % 254 + 1).cast("string")), "."), F.when(room > 0, F.concat(F.lit(":"), digits)).otherwise(F.lit("")))
    n = F.char_length(value)
    phone = F.concat(alike(value, F.greatest(n - 10, F.when(n > 8, F.lit(1)).otherwise(F.lit(0)))), digits)
    body = F.concat(value.substr(F.lit(1), F.lit(1)), alike(value.substr(F.lit(2), n - 2)), digits)
    off = (_luhn(F.concat(body, F.lit("0"))) + F.lit(1000) - _luhn(value)) % 10
    card = F.concat(body, ((10 - off) % 10).cast("string"))
    account = F.concat(alike(value.substr(F.lit(5), n)), digits)
    iban = F.concat(value.substr(1, 2), F.lpad((98 - _remainder(F.concat(value.substr(1, 2), F.lit("00"), account))).cast("string"), 2, "0"), account)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", F.concat(alike(value), digits)).when(kind == "login", F.concat(alike(value), digits))
    for script, (consonants, vowels, endings) in SCRIPTS.items():
        syllable = lambda i, c=consonants, v=vowels: F.concat(pick(c, F.lit(2 * i)), pick(v, F.lit(2 * i + 1)))
        more = F.array_join(F.transform(F.sequence(F.lit(10), 9 + room), lambda i: F.concat(pick(consonants, 2 * i), pick(vowels, 2 * i + 1))), "")  # noqa: B023  used in this turn
        stem = F.concat(*(syllable(i) for i in range(4)), F.when(room > 0, more).otherwise(F.lit("")))
        for gender, ending in endings.items():
            out = out.when(kind == f"given-{gender}:{script}", F.concat(stem, F.lit(ending)))
        out = out.when(kind == f"family:{script}", F.concat(stem, pick(consonants, F.lit(9))))
    return out


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two values of a kind share one, and none is a value itself."""
    todo = values.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    while True:
        made = written(todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)), "surrogates")
        first = made.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        taken = values.select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        good = made.join(first.join(taken, ["kind", "surrogate"], "left_anti"), ["kind", "surrogate", "value"], "left_semi").select("kind", "value", "surrogate")
        good = written(good, "surrogates")
        done = good if done is None else done.unionByName(good)
        todo = written(made.join(good, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "surrogates")
        if todo.isEmpty():
            return done


def filled(value: Column, letters: Column, pattern: str = "[0-9]") -> Column:
    """``value`` with what matches ``pattern`` replaced by ``letters``, in order; more letters follow."""
    begin = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike(pattern), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], letters.substr(s["at"], F.lit(1))).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out")))

    return F.aggregate(F.split(value, ""), begin, step, lambda s: F.concat(s["out"], letters.substr(s["at"], F.char_length(letters))))


def _cased(word: Column, stand_in: Column) -> Column:
    return F.when((word == F.upper(word)) & (F.char_length(word) > 1), F.upper(stand_in)).otherwise(F.initcap(stand_in))


def replacement(kind: Column, value: Column, got: Column) -> Column:
    """An entity's text with the surrogates of its parts, in its own format."""
    prefix = F.regexp_extract(value, f"^({_PREFIX})", 1)
    words = F.split(value.substr(F.char_length(prefix) + 1, F.char_length(value)), " ")

    def of_name(w: Column) -> Column:
        at = lambda i: F.size(F.filter(F.slice(w, F.lit(1), i + 1), lambda x: ~_stays(x))) - 1
        return F.concat(prefix, F.array_join(F.transform(w, lambda x, i: F.when(_stays(x), x).otherwise(_cased(F.element_at(w, -1), F.get(got, at(i))))), " "))

    return (
        F.when(kind == "name", let(words, of_name))
        .when(kind == "word", _cased(value, got[0]))
        .when(kind.isin("phone", "ssn", "card"), filled(value, got[0]))
        .when(kind == "iban", filled(value, got[0], "[0-9A-Z]"))
        .otherwise(got[0])
    )


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with ``__text`` (entities replaced) and ``__entities``."""
    text = F.col(text_col).cast("string")
    empty = F.array().cast(_ENTITIES)
    clean = docs.where(~has_entities(text)).withColumns({"__entities": empty, "__text": text})
    named = text.rlike(PATTERNS["name"])
    marked = docs.where(has_entities(text)).withColumns({"__named": named, "__key": F.sha2(text.cast("binary"), 256)})
    marked = written(marked.withColumn("__found", found(text, F.col("__named"))), "marked")
    some = marked.groupBy(F.col("__key").alias("k")).agg(F.first("__found").alias("f"))  # once for each text, however often it is copied
    each = some.select("k", F.posexplode("f").alias("i", "m")).where("m.kind <> 'none'").select("k", "i", F.posexplode(parts(F.col("m.kind"), F.col("m.value"))).alias("j", "p"))
    each = written(each.select("k", "i", "j", F.col("p.kind").alias("kind"), F.col("p.value").alias("value")), "mentions")
    sure, words = each.where("kind <> 'word'"), each.where("kind = 'word'").drop("kind")
    names = sure.where("kind like 'family:%' or kind like 'given-%'").groupBy("k", "value").agg(F.min("kind").alias("kind"))
    each = written(sure.unionByName(words.join(names, ["k", "value"])), "mentions")
    stand_ins = written(surrogate_table(written(each.select("kind", "value").distinct(), "values"), key), "stand-ins")
    got = each.join(stand_ins, ["kind", "value"]).groupBy("k", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    got = got.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("got"))  # a text's own
    joined = marked.join(written(got, "got").toDF("__k", "__got"), F.col("__key") == F.col("__k"), "left")
    pattern = lambda p: F.split(text, p, -1)
    gaps = F.when(F.col("__named"), pattern(f"{ANY}|(?:{WORD})")).otherwise(pattern(ANY))
    segments = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), F.col("__found.value").alias("value")), lambda z: F.array(z["gap"], F.coalesce(z["value"], F.lit("")))))

    def rebuilt(seg: Column) -> Column:
        before = lambda t: F.when(t == 0, F.lit(-1)).otherwise(F.get(F.col("__got"), t - 1)["i"])
        piece = lambda g, t: F.concat(F.array_join(F.slice(seg, 2 * before(t) + 3, 2 * (g["i"] - before(t)) - 1), ""), _new(g))
        last = F.element_at(F.col("__got"), -1)["i"]
        return F.concat(F.array_join(F.transform("__got", piece), ""), F.array_join(F.slice(seg, 2 * last + 3, F.size(seg)), ""))

    def _new(g: Column) -> Column:
        m = F.get(F.col("__found"), g["i"])
        return replacement(m["kind"], m["value"], g["s"])

    tagged = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.when(m["kind"] == "word", "name").otherwise(m["kind"]).alias("kind"))
    changed = joined.withColumn("__entities", F.when(F.col("__got").isNull(), empty).otherwise(F.transform("__got", lambda g: tagged(F.get(F.col("__found"), g["i"])))))
    changed = changed.withColumn("__text", F.when(F.col("__got").isNull(), text).otherwise(let(segments, rebuilt)))
    return clean.unionByName(changed.drop("__k", "__got", "__found", "__named", "__key"))


_ENTITIES = "array<struct<start:bigint,end:bigint,value:string,kind:string>>"


def replaced(docs: DataFrame, key: str, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with surrogates in the text; where it changed, its number of code points too."""
    out = with_surrogates(docs, key, text_col)
    changes = {text_col: F.col("__text")}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        changes[chars_col] = F.when(F.size("__entities") > 0, F.char_length("__text").cast(kind)).otherwise(F.col(chars_col))
    return out.withColumns(changes).select(*docs.columns)


def session_key(spark: SparkSession) -> str:
    """The key in the session's settings; a random one is put there, if there is none."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = random_bytes.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many entities of each kind, and the text with surrogates."""
    out = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    count = lambda k: F.size(F.filter("__entities", lambda m: m["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in KINDS), F.col("__text").alias("text"))
