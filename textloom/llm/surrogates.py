"""Surrogates for personal data, in DataFrame operations only.

One pattern finds the entities. Each is cut into parts (a name's tokens, an e-mail's mailbox and domain, a number's
digits), and each distinct part gets one keyed replacement of its kind for the whole corpus: the same part is replaced
alike everywhere, and different parts differently. Replacements that collide with each other or with a part that
occurs are drawn again, from a space that grows with each draw, so that there is always a free one. Each occurrence
keeps its own format: separators, letter case, length.

A given name has one gender in the whole corpus: that of the titles it occurs with, else that of the lists, else none;
names that both genders bear, or of which nothing is known, get names that both bear. A document's names are also
replaced where they stand without a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, hot_join, scratch, unused

#: Forms of address by gender.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
#: Given names that surrogates start from, and syllables of names, by script.
GIVEN = {
    "m_latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    "f_latin": ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Ida", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"),
    "m_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Олег"),
    "f_cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга"),
    "m_greek": ("Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Σπύρος", "Φώτης"),
    "f_greek": ("Αγγελική", "Βασιλική", "Δάφνη", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"),
    "u_latin": ("Alex", "Charlie", "Dana", "Jamie", "Kim", "Noor", "Robin", "Sam", "Sascha", "Toni"),
    "u_cyrillic": ("Валя", "Женя", "Саша", "Слава", "Шура"),
    "u_greek": ("Άλεξ", "Κρις", "Μελ", "Τζο"),
}
SYLLABLES = {
    "latin": ("ba", "bel", "cor", "da", "den", "fa", "fer", "gal", "hol", "ka", "ken", "la", "lin", "ma", "mer", "na", "nor", "pa", "per", "ra", "ros", "sa", "sten", "ta", "tor", "va", "vel", "win"),
    "cyrillic": ("ба", "бел", "вар", "гор", "да", "ден", "зар", "ка", "кор", "ла", "лин", "ма", "мор", "на", "нов", "па", "пет", "ра", "ров", "са", "сол", "та", "тор"),
    "greek": ("βα", "γαλ", "δα", "δελ", "ζα", "θα", "κα", "κορ", "λα", "λεν", "μα", "μερ", "να", "νικ", "πα", "πετ", "ρα", "σα", "σταθ", "τα"),
}

NAME = r"\p{Lu}[\p{L}'’-]+"
TITLES = "|".join((*MALE, *FEMALE, *NEUTRAL))
EMAIL = r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
KEY = r"\bAKIA[A-Z0-9]{16}\b|\b[0-9a-f]{32,64}\b|(?<=\bpassword=)[A-Za-z0-9]{6,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9])\+[0-9](?:[ .-]?[0-9]){7,14}(?![0-9])"
)
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
PERSON = rf"(?<![\p{{L}}])(?:{TITLES})\.? {NAME}(?: {NAME})?"
#: In order of preference where several would match.
PATTERN = "|".join((EMAIL, KEY, IBAN, IP, SSN, CARD, PHONE, PERSON))
#: A cheap test that every match passes.
HINT = rf"[@0-9]|password=|[0-9a-f]{{32}}|(?:{TITLES})\.? "
#: Draws after which kinds of a fixed length get longer: until then nearly all of a large space must be in use.
FIXED_LENGTH_DRAWS = 16


def _kind(form: Column) -> Column:
    out = F.lit("secret")
    for name, pattern in reversed([("email", EMAIL), ("iban", IBAN), ("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("person", PERSON)]):
        out = F.when(form.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _part(kind: Column | str, canon: Column | None, shape: Column, scope: Column | None = None, sex: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), (F.lit("") if scope is None else scope).alias("scope"), (none if canon is None else canon).alias("canon"), shape.alias("shape"), (none if sex is None else sex).alias("sex"))


def _parts(form: Column, kind: Column) -> Column:
    """The parts of an entity in order; those without canon are kept as they are.

    Surrogates differ within a scope. A mailbox's is its domain: as domains' surrogates differ from each other and from
    all domains that occur, whole addresses do so too.
    """
    box, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    title = F.substring_index(form, " ", 1)
    bare = F.rtrim(F.regexp_replace(title, r"\.$", ""))
    sex = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f")
    as_is = lambda text: _part("as_is", None, text)

    def name_parts(names: Column, sex: Column | None) -> tuple[Column, Column]:
        last, first = F.element_at(names, -1), F.element_at(names, 1)
        feminine = (_script(last) == "cyrillic") & F.lower(last).rlike("(?:ов|ев|ёв|ин|ын)а$|ая$")
        surname = _part(F.concat(F.when(feminine, "surname_f_").otherwise("surname_"), _script(last)), F.lower(last), last)
        return _part(F.concat(F.lit("given_"), _script(first)), F.lower(first), first, sex=sex), surname

    titled, plain = F.slice(F.split(form, " "), 2, 2), F.split(form, " ")
    given, surname = name_parts(titled, sex)
    bare_given, bare_surname = name_parts(plain, None)
    space = as_is(F.lit(" "))
    return (
        F.when(kind == "email", F.array(_part("mailbox", F.lower(box), box, F.lower(domain)), as_is(F.lit("@")), _part("domain", F.lower(domain), domain)))
        .when(kind == "person", F.when(F.size(titled) == 2, F.array(as_is(title), space, given, space, surname)).otherwise(F.array(as_is(title), space, surname)))
        .when(kind == "name", F.when(F.size(plain) == 2, F.array(bare_given, space, bare_surname)).otherwise(F.array(bare_surname)))
        .when(kind.isin("phone", "card", "ssn"), F.array(_part(kind, _digits(form), form)))
        .otherwise(F.array(_part(kind, F.when(kind == "iban", F.regexp_replace(form, " ", "")).otherwise(form), form)))
    )


def _stream(key: str) -> Column:
    """Keyed bytes in hex for kind, scope, canon and attempt: 128 bytes, and two more a character of canon and an attempt."""
    blocks = F.sequence(F.lit(0), F.floor((F.length("canon") + F.col("attempt")) / 30).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\0", F.lit(key), F.col("kind"), F.col("scope"), F.col("canon"), F.col("attempt").cast("string"), b.cast("string")), 512)), "")


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _mod97(iban: Column) -> Column:
    """An account number's remainder by 97, with its first four characters moved to the end and letters as 10 to 35; 1 if it is valid."""
    moved = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _candidate() -> Column:
    """A replacement of the same kind and form for kind, canon, sex, attempt and stream."""
    h, canon, kind, attempt = F.col("stream"), F.col("canon"), F.col("kind"), F.col("attempt")
    chars = F.split(canon, "")
    letters, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    size = F.length(canon)
    last = F.floor(F.length(h) / 2).cast("int")

    def letter(b: Column, of: str) -> Column:
        return F.substr(F.lit(of), b % len(of) + 1, F.lit(1))

    def redrawn(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[A-Z]"), letter(b, capitals)).when(c.rlike(r"\p{L}"), letter(b, letters)).otherwise(c)

    def drawn(n: Column, of: str) -> Column:
        """``n`` characters from the stream's last bytes, which ``redrawn`` doesn't use."""
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: letter(_byte(h, last - i), of)), "")).otherwise("")

    same = F.array_join(F.transform(chars, redrawn), "")
    hexed = F.array_join(F.transform(chars, lambda c, i: letter(_byte(h, i), "0123456789abcdef")), "")
    # After two draws a mailbox or a domain gets letters in front, two more each time.
    front = drawn(2 * (attempt - 1), letters)
    label = F.substring_index(canon, ".", -1)  # a domain keeps its last label
    ip = F.concat_ws(".", *((_byte(h, F.lit(i)) % 223 + 1).cast("string") for i in range(4)))
    kept = F.greatest(size - 9, F.lit(0))  # a phone number's country code and what follows it
    card = F.concat(F.substr(same, F.lit(1), size - 1), F.lit("0"))
    checked = F.when(_luhn(canon) == 0, F.concat(F.substr(same, F.lit(1), size - 1), ((10 - _luhn(card)) % 10).cast("string"))).otherwise(same)
    fixed = F.when(kind == "ip", ip).when(kind == "card", checked).when(kind == "phone", F.concat(F.substr(canon, F.lit(1), kept), F.substr(same, kept + 1, size)))
    fixed = fixed.when((kind == "secret") & canon.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substr(same, F.lit(5), size))).when((kind == "secret") & canon.rlike("^[0-9a-f]{32,}$"), hexed)
    country, account = F.substr(canon, F.lit(1), F.lit(2)), F.substr(same, F.lit(5), size)
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_mod97(canon) == 1, check).otherwise(F.substr(same, F.lit(3), F.lit(2))), account)
    fixed = fixed.when(kind == "iban", iban).otherwise(same)
    out = F.when(kind == "domain", F.concat(front, F.substr(same, F.lit(1), size - F.length(label)), label)).when(kind == "mailbox", F.concat(front, same))

    def syllables(script: str, n: Column) -> Column:
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick(SYLLABLES[script], _byte(h, i + 8))), "")).otherwise("")

    for script in SYLLABLES:
        # The first draw of a given name is from the list; later ones have syllables in front, one more each time.
        listed = [_pick(GIVEN[f"{sex}_{script}"], _byte(h, F.lit(0))) for sex in "mfu"]
        listed = F.when(F.col("sex") == "m", listed[0]).when(F.col("sex") == "f", listed[1]).otherwise(listed[2])
        out = out.when(kind == f"given_{script}", F.concat(syllables(script, attempt), F.lower(listed)))
        out = out.when(kind == f"surname_{script}", syllables(script, attempt + 2))
    out = out.when(kind == "surname_f_cyrillic", F.concat(syllables("cyrillic", attempt + 2), F.lit("ова")))
    return out.otherwise(F.concat(fixed, drawn(attempt - FIXED_LENGTH_DRAWS, "0123456789")))


def _sex(canon: Column, male: Column, female: Column) -> Column:
    """A given name's gender by its titles, else by the lists, else 'u'."""
    listed = lambda sex: canon.isin(*(n.lower() for k, v in GIVEN.items() if k.startswith(sex) for n in v))
    return F.when(male & female, "u").when(male, "m").when(female, "f").when(listed("m"), "m").when(listed("f"), "f").otherwise("u")


def assign(parts: DataFrame, key: str) -> DataFrame:
    """kind, scope, canon, surrogate for the distinct kind, scope and canon of ``parts`` (also sex: of the title, or null).

    Surrogates are distinct within a kind and scope and are no canon of these, but that a mailbox only differs from its
    own canon. Of parts that draw the same surrogate the first by canon keeps it; the others draw again, as do those
    that drew a canon or an assigned surrogate. Each draw's space is larger than the one before it, so draws end.
    """
    seen = lambda sex: F.coalesce(F.bool_or(F.col("sex") == sex), F.lit(False))
    real = parts.groupBy("kind", "scope", "canon").agg(seen("m").alias("m"), seen("f").alias("f"))
    real = cut(real.select("kind", "scope", "canon", _sex(F.col("canon"), F.col("m"), F.col("f")).alias("sex")))
    taken = real.where("kind <> 'mailbox'").select("kind", "scope", F.col("canon").alias("surrogate"))
    pending, settled, attempt = real, None, 0
    while True:
        drawn = pending.withColumn("attempt", F.lit(attempt)).withColumn("stream", _stream(key)).withColumn("surrogate", _candidate())
        # One row a drawn surrogate, whoever drew it: partial minima come before the shuffle.
        first = drawn.where("surrogate <> canon").groupBy("kind", "scope", "surrogate").agg(F.min("canon").alias("canon"))
        good = cut(first.join(taken, ["kind", "scope", "surrogate"], "left_anti").select("kind", "scope", "canon", "surrogate"))
        settled = good if settled is None else settled.unionByName(good)
        pending = cut(pending.join(good, ["kind", "scope", "canon"], "left_anti"))
        if pending.isEmpty():
            return settled
        taken = taken.unionByName(good.select("kind", "scope", "surrogate"))
        attempt += 1


def _shaped(surrogate: Column, shape: Column, kind: Column) -> Column:
    """A surrogate in the format of an occurrence; what a longer one has over its length follows as it is."""
    chars = F.split(shape, "")
    seen = lambda pattern, i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), pattern, ""))
    beyond = lambda n: F.substr(surrogate, n + 1, F.length(surrogate))
    digits = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(surrogate, seen("[^0-9]", i), F.lit(1))).otherwise(c)), ""), beyond(F.length(_digits(shape))))
    spaced = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, seen(" ", i), F.lit(1)))), ""), beyond(F.length(F.regexp_replace(shape, " ", ""))))
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substr(surrogate, i + 1, F.lit(1)))).otherwise(F.substr(surrogate, i + 1, F.lit(1)))), "")
    name = F.when((F.upper(shape) == shape) & (F.length(shape) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", spaced).when(kind.isin("mailbox", "domain"), F.concat(cased, beyond(F.length(shape)))).when(kind.startswith("given") | kind.startswith("surname"), name).otherwise(surrogate)


def replacements(forms: DataFrame, key: str) -> DataFrame:
    """id, n, type, replacement for the distinct entities of ``forms`` (id, form, bare: a name without title, n)."""
    typed = forms.withColumn("type", F.when(F.col("bare"), "name").otherwise(_kind(F.col("form"))))
    parts = typed.select("id", F.posexplode(_parts(F.col("form"), F.col("type"))).alias("i", "part")).select("id", "i", "part.*")
    known = parts.where("canon is not null")
    drawn = assign(known, key)
    # Many entities share a domain or a surname: those parts' own rows are spread.
    uses = known.groupBy("kind", "scope", "canon").agg(F.count("*").alias("uses"))
    drawn = drawn.join(uses, ["kind", "scope", "canon"]).withColumn("what", F.concat_ws("\0", "kind", "scope", "canon")).select("what", "uses", "surrogate")
    total = uses.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    put = hot_join(parts.withColumn("what", F.when(F.col("canon").isNotNull(), F.concat_ws("\0", "kind", "scope", "canon"))), drawn, "what", "uses", total, F.xxhash64("id", "i"))
    made = put.select("id", "i", F.when(F.col("canon").isNull(), F.col("shape")).otherwise(_shaped(F.col("surrogate"), F.col("shape"), F.col("kind"))).alias("text"))
    whole = made.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("replacement"))
    return typed.join(whole, "id")


def _named(found: Column) -> Column:
    """The names of a document's persons, longer ones first, as they stand without a title: whole names and surnames."""
    persons = F.filter(found, lambda f: f.rlike(f"^(?:{PERSON})$"))
    names = F.flatten(F.transform(persons, lambda f: F.array(F.array_join(F.slice(F.split(f, " "), 2, 2), " "), F.substring_index(f, " ", -1))))
    return F.reverse(F.array_sort(F.array_distinct(names)))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text replaced by the text with surrogates, and a column n_entities (it replaces one of that name).

    ``key`` decides all draws. Who knows it can find a number again by trying all, so it must be secret and has no default.

    Null texts stay null and texts without entities as they are, with n_entities 0. An entity that occurs in many
    documents, or often in one, has one replacement. Titles without a known gender (Dr, Prof) leave it to the given name.
    Repeated rows get equal texts; doc_id isn't used and may be null; an empty table gives an empty result; other
    columns pass whatever their names. A copy of ``docs`` goes to the shared folder.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    names = [c for c in docs.columns if c.lower() != "n_entities"]
    uid, seen, hit = (unused(docs, x) for x in ("uid", "found", "hit"))
    numbered = docs.select(*(F.col(f"`{c}`") for c in names)).withColumn(uid, F.monotonically_increasing_id())
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    numbered = numbered.withColumn(seen, F.coalesce(found, F.array().cast("array<string>"))).withColumn(hit, (F.size(seen) > 0).cast("int"))
    # The patterns are the dear part: texts are searched once, and rows with and without entities lie apart from then on.
    path = scratch(docs.sparkSession, "surrogates")
    numbered.write.partitionBy(hit).parquet(path)
    numbered = docs.sparkSession.read.schema(numbered.schema).parquet(path)
    hits = numbered.where(F.col(hit) == 1).select(F.col(uid).alias("uid"), "text", F.col(seen).alias("found"))
    hits = hits.withColumn("names", _named(F.col("found")))
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}])(?:"), F.array_join("names", "|"), F.lit(r")(?![\p{L}'’-])"))).otherwise(F.lit(PATTERN))
    hits = hits.withColumn("pattern", pattern)
    hits = cut(hits.withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found"))))
    uses = hits.select("uid", "names", F.posexplode("found").alias("at", "form")).withColumn("bare", F.array_contains("names", F.col("form")))
    uses = uses.select("uid", "at", "form", "bare", F.concat(F.when(F.col("bare"), "n:").otherwise("e:"), "form").alias("id"))
    forms = cut(uses.groupBy("id", "form", "bare").agg(F.count("*").alias("n")))
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = cut(replacements(forms, key).select("id", "n", "replacement"))
    put = hot_join(uses.select("uid", "at", "id"), table, "id", "n", total, F.xxhash64("uid", "at"))
    put = put.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "replacement"))).alias("put"))
    between = F.split(F.col("text"), F.col("pattern"), -1)
    filled = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(F.col("put"), i)["replacement"], F.lit("")))), "")
    made, n, changed = (unused(docs, x) for x in ("made", "n", "changed"))
    changes = hits.join(put, "uid").select(F.col("uid").alias(changed), filled.alias(made), F.size("put").alias(n))
    rest = numbered.where(F.col(hit) == 0).select(*(F.col(f"`{c}`") for c in names), F.lit(0).alias("n_entities"))
    back = numbered.where(F.col(hit) == 1).drop("text", seen).join(changes, F.col(uid) == F.col(changed))
    back = back.select(*((F.col(made).alias(c) if c.lower() == "text" else F.col(f"`{c}`")) for c in names), F.col(n).alias("n_entities"))
    return rest.unionByName(back)
