"""PII surrogates: detected entities get keyed replacements of the same type.

Detected are e-mail addresses, IPv4 addresses, payment card numbers (with a
valid check digit), telephone numbers of seven digits or more and names after a form of address.
An entity's canonical form (lower-case address, digits of a number, name
without its title) seeds a keyed digest from which the replacement is
written: digits by digits, letters by letters of the same script, case and
kind (vowel or consonant), all else as it is.  Cards keep their issuer digit
and get a valid check digit, addresses of one mail domain keep a common domain
with its last label.  Telephone numbers keep their country code; their national
digits seed the rest, so that both forms of a number agree.  Names keep the
titles.  Of several words the first is the given name: it is drawn by its
word from names of the title's gender (either one's behind a title without
gender) in the same script.  All other words are surnames, each with one
replacement in the whole corpus.  Capitalised words of a titled name are
replaced in the rest of its document as well.  Every way of writing an entity
gets the same replacement in its own format, so mentions still refer to one
another.

Collision checks: no two entities share a replacement and no replacement is
an entity of the corpus (of a name: its surnames are none); of a clash the later one (by attempt, then
canonical form) draws again until none is left.  After eight draws local
parts, domains, names and telephone numbers grow by a letter or digit a draw, so a
shape may be full of entities.  Cards (10**11 numbers or more) and IPv4
addresses do not grow; more than half of all addresses as entities leave no
replacement and raise an error.

The result depends on the key and the set of entities only.  Null and empty
texts have no entities.  Rows with one id and text are treated alike, a null
id is an id of its own, an empty table gives an empty table, extra columns
are carried through ``pseudonymize``.  Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

MAX_ATTEMPTS = 64
PHONE_DIGITS = 7  # a shorter number behind a plus sign is no telephone number
_STREAM = 128  # bytes of a digest stream; longer entities use them again

# Forms of address by gender, letters by script, first names by gender and script.
TITLES = {"f": ["Mrs.", "Ms.", "Miss", "Mme", "Mlle", "Frau", "Sra.", "Srta.", "г-жа"],
          "m": ["Mr.", "Mister", "Herr", "Sr.", "Don", "г-н"],
          "n": ["Dr.", "Prof.", "Mx."]}
LETTERS = {"latin": ("aeiou", "bcdfghklmnprstvz"), "cyrillic": ("аеиоу", "бвгдзклмнпрст"), "greek": ("αεηιο", "βγδκλμνπρστ")}
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœаеёиоуыэюяαάεέηήιίοόυύωώ"
FIRST_NAMES = {
    ("f", "latin"): ["Alba", "Clara", "Dora", "Elena", "Greta", "Ida", "Lena", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sara", "Vera"],
    ("m", "latin"): ["Adam", "Boris", "David", "Emil", "Georg", "Hugo", "Ivan", "Leon", "Marco", "Oscar", "Pablo", "Robert", "Simon", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Лев", "Олег", "Роман"],
    ("f", "greek"): ["Αλίκη", "Ελένη", "Ειρήνη", "Μαρία"],
    ("m", "greek"): ["Γιώργος", "Νίκος", "Πέτρος", "Σταύρος"],
}

_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?<![\w.+-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)"
_PHONE = r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"
_CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
_TITLE = "|".join(t.replace(".", r"\.") for g in TITLES.values() for t in g)
_LETTER = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE}) )+(?=\p{{Lu}}){_LETTER}{{2,}}+(?:[ -](?=\p{{Lu}}){_LETTER}{{2,}}+){{0,2}}"
_WORD = (rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}){_LETTER}{{2,}}+(?:-(?!(?:{_TITLE}) )(?=\p{{Lu}}){_LETTER}{{2,}}+)*"
         r"(?![\p{L}\p{N}])(?![A-Za-z0-9._%+-]*+@)")
ENTITY = "|".join([_MAIL, _IP, _PHONE, _CARD, _NAME])
ENTITY_OR_WORD = f"{ENTITY}|{_WORD}"
# Country codes are free of prefixes; a separator, where there is one, ends them.
_COUNTRY = r"^\+(?:\d{1,3}(?!\d)|1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits, every second one from the right doubled."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2))))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _kind(e: Column) -> Column:
    digits = _digits(e)
    octets = F.transform(F.split(e, r"\."), lambda o: o.cast("int"))
    return (F.when(e.contains("@"), F.lit("email"))
            .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o <= 255), F.lit("ip")))
            .when(e.rlike(rf"^(?:{_TITLE}) "), F.lit("name")).when(e.rlike(r"^\p{L}"), F.lit("word"))
            .when(e.rlike(r"^[+(]") | e.rlike(r"^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(F.length(digits) >= PHONE_DIGITS, F.lit("phone")))
            .when(F.length(digits).between(13, 19) & (F.pmod(_luhn_sum(digits), F.lit(10)) == 0), F.lit("card")))


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^(?:(?:{_TITLE}) )+", 0)


def _canon(kind: Column, e: Column) -> Column:
    """What all ways of writing one entity have in common."""
    gender = F.lit("n ")
    for g in ("m", "f"):
        own = "|".join(t.replace(".", r"\.") for t in TITLES[g])
        gender = F.when(_title(e).rlike(rf"(?:^| )(?:{own}) "), F.lit(f"{g} ")).otherwise(gender)
    name = F.concat(gender, F.lower(F.expr("substring(_e, length(_t) + 1)")))
    return (F.when(kind == "email", F.lower(e)).when(kind == "ip", e).when(kind == "name", name).when(kind == "word", F.lower(e))
            .when(kind == "phone", _digits(F.regexp_replace(e, _COUNTRY, ""))).otherwise(_digits(e)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (2 * F.pmod(i, F.lit(_STREAM)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(key: str, *parts: Column) -> Column:
    seed = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(F.concat(seed, F.lit("|0")), 512), F.sha2(F.concat(seed, F.lit("|1")), 512))


def _pick(pool: str, b: Column) -> Column:
    return F.substring(F.lit(pool), (F.pmod(b, F.lit(len(pool))) + 1).cast("int"), F.lit(1))


def _like(s: Column, stream: Column) -> Column:
    """Lower-case text or digits written anew in the same shape."""
    def letter(i: Column) -> Column:
        c, b = F.substring(s, i, F.lit(1)), _byte(stream, i - 1)
        vowel = F.instr(F.lit(_VOWELS), c) > 0
        out = F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
        for script, (vowels, consonants) in LETTERS.items():
            out = out.when(c.rlike(rf"\p{{Is{script.capitalize()}}}"), F.when(vowel, _pick(vowels, b)).otherwise(_pick(consonants, b)))
        return out.otherwise(c)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), letter), "")).otherwise(F.lit(""))


def _longer(s: Column, stream: Column, attempt: Column, pool: str = "aeiou") -> Column:
    """A letter more per attempt after the eighth, for shapes with few choices."""
    extra = F.transform(F.sequence(F.lit(1), F.greatest(attempt - 8, F.lit(1))), lambda i: _pick(pool, _byte(stream, i + 77)))
    return F.when(attempt > 8, F.concat(s, F.array_join(extra, ""))).otherwise(s)


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, attempt) with column ``drawn``, the replacement
    at that attempt in canonical form; an address keeps its domain here."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    own, by_word, first = F.col("_own"), F.col("_by_word"), F.col("_first")
    # streams are columns: inside the letter-wise lambdas they would be hashed anew for each letter
    rows = entities.withColumn("_first", F.when(kind == "given", F.expr("substring_index(substring(canon, 3), ' ', 1)")))
    rows = rows.withColumn("_own", _stream(key, kind, canon, attempt))
    rows = rows.withColumn("_by_word", F.when(kind == "given", _stream(key, kind, F.substring(canon, 1, 2), first, attempt)))
    at = F.substring_index(canon, "@", -1)
    email = F.concat(_longer(_like(F.substring_index(canon, "@", 1), own), own, attempt), F.lit("@"), at)
    domain = F.concat(_longer(_like(F.regexp_extract(canon, r"^(.*)\.[^.]*$", 1), own), own, attempt), F.lit("."), F.substring_index(canon, ".", -1))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(own, 2 * i) * 256 + _byte(own, 2 * i + 1), F.lit(254)) + 1).cast("string")), ".")
    phone = _longer(_like(canon, own), own, attempt, "0123456789")
    body = F.concat(F.substring(canon, 1, 1), _like(F.expr("substring(canon, 2, length(canon) - 2)"), own))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    surname = _longer(_like(canon, own), own, attempt)
    # a given name by its word and gender; the surnames behind it only keep replacements apart
    rest = F.expr("substring(canon, 4 + length(_first))")
    given = _like(first, by_word)
    pools = {**FIRST_NAMES, **{("n", s): FIRST_NAMES["f", s] + FIRST_NAMES["m", s] for s in LETTERS}}
    for (gender, script), pool in pools.items():
        drawn = F.get(F.array(*[F.lit(p.lower()) for p in pool]), F.pmod(_byte(by_word, F.lit(99)), F.lit(len(pool))))
        given = F.when(canon.startswith(gender) & first.rlike(rf"^\p{{Is{script.capitalize()}}}"), drawn).otherwise(given)
    given = F.concat(_longer(given, by_word, attempt), F.lit(" "), rest)
    drawn = (F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "phone", phone)
             .when(kind == "card", F.concat(body, check)).when(kind == "surname", surname).otherwise(given))
    return rows.withColumn("drawn", drawn).drop("_own", "_by_word", "_first")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, replacement) of every distinct entity, free of collisions."""
    first = entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))
    now = materialize(_draw(first, key).withColumnRenamed("drawn", "replacement"), "surrogates")
    for _ in range(MAX_ATTEMPTS):
        owner = now.groupBy("kind", "replacement").agg(F.min(F.struct("attempt", "canon")).alias("owner"))
        real = now.select("kind", F.col("canon").alias("replacement"), F.lit(True).alias("taken"))
        checked = now.join(owner, ["kind", "replacement"]).join(real, ["kind", "replacement"], "left")
        clash = (F.col("owner.canon") != F.col("canon")) | F.coalesce("taken", F.lit(False))
        again = materialize(checked.where(clash).select("kind", "canon", (F.col("attempt") + 1).alias("_next")), "clashes")
        if again.isEmpty():
            return now.select("kind", "canon", "replacement")
        anew = now.join(again, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("_next", "attempt"))
        anew = _draw(anew, key).withColumn("replacement", F.when(F.col("_next").isNotNull(), F.col("drawn")).otherwise(F.col("replacement")))
        now = materialize(anew.select("kind", "canon", "attempt", "replacement"), "surrogates")
    raise ValueError(f"collisions are left after {MAX_ATTEMPTS} attempts")


def _worn(kind: Column, e: Column, new: Column) -> Column:
    """The canonical replacement in the format of one mention."""
    def refill(surface: Column, digits: Column) -> Column:
        n = F.length(_digits(surface))
        return F.concat(same_length(surface, digits), F.substring(digits, n + 1, F.length(digits)))

    def same_length(surface: Column, digits: Column) -> Column:
        slot = lambda i: F.length(_digits(F.substring(surface, F.lit(1), i)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(surface)), lambda i: F.when(
            F.substring(surface, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, slot(i), F.lit(1))).otherwise(F.substring(surface, i, F.lit(1)))), "")

    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), lambda i: F.when(
        F.substring(e, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), "")
    plain = F.substring(new, F.lit(3), F.length(new))
    loud = F.expr("upper(substring(_e, length(_t) + 1)) = substring(_e, length(_t) + 1)")
    titled = F.array_join(F.transform(F.split(plain, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "-")), " ")
    phone = F.concat(F.regexp_extract(e, _COUNTRY, 0), refill(F.regexp_replace(e, _COUNTRY, ""), new))
    return (F.when(kind == "email", cased).when(kind == "ip", new).when(kind == "phone", phone).when(kind == "card", refill(e, new))
            .otherwise(F.concat(_title(e), F.when(loud, F.upper(plain)).otherwise(titled))))


def _name_words(names: DataFrame) -> DataFrame:
    """(canon, at, word, given) of the words of names (canon)."""
    words = names.select("canon", F.split(F.expr("substring(canon, 3)"), " ").alias("_words"))
    each = words.select("canon", F.size("_words").alias("_n"), F.posexplode("_words").alias("at", "word"))
    return each.select("canon", "at", "word", ((F.col("at") == 0) & (F.col("_n") > 1)).alias("given"))


def _pattern(text: Column, of) -> Column:
    """``of(pattern)``: single words matter only in texts with a titled name."""
    return F.when(text.rlike(_NAME), of(ENTITY_OR_WORD)).otherwise(of(ENTITY))


def _scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row, doc, found), written once: the rows of ``docs`` as one value, so
    that no name can clash, their id with a hash of the text, and the mentions."""
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("tie"))
    found = _pattern(F.col(text), lambda p: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)))
    return materialize(docs.select(F.struct("*").alias("row"), doc.alias("doc"), found.alias("found")), "scanned")


def _told(scanned: DataFrame, key: str) -> DataFrame:
    """(doc, new, n_entities, kinds) of the documents with mentions: what
    stands in the place of each mention, in order."""
    # rows of one id and text are one document
    hits = scanned.where(F.size("found") > 0).select("doc", "found").distinct()
    mentions = hits.select("doc", F.posexplode("found").alias("at", "_e"))
    surface = mentions.select("_e").distinct().withColumn("_t", _title(F.col("_e"))).withColumn("kind", _kind(F.col("_e")))
    surface = materialize(surface.where("kind is not null").withColumn("canon", _canon(F.col("kind"), F.col("_e"))), "surface")
    # behind a title without gender: the person of that name with one, where there is one
    names = surface.where("kind = 'name'").select("canon").distinct()
    known = names.groupBy(F.expr("substring(canon, 3)").alias("_words")).agg(F.min("canon").alias("_known"))
    titled = surface.where("kind = 'name'").withColumn("_words", F.expr("substring(canon, 3)")).join(known, "_words")
    titled = titled.select("_e", "_t", F.when(F.col("canon").startswith("n "), F.col("_known")).otherwise(F.col("canon")).alias("canon"))
    titled = materialize(titled, "titled")
    words = materialize(_name_words(titled.select("canon").distinct()), "name_words")
    domain = F.substring_index("canon", "@", -1)
    entities = surface.where("kind not in ('name', 'word')").select("kind", "canon")
    entities = entities.union(surface.where("kind = 'email'").select(F.lit("domain"), domain))
    entities = entities.union(words.where("not given").select(F.lit("surname"), "word")).union(words.where("given").select(F.lit("given"), "canon"))
    new = surrogate_table(entities, key)
    surnames = words.where("not given").join(new.where("kind = 'surname'").select(F.col("canon").alias("word"), "replacement"), "word")
    given = words.where("given").join(new.where("kind = 'given'").select("canon", F.substring_index("replacement", " ", 1).alias("replacement")), "canon")
    words = materialize(surnames.unionByName(given), "new_words")
    whole = words.groupBy("canon").agg(F.sort_array(F.collect_list(F.struct("at", "replacement"))).alias("_parts"))
    whole = whole.select("canon", F.concat(F.lit("x "), F.array_join(F.col("_parts.replacement"), " ")).alias("replacement"))
    worn = lambda kind: _worn(kind, F.col("_e"), F.col("replacement")).alias("worn")
    domains = new.where("kind = 'domain'").select(F.col("canon").alias("_domain"), F.col("replacement").alias("_new_domain"))
    plain = surface.where("kind not in ('name', 'word')").join(new, ["kind", "canon"])
    plain = plain.withColumn("_domain", F.when(F.col("kind") == "email", domain)).join(domains, "_domain", "left")
    address = F.concat(F.substring_index("replacement", "@", 1), F.lit("@"), F.col("_new_domain"))
    plain = plain.withColumn("replacement", F.coalesce(address, "replacement")).select("_e", "kind", worn(F.col("kind")))
    table = materialize(plain.union(titled.join(whole, "canon").select("_e", F.lit("name"), worn(F.lit("name")))), "worn")
    # words of a document's titled names stand for them elsewhere in it, surnames before given names
    in_doc = mentions.join(titled.select("_e", "canon"), "_e").select("doc", "canon").distinct().join(words, "canon")
    in_doc = in_doc.groupBy("doc", "word").agg(F.min(F.struct("given", "replacement")).alias("_w"))
    bare = mentions.join(surface.where("kind = 'word'").select("_e", "_t", F.col("canon").alias("word")), "_e").join(in_doc, ["doc", "word"])
    bare = bare.withColumn("replacement", F.concat(F.lit("x "), F.col("_w.replacement")))
    bare = bare.select("doc", "at", F.lit("name").alias("_kind"), worn(F.lit("name")).alias("_worn"))
    mentions = mentions.join(table, "_e", "left").join(bare, ["doc", "at"], "left").select(
        "doc", "at", "_e", F.coalesce("kind", "_kind").alias("kind"), F.coalesce("worn", "_worn").alias("worn"))
    return mentions.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("worn", "_e").alias("worn")))).alias("new"),
        F.count("kind").alias("n_entities"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def _new_text(text: Column) -> Column:
    """The text with ``new`` in the places of its mentions; the gaps are cut
    where the text is, so they are never shuffled on their own."""
    gaps = _pattern(text, lambda p: F.split(text, p, -1))
    return F.array_join(F.zip_with(gaps, "new", lambda g, w: F.concat(g, F.coalesce(w["worn"], F.lit("")))), "")


def _rewritten(docs: DataFrame, key: str, id_col: str, text: str) -> DataFrame:
    """(row, doc, n_entities, kinds): every row of ``docs`` with its new text;
    rows without mentions take part in no shuffle."""
    scanned = _scan(docs, id_col, text)
    quiet = scanned.where(F.coalesce(F.size("found"), F.lit(0)) <= 0).select("row", "doc", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    loud = scanned.where(F.size("found") > 0).select("row", "doc").join(_told(scanned, key), "doc")
    loud = loud.withColumn("_new", F.when(F.col("n_entities") > 0, _new_text(F.col("row")[text])).otherwise(F.col("row")[text]))
    row = F.col("row").withField(text, F.col("_new"))
    if "n_chars" in docs.columns:
        n_chars = F.length("_new").cast(dict(docs.dtypes)["n_chars"])
        row = row.withField("n_chars", F.when(F.col("n_entities") > 0, n_chars).otherwise(F.col("row")["n_chars"]))
    return quiet.unionByName(loud.select(row.alias("row"), "doc", "n_entities", "kinds"))


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tie, n_entities, kinds, new_text) of the rows with entities; tie is
    a hash of the text."""
    rows = _rewritten(docs, key, id_col, text).where("n_entities > 0")
    return rows.select("doc.id", "doc.tie", "n_entities", "kinds", F.col("row")[text].alias("new_text"))


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with replaced entities; ``n_chars``, where there is one, is
    counted anew for changed texts."""
    return _rewritten(docs, key, id_col, text).select("row.*")


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_entities, kinds, text): one row per row of ``docs``, as
    ``pseudonymize`` gives it."""
    rows = _rewritten(docs, key, id_col, text)
    return rows.select(F.col("row")[id_col].alias(id_col), "n_entities", "kinds", F.col("row")[text].alias(text))
