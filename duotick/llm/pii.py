"""Surrogates for personal data, with DataFrame functions alone.

Entities are found by one pattern: e-mail addresses, IP addresses, payment cards, social security numbers, IBANs, phone numbers,
secrets, and persons named after an honorific.  An entity's canonical form leaves case and separators aside, so all its
spellings are one entity in the whole corpus and get one surrogate (coreference), which is drawn by a keyed hash of kind and canonical form:

- digits for digits and letters for letters of the same script, so the length stays; separators and case are those of each spelling;
- a card keeps its first digit and passes the Luhn check if and only if the original does; an IP address stays one, private ranges stay
  private; an address keeps its top-level domain, and equal domains stay equal; an IBAN keeps its country, a phone number its first digit;
- a given name becomes one of the same gender (from the honorific; of either, if that tells none) and script, a surname one of the same script; bare
  mentions of a name found in a document are replaced there too, but for names that are also of the calendar ("May").

No surrogate may equal another entity's surrogate or any entity of its kind in the corpus, names of all kinds being one: colliding ones are drawn anew, by
rounds, until none is left.  From round ``LENGTHEN`` on, kinds that have no fixed format (e-mail, secrets, names) get longer surrogates, and addresses of 192.168
get ones of the range 10; all others keep their format in every round.  So this ends unless a format's entities are near half of all its forms.

Persons without an honorific aren't found, and in scripts without capitals one word after the honorific counts as the name.

The key decides all surrogates: keep it secret and use it again for stable results.  It reaches the executors as a row, not as a literal, so plans don't show it.

Defined results.  Null text stays null.  Texts without an entity are returned as they are.  Empty table: no rows.  Repeated rows: each is
rewritten alike.  Null ``doc_id``: like any other value.  All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: From this round on surrogates that collide are lengthened, or drawn from a wider range.
LENGTHEN = 8
MAX_ROUNDS = 40

# Honorifics by gender.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "Mx", "Dra", "Докт", "Проф")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία")

CASELESS = ("السيدة", "السيد", "גברת", "מר", "श्रीमती", "श्री")  # of scripts without capitals

# Names of months that are also names of persons.
CALENDAR = ("jan", "april", "may", "june", "july", "august", "mai", "juin", "juillet", "août", "avril", "abril", "julio", "mayo", "junio", "augustin", "augusto")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?![\"'\s])[\p{Alnum}_+/=-]{12,}+(?:\.[\p{Alnum}_+/=-]++)*+"
    r"|(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\p{{N}})",
    "ip6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ -]?\d{4}){3}(?!\p{N})|(?<![\p{L}\p{N}])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\p{N})",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\p{N})"
    r"|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\p{N})|(?<![\p{L}\p{N}-])\d{3}[-.]\d{3}[-.]\d{4}(?!\p{N})",
    "person": rf"(?<!\p{{L}})(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.? {_NAME}(?: {_NAME}){{0,2}}"
    rf"|(?<![\p{{L}}\p{{M}}])(?:{'|'.join(CASELESS)}) [\p{{Lo}}\p{{M}}]{{2,40}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Holds for every text that has an entity; it is quick to tell for the rest.
HINT = rf"[0-9@]|(?i:token|secret|passw|key)|AKIA|ghp_|[a-f]{{32}}|[A-F]{{32}}|(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? \p{{Lu}}|{'|'.join(CASELESS)}|::|[a-fA-F]:"

# Letters of each script, and the parts of invented names.
ALPHABETS = {
    r"[a-z]": "abcdefghijklmnopqrstuvwxyz",
    r"\p{IsLatin}": "àáâäçèéêëíîïñóôöùúûü",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    r"\p{IsHiragana}|\p{IsKatakana}": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    r"\p{IsHan}": "丁万三上下中丹久云五井今仁介代任伊会伯何佐佳依侯元光克全公兰关兴冠冬凡凤刚力功加勇化北千华卓南原友古台史叶司合吉同名向君吴",
}
NAMES = {
    # script: (syllables, male endings, female endings, surname endings)
    "latin": (["al", "bar", "cor", "dan", "el", "fer", "gar", "hal", "is", "jor", "kel", "lor", "mar", "nor", "or", "per", "quin", "ros", "sel", "tor", "ul", "ver", "wen", "zan"], ["o", "us", "an", "in", "or", "ik"], ["a", "ia", "ina", "ella", "ette", "ise"], ["son", "er", "man", "ley", "ford", "well", "ton", "wick"]),
    "cyrillic": (["ар", "бор", "вел", "гор", "дан", "ел", "жар", "зор", "ил", "кар", "лад", "мир", "ник", "ол", "пав", "рад", "сев", "тим", "ул", "фед"], ["ан", "ий", "ей", "ир", "ом"], ["а", "ия", "ина", "ея"], ["енко", "ук", "ских", "ман", "ых"]),
    "greek": (["αλ", "βασ", "γερ", "δημ", "ελ", "ζαν", "ηλ", "θεο", "καρ", "λαμ", "μαν", "νικ", "παν", "ροδ", "σταυ", "τιμ", "φιλ", "χαρ"], ["ος", "ης", "ας"], ["α", "η", "ία"], ["άκης", "ίδης", "όπουλος", "άτος"]),
}


def kind_of(match: Column) -> Column:
    whole = lambda k: match.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(whole("email"), "email").when(whole("ip"), "ip").when(whole("ip6"), "ip6").when(whole("card"), "card").when(whole("ssn"), "ssn")
        .when(whole("iban"), "iban").when(whole("phone"), "phone").when(whole("person"), "person").otherwise("secret")
    )


_HEX = "^[0-9a-fA-F]+$"
_GIVEN = ("given_m", "given_f", "given_n")
_NAMES = ("surname", *_GIVEN)


def _scope(kind: Column) -> Column:
    """Kinds among which surrogates must differ: a bare name may be of any."""
    return F.when(kind.isin(*_NAMES), "name").otherwise(kind)


def canonical(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind.isin("card", "ssn", "ip"), F.regexp_replace(raw, "[ -]", "")).when(kind == "phone", F.regexp_replace(raw, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", "")).when(kind.isin("email", "ip6", *_NAMES), F.lower(raw))
        .when((kind == "secret") & raw.rlike(_HEX), F.lower(raw)).otherwise(raw)
    )


def _digest(key: Column, *parts: Column) -> Column:
    """256 hexadecimal digits of a keyed hash."""
    message = F.concat_ws("\x1f", *parts)
    inner = F.sha2(F.concat(key, F.lit("\x1e"), message), 256)
    return F.concat(*(F.sha2(F.concat(key, F.lit(f"\x1d{i}\x1d"), inner), 256) for i in range(4)))


def _byte(digest: Column, i: Column) -> Column:
    """Number i of 128 bytes, around again beyond; int."""
    return F.conv(F.substr(digest, 2 * F.pmod(i, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def _of(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _letters(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Every digit and letter gives way to one of its class and script; other characters and case stay."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(digest, i) + 7 * F.floor(i / 128).cast("int")
        low = F.lower(c)
        drawn = F.when(c.rlike("[0-9]"), _of("0123456789", n))
        for script, letters in ALPHABETS.items():
            drawn = drawn.when(low.rlike(script), _of(letters, n))
        drawn = F.when(hexadecimal & c.rlike("[0-9a-f]"), _of("0123456789abcdef", n)).otherwise(drawn.otherwise(c))
        return F.when(c != low, F.upper(drawn)).otherwise(drawn)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits, the last one being the check digit."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.pmod(2 * c.cast("int"), F.lit(10)) + F.floor(2 * c.cast("int") / 10).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(canon: Column, digest: Column) -> Column:
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon) - 2), lambda i: _of("0123456789", _byte(digest, i))), ""))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    valid = F.pmod(_luhn_sum(canon), F.lit(10)) == 0
    wrong = F.pmod(check + 1 + F.pmod(_byte(digest, F.lit(30)), F.lit(9)), F.lit(10))
    return F.concat(body, F.when(valid, check).otherwise(wrong).cast("string"))


def _ip(canon: Column, digest: Column, wide: bool = False) -> Column:
    """``wide``: an address of 192.168 gets one of 10, a range 256 times as large."""
    b = [_byte(digest, F.lit(i)) for i in range(4)]
    tail = F.concat_ws(".", b[2].cast("string"), b[3].cast("string"))
    public = F.pmod(b[0], F.lit(199)) + 11  # 11 to 209; private 172 and 192 and loopback are stepped over
    public = F.when(public.isin(127, 172, 192), public + 1).otherwise(public)
    return F.when(canon.startswith("10.") | (canon.startswith("192.168.") & F.lit(wide)), F.concat(F.lit("10."), b[1].cast("string"), F.lit("."), tail)).when(canon.startswith("192.168."), F.concat(F.lit("192.168."), tail)).otherwise(F.concat(public.cast("string"), F.lit("."), b[1].cast("string"), F.lit("."), tail))


def _name(kind: Column, canon: Column, digest: Column) -> Column:
    def drawn(script: str) -> Column:
        syllables, male, female, surname = NAMES[script]
        pick = lambda options, i: F.get(F.array(*map(F.lit, options)), F.pmod(_byte(digest, F.lit(i)) * 256 + _byte(digest, F.lit(i + 1)), F.lit(len(options))))
        end = F.when(kind == "given_m", pick(male, 10)).when(kind == "given_f", pick(female, 10)).when(kind == "given_n", pick(male + female, 10)).otherwise(pick(surname, 10))
        third = F.when(kind == "surname", pick(syllables, 4)).otherwise(F.lit(""))
        return F.concat(pick(syllables, 0), pick(syllables, 2), third, end)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), drawn("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), drawn("greek")).when(canon.rlike(r"\p{IsLatin}"), drawn("latin")).otherwise(_letters(canon, digest, F.lit(False)))


def _ip6(canon: Column, digest: Column, wide: bool) -> Column:
    """A hexadecimal digit for each; ``wide``: eight groups of four."""
    return F.concat_ws(":", *(F.substr(digest, F.lit(1 + 4 * i), F.lit(4)) for i in range(8))) if wide else _letters(canon, digest, F.lit(True))


def draw(key: Column, kind: Column, canon: Column, attempt: int) -> Column:
    """The canonical form of a surrogate."""
    digest = _digest(key, kind, canon, F.lit(str(attempt)))
    no, late = F.lit(False), attempt >= LENGTHEN
    # kinds without a fixed format grow when short forms run out
    more = lambda letters: F.array_join(F.transform(F.sequence(F.lit(40), F.lit(39 + attempt)), lambda i: _of(letters, _byte(digest, i))), "") if late else F.lit("")
    # an address: the domain is drawn by itself, so equal domains stay equal; the top-level domain stays
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_letters(local, digest, no), more("0123456789"), F.lit("@"), _letters(host, _digest(key, F.lit("domain"), domain), no), top)
    prefix = F.regexp_extract(canon, "^(AKIA|ghp_)?", 0)
    secret = F.concat(prefix, _letters(F.substr(canon, F.length(prefix) + 1), digest, canon.rlike(_HEX)), more("0123456789"))
    kept = F.when(kind == "iban", F.substr(canon, F.lit(1), F.lit(2))).otherwise(F.regexp_extract(canon, r"^\+?\d", 0))
    numbers = F.concat(kept, _letters(F.substr(canon, F.length(kept) + 1), digest, no))
    return (
        F.when(kind == "email", email).when(kind == "card", _card(canon, digest)).when(kind == "ip", _ip(canon, digest, late)).when(kind == "ip6", _ip6(canon, digest, late))
        .when(kind.isin("iban", "phone", "ssn"), numbers).when(kind == "secret", secret).otherwise(F.concat(_name(kind, canon, digest), more("aeiou")))
    )


def render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate with the separators and the case of one spelling; what doesn't fit its places is appended."""
    places = F.when(kind.isin("card", "ssn", "phone"), "[0-9]").when(kind == "iban", "[0-9A-Z]").otherwise(".")
    bare = F.when(kind == "phone", F.regexp_replace(surrogate, r"\+", "")).otherwise(surrogate)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        mine = F.regexp_like(c, places)
        return F.struct(F.concat(acc["out"], F.when(mine, F.substr(bare, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + mine.cast("int")).alias("k"))

    filled = F.aggregate(F.split(raw, ""), start, step, lambda acc: F.concat(acc["out"], F.substr(bare, acc["k"] + 1)))
    # hexadecimal digits and letters change places, so a spelling all in capitals is told as a whole
    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw))
    cased = F.when(shouted, F.upper(surrogate)).otherwise(F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substr(raw, i + 1, F.lit(1)) != F.lower(F.substr(raw, i + 1, F.lit(1))), F.upper(c)).otherwise(c)), ""))
    name = F.when((F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), filled).when(kind.isin("ip", "ip6"), surrogate).when(kind.isin(*_NAMES), name).otherwise(cased)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, canon)``, distinct, to the same with ``surrogate``: distinct in each scope, and no entity of the scope."""
    spark = entities.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one row: literals would be shown in plans and event logs
    secret = spark.sql("SELECT * FROM VALUES (:key) AS t(__key)", args={"key": key})
    open_ = entities
    taken = entities.select(_scope(F.col("kind")).alias("scope"), F.col("canon").alias("surrogate")).distinct()
    done = None
    for attempt in range(MAX_ROUNDS):
        # drawing is costly for its few bytes, so entities are dealt to all tasks first
        dealt = open_.repartition(tasks, "kind", "canon").crossJoin(F.broadcast(secret))
        drawn = common.materialize(dealt.select("kind", "canon", _scope(F.col("kind")).alias("scope"), draw(F.col("__key"), F.col("kind"), F.col("canon"), attempt).alias("surrogate")), "drawn")
        clash = drawn.join(taken.withColumn("clash", F.lit(True)), ["scope", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("scope", "surrogate").orderBy("canon", "kind")) == 1
        settled = common.materialize(clash.withColumn("ok", F.col("clash").isNull() & first).select("kind", "canon", "scope", "surrogate", "ok"), "settled")
        good = settled.where("ok").drop("ok")
        done = good if done is None else done.unionByName(good)
        open_ = settled.where("NOT ok").select("kind", "canon")
        if open_.isEmpty():
            return done.drop("scope")
        taken = taken.unionByName(good.select("scope", "surrogate"))
    raise RuntimeError("surrogates still collide: a format's entities are near half of all its forms")


def _version() -> list[Column]:
    return [F.xxhash64("text").alias("__h"), F.crc32(F.col("text").cast("binary")).alias("__c")]


def entity_spans(docs: DataFrame) -> DataFrame:
    """Every entity of every distinct text: ``__h``, ``__c`` (which tell the text), ``pos``, ``sub`` (part of a name), ``raw``, ``kind``, ``canon``."""
    hinted = docs.where(F.col("text").rlike(HINT)).select(*_version(), F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("found"))
    once = hinted.where(F.size("found") > 0).dropDuplicates(["__h", "__c"])
    each = once.select("__h", "__c", F.posexplode("found").alias("pos", "match")).withColumn("kind0", kind_of(F.col("match")))
    parts = F.when(F.col("kind0") == "person", F.split("match", " ")).otherwise(F.array("match"))
    split = each.withColumn("n", F.size(parts)).select("__h", "__c", "pos", "match", "kind0", "n", F.posexplode(parts).alias("sub", "raw"))
    title = F.regexp_replace(F.substring_index("match", " ", 1), r"\.$", "")
    name = F.when(F.col("sub") == 0, "keep").when(F.col("sub") == F.col("n") - 1, "surname").when(title.isin(*FEMALE), "given_f").when(title.isin(*MALE), "given_m").otherwise("given_n")
    kinds = split.withColumn("kind", F.when(F.col("kind0") == "person", name).otherwise(F.col("kind0")))
    return kinds.select("__h", "__c", "pos", "sub", "raw", "kind", canonical(F.col("kind"), F.col("raw")).alias("canon"))


def _joined(between: Column, pieces: Column) -> Column:
    """What lies between the pieces, and the pieces, in turn."""
    return F.array_join(F.zip_with(between, pieces, lambda b, p: F.concat(F.coalesce(b, F.lit("")), F.coalesce(p, F.lit("")))), "")


def replace_entities(docs: DataFrame, key: str, count_as: str | None = None) -> DataFrame:
    """``docs`` with the texts rewritten; ``count_as`` names a column for the number of entities."""
    spans = common.materialize(entity_spans(docs), "spans")
    named = spans.where("kind <> 'keep'")
    entities = common.materialize(named.select("kind", "canon").distinct(), "entities")
    chosen = common.materialize(surrogates(entities, key), "surrogates")
    # a spelling is rendered once, however often it occurs
    spellings = named.select("kind", "raw", "canon").distinct().join(chosen, ["kind", "canon"]).select("kind", "raw", render(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
    spellings = common.materialize(spellings, "spellings")
    # a text has finitely many entities, so what is collected here is bounded by the text itself
    new = F.coalesce("new", "raw")
    placed = spans.join(spellings, ["kind", "raw"], "left").select("__h", "__c", "pos", "sub", "kind", "raw", new.alias("new"))
    rows = placed.groupBy("__h", "__c").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "new", "kind", "raw"))).alias("all"))
    listed = F.aggregate(
        "all", F.array().cast("array<string>"),
        lambda acc, x: F.when(x["sub"] == 0, F.array_append(acc, x["new"])).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), x["new"])))),
    )
    told = lambda x: x["kind"].isin(*_NAMES) & ~F.lower(x["raw"]).isin(*CALENDAR)
    names = F.array_distinct(F.transform(F.filter("all", told), lambda x: F.struct((-F.length(x["raw"])).alias("by"), x["raw"].alias("raw"), x["new"].alias("new"))))
    # written first, so that Spark can split the join for a text of very many copies
    per_text = common.materialize(rows.select("__h", "__c", listed.alias("__new"), F.array_sort(names).alias("__names")), "per-text")

    keyed = docs.select(F.struct(*docs.columns).alias("__row"), *_version())
    joined = keyed.join(per_text.hint("merge"), ["__h", "__c"], "left")
    text = F.col("__row.text")
    between = F.split(text, PATTERN, -1)
    # bare names are replaced between the entities, all in one pass, so no surrogate is rewritten
    any_name = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform("__names", lambda x: x["raw"]), "|"), F.lit(r")(?!\p{L})"))
    new_name = lambda m: F.get(F.filter("__names", lambda x: x["raw"] == m), F.lit(0))["new"]
    bare = lambda b: _joined(F.split(b, any_name, -1), F.transform(F.regexp_extract_all(b, any_name, F.lit(0)), new_name))
    rest = F.when(F.size("__names") > 0, F.transform(between, bare)).otherwise(between)
    out = F.when(F.col("__new").isNull(), text).otherwise(_joined(rest, F.col("__new")))
    counted = [F.coalesce(F.size("__new"), F.lit(0)).cast("long").alias(count_as)] if count_as else []
    return joined.select(*(out.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns), *counted)
