"""Personal data replaced by keyed, type-consistent surrogates (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm.common import let, saved, table, text_or_empty

#: Session setting with the secret key of the query; the default is public, for tests alone.
KEY_SETTING = "spark.shelfmatch.surrogateKey"
#: Patterns of what counts as personal data, tried in this order at each place.
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}"
IPV4 = rf"(?<![\p{{L}}\p{{N}}_.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}_]|\.\d)"
IBAN = rf"{EDGE}[A-Z]{{2}}\d{{2}}(?:(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?|(?: ?[A-Z0-9]{{4}}){{2}} ?[A-Z0-9]{{3}}){END}"
CARD = rf"{EDGE}(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}){END}"
SSN = r"(?<![\p{L}\p{N}_-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])"
PHONE = (
    r"(?<![\p{L}\p{N}_+-])(?:(?:\+\d{1,3}[ -]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ -])\d{3,4}[ -]\d{3,4}|\+\d{1,3}(?:[ -]?\d{2,4}){2,5})(?![\p{L}\p{N}_-])"
    # With dots, or a national number in one piece; versions, decimals and amounts are none.
    r"|(?<![\p{L}\p{N}_.,#$€£/-])(?:(?:\+?\d{1,3}\.)?\d{3}\.\d{3}\.\d{4}|\+\d{1,3}(?:\.\d{2,4}){2,5}|(?<!\+)(?:1?[2-9]\d{9}|0[1-9]\d{8,9}))"
    r"(?![\p{L}\p{N}_%-]|[.,]\d)"
)
MALE, FEMALE = r"Mr|Mister|Herr|Monsieur|Señor|Sir|Господин|г-н", r"Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Госпожа|г-жа"
PERSON = rf"{EDGE}(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
KINDS = {"email": EMAIL, "ipv4": IPV4, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every match has: a sign or digit, or a title. Tried first, as most texts have none.
HINTS = r"[@0-9]", rf"(?=[MHSFГг])(?:{MALE}|{FEMALE})\.? \p{{Lu}}"

#: Letters by script, given names by gender and script, and syllables of surnames by script.
LATIN, ACCENTED, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëíîïñóôöúûü", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helen Ida Julia Karin Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария Нина Ольга".split(),
    ("m", "greek"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Στέφανος".split(),
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Ελένη Ζωή Ιωάννα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba den fol gar hin kel lam mor nes pol rin sal tor vin wes zan".split(),
    "cyrillic": "бар вел гор дан кол лам мир нов пет рад сам тур".split(),
    "greek": "βα γαρ δεν κελ λαμ μορ νες πολ ριν σαλ τορ φολ".split(),
}
ENDINGS = {("m", "latin"): "er", ("f", "latin"): "er", ("m", "cyrillic"): "ов", ("f", "cyrillic"): "ова", ("m", "greek"): "ης", ("f", "greek"): "η"}


def _draw(seed: Column, at: Column | int, size: int) -> Column:
    """A keyed number below ``size`` for place ``at``; the seed is secret, so the hash is."""
    return F.pmod(F.xxhash64(seed, F.lit(at) if isinstance(at, int) else at), F.lit(size)).cast("int")


def _pick(seed: Column, at: Column | int, options: list[str] | str) -> Column:
    return F.array(*[F.lit(o) for o in options])[_draw(seed, at, len(options))]


def _seed(key: str, kind: Column | str, value: Column, attempt: Column | int) -> Column:
    parts = [F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, value]
    return F.sha2(F.concat_ws("|", *parts, F.lit(attempt).cast("string") if isinstance(attempt, int) else attempt.cast("string")), 256)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def kind_of(match: Column) -> Column:
    """Which kind a match is: the first whose pattern it fits whole."""
    out = F.when(match.contains("@"), "email")
    for kind, pattern in KINDS.items():
        if kind != "email":
            out = out.when(match.rlike(rf"^(?:{pattern})$"), kind)
    return out.otherwise("other")


def canonical(match: Column, kind: Column) -> Column:
    """One spelling per entity: mentions that differ in case, spacing or country prefix refer to one."""
    digits = _digits(match)
    gender = F.when(match.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("f")
    name = F.regexp_replace(match, rf"^(?:{MALE}|{FEMALE})\.? ", "")
    return (
        F.when(kind == "email", F.lower(match))
        .when(kind == "person", F.concat_ws(":", gender, F.lower(name)))
        .when(kind == "phone", F.substr(digits, F.greatest(F.lit(1), F.length(digits) - 9)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .otherwise(match)
    )


def _spell(text: Column, seed: Column) -> Column:
    """Every letter and digit drawn anew in its script and class; other characters stay."""
    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), _pick(seed, i, LATIN))
            .when(c.rlike("[A-Z]"), _pick(seed, i, LATIN.upper())).when(c.rlike(r"\p{IsCyrillic}"), _pick(seed, i, CYRILLIC))
            .when(c.rlike(r"\p{IsGreek}"), _pick(seed, i, GREEK)).when(c.rlike(r"\p{IsLatin}"), _pick(seed, i, ACCENTED)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _checksum(digits: Column) -> Column:
    """Luhn sum of all digits, the last counted once."""
    n = F.length(digits)
    values = F.transform(F.split(digits, ""), lambda c, i: let(
        c.cast("int") * F.when((n - 1 - i) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)
    ))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _card(digits: Column, seed: Column) -> Column:
    """Same first digit and length; the last makes the checksum right if it was, else wrong."""
    middle = _spell(F.substr(digits, F.lit(2), F.length(digits) - 2), seed)
    body = F.concat(F.substring(digits, 1, 1), middle)
    return let(body, lambda b: let(F.pmod(-_checksum(F.concat(b, F.lit("0"))), F.lit(10)), lambda right: F.concat(
        b, F.when(_checksum(digits) % 10 == 0, right).otherwise((right + 1 + _draw(seed, -1, 9)) % 10).cast("string")
    )))


def _mod97(account: Column) -> Column:
    """Remainder by 97 of an account number's digits and letters (A is 10), its first four signs last."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.pmod(
        F.when(F.ascii(c) >= 65, a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48), F.lit(97)
    ))


def _iban(account: Column, seed: Column) -> Column:
    """Same country and length; the check digits are right if they were, else wrong."""
    country = F.substring(account, 1, 2)
    return let(_spell(F.substr(account, F.lit(5)), seed), lambda bank: let(
        # From 0 to 96, of the 97 check digits from 02 to 98.
        96 - _mod97(F.concat(country, F.lit("00"), bank)), lambda right: F.concat(
            country, F.lpad((F.when(_mod97(account) == 1, right).otherwise((right + 1 + _draw(seed, -1, 96)) % 97) + 2).cast("string"), 2, "0"), bank,
        )))


def surrogate(kind: Column, value: Column, attempt: Column | int, key: str) -> Column:
    """Canonical form of the replacement of a canonical entity."""
    seed = _seed(key, kind, value, attempt)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    # Addresses of one domain stay together, unless a later attempt must part them.
    email = F.concat(_spell(local, seed), F.lit("@"), _spell(labels, _seed(key, "domain", domain, attempt)), F.lit("."), top)
    octets = F.split(value, r"\.")
    private = octets[0].isin("10", "127") | (octets[0] == "192") & (octets[1] == "168")
    # Private addresses stay in their network, and if that is full, in the largest private one.
    tries = F.lit(attempt) if isinstance(attempt, int) else attempt
    ip = F.concat_ws(
        ".", F.when(~private, (_draw(seed, 0, 222) + 1).cast("string")).when(tries < 8, octets[0]).otherwise("10"),
        F.when(private & (tries < 4), octets[1]).otherwise(_draw(seed, 1, 256).cast("string")),
        _draw(seed, 2, 256).cast("string"), (_draw(seed, 3, 254) + 1).cast("string"),
    )
    phone = F.concat((_draw(seed, -1, 8) + 2).cast("string"), _spell(F.substr(value, F.lit(2)), seed))
    gender, name = F.substring(value, 1, 1), F.substr(value, F.lit(3))
    words, script = F.split(name, " "), F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # A family shares its new name, whatever its members are called; Slavic names lose their female ending first.
    root = F.regexp_replace(F.element_at(words, -1), "(?<=[вн])а$", "")
    given_seed, family_seed = _seed(key, "given", F.concat_ws(":", gender, words[0]), attempt), _seed(key, "family", root, attempt)
    given = family = F.lit(None).cast("string")
    for (g, s), options in GIVEN.items():
        here = (gender == g) & (script == s)
        # Every attempt has one syllable more, so names do not run out.
        more = F.transform(F.sequence(F.lit(0), 3 + tries), lambda i: _pick(family_seed, i, SYLLABLES[s]))
        drawn = F.concat(F.array_join(more, ""), F.lit(ENDINGS[g, s]))
        given, family = F.when(here, _pick(given_seed, 0, [o.lower() for o in options])).otherwise(given), F.when(here, drawn).otherwise(family)
    person = F.concat(gender, F.lit(":"), F.when(F.size(words) > 1, F.concat(given, F.lit(" "))).otherwise(""), family)
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ip).when(kind == "card", _card(value, seed)).when(kind == "phone", phone)
        .when(kind == "iban", _iban(value, seed)).when(kind == "person", person).otherwise(_spell(value, seed))
    )


def rendered(match: Column, kind: Column, core: Column) -> Column:
    """The surrogate written as the mention was: its separators, prefix, title and capitals."""
    def woven(sign: str) -> Column:
        """The last signs of the match, in turn, become those of the core."""
        before = F.length(F.regexp_replace(match, sign, "")) + F.length(core) - F.length(match)
        return F.array_join(F.transform(F.split(match, ""), lambda c, i: let(
            before + F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), rf"(?!{sign}).", "")),
            lambda at: F.when(c.rlike(sign) & (at > 0), F.substr(core, at, F.lit(1))).otherwise(c),
        )), "")

    cased = F.array_join(F.transform(F.split(match, ""), lambda c, i: let(
        F.substr(core, i + 1, F.lit(1)), lambda x: F.when(c != F.lower(c), F.upper(x)).otherwise(x)
    )), "")
    title = F.regexp_extract(match, rf"^((?:{MALE}|{FEMALE})\.? )", 1)
    return (
        F.when(core.startswith("["), core).when(kind == "email", cased).when(kind == "person", F.concat(title, F.initcap(F.substr(core, F.lit(3)))))
        .when(kind.isin("card", "phone", "ssn"), woven("[0-9]")).when(kind == "iban", woven("[A-Z0-9]")).otherwise(core)
    )


def assigned(entities: DataFrame, key: str, most_rounds: int = 64) -> DataFrame:
    """Distinct ``kind, value`` with ``attempt`` and ``core``, no two of a kind alike.

    An entity whose surrogate another entity of the kind also has (all but the first in order), or
    that is itself an entity of the corpus, draws again until none is left. The driver reads one
    count a round; each round is written to the shared folder. An entity that has found no free form
    of its kind after ``most_rounds`` draws gets a keyed mark of its own, ``[kind digest]``.
    """
    kind, value = F.col("kind"), F.col("value")
    drawn = saved(entities.withColumn("attempt", F.lit(0)).withColumn("core", surrogate(kind, value, 0, key)))
    for round_ in range(most_rounds + 1):
        first = drawn.groupBy("kind", "core").agg(F.min("value").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        real = entities.select("kind", F.col("value").alias("core"), F.lit(True).alias("__real"))
        checked = drawn.join(first, ["kind", "core"], "left").join(real, ["kind", "core"], "left")
        again = (F.col("__n").isNotNull() & (F.col("__first") != value)) | F.col("__real").isNotNull()
        checked = saved(checked.select("kind", "value", "attempt", "core", F.coalesce(again, F.lit(False)).alias("__again")))
        if not checked.where("__again").limit(1).count():
            break
        next_attempt = F.col("attempt") + F.when(F.col("__again"), 1).otherwise(0)
        mark = F.concat(F.lit("["), kind, F.lit(" "), F.substring(_seed(key, kind, value, -1), 1, 32), F.lit("]"))
        new = surrogate(kind, value, F.col("attempt"), key) if round_ < most_rounds else mark
        drawn = saved(checked.withColumn("attempt", next_attempt).withColumn(
            "core", F.when(F.col("__again"), new).otherwise(F.col("core"))
        ).drop("__again"))
        checked = drawn
    return checked.drop("__again")


def with_surrogates(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal data in every whole text; the rest of the text stays as it is.

    Kinds are those of KINDS. A replacement depends on ``key`` and the entity only, so an entity has
    one everywhere, in any task and run over the same corpus; different entities of a kind have
    different ones, which no entity of the corpus has itself (``assigned``). Country prefix,
    separators, capitals, script, gender, domain endings and checksums (cards, account numbers) are
    kept; names in scripts other than Latin, Cyrillic and Greek become Latin ones. A kind whose forms run
    out gives marks (``assigned``). Returns all columns
    with the new text, ``n_private`` and ``private_kinds`` (in order of place). Null texts stay null.
    Identifiers may be null or repeat. Columns that begin with two underscores or have the added
    names are replaced.

    Only texts with a match are moved. An entity in a third of all documents is one row before it is
    drawn; mentions draw the first attempt where they stand, and only the few entities that had to
    draw again are joined.
    """
    keys = ["__null", "__id", "__hash"]
    id_kind = df.schema[id_col].dataType
    text = text_or_empty(text_col)
    own = [c for c in df.columns if c not in ("n_private", "private_kinds")]
    keyed = df.select(*own).withColumns({
        "__null": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0).cast(id_kind)), "__hash": F.xxhash64(text_col),
    })
    found = (text.rlike(HINTS[0]) | text.rlike(HINTS[1])) & text.rlike(ANY)
    some = keyed.where(found)
    match, kind, value = F.col("match"), F.col("kind"), F.col("value")
    mentions = saved(
        some.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("at", "match"))
        .withColumn("kind", kind_of(match)).withColumn("value", canonical(match, kind))
    )
    table_ = assigned(saved(mentions.select("kind", "value").distinct()), key)
    redrawn = table_.where("attempt > 0").select("kind", "value", F.col("core").alias("__core"))
    core = F.coalesce(F.col("__core"), surrogate(kind, value, 0, key))
    written = mentions.join(redrawn, ["kind", "value"], "left").withColumn("core", core).select(
        *keys, F.struct("at", "kind", rendered(match, kind, F.col("core")).alias("new")).alias("one")
    )
    by_text = written.groupBy(*keys).agg(F.sort_array(F.collect_set("one")).alias("__new"))
    pieces = F.zip_with(F.split(text, ANY, -1), F.col("__new"), lambda gap, new: F.concat(gap, F.coalesce(new["new"], F.lit(""))))
    changed = some.join(by_text, keys).select(
        *[F.array_join(pieces, "").alias(c) if c == text_col else F.col(c) for c in own],
        F.size("__new").cast("long").alias("n_private"), F.array_join(F.col("__new.kind"), ",").alias("private_kinds"),
    )
    same = keyed.where(~found).select(*own, F.lit(0).cast("long").alias("n_private"), F.lit("").alias("private_kinds"))
    return same.unionByName(changed)


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, "surrogates of this corpus")
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
