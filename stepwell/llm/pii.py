"""Personal data and secrets replaced by surrogates, with DataFrame functions alone.

A surrogate is drawn from a keyed hash of (kind, canonical form, attempt): the same entity gets
the same surrogate everywhere, written in the format of each mention. Digits stay digits,
letters stay letters of their case, separators stay; card numbers stay valid by their check
digit, addresses stay addresses, names keep gender and script. All distinct entities of the
corpus are checked: where two would get one surrogate, or one the text of a real entity, the
later ones by canonical form take the next attempt until none collides. A name's gender is what
all its titles in the corpus tell. Family names are entities of their own, whether they stand
alone or behind a given name, so "Mrs Smith" and "Dr Anna Smith" share theirs. Only entities
with an attempt above 0, and those whose mentions have different titles, are joined to the
texts; all others need no join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Scratch, stored

#: Titles by gender (fixed values), and names to choose from by gender and script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"], "n": ["Dr", "Prof"]}
GIVEN = {
    "m latin": "Adam Boris Carl David Emil Frank Georg Henry Ivan Jonas Karim Louis Mario Nils Oscar Peter".split(),
    "f latin": "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karen Laura Maria Nora Olga Paula".split(),
    "n latin": "Alex Billie Casey Dana Eden Finley Gael Harper Indigo Jules Kim Lou Morgan Noor Quinn Robin".split(),
    "m cyrillic": "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    "f cyrillic": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    "n cyrillic": "Саша Женя Валя Слава Паша Миша Ваня Коля Тоня Шура Юля Гриша Лёня Костя Митя Толя".split(),
}
FAMILY = {
    "latin": "Albers Baker Castell Dorn Evans Fabre Gruber Hart Ibarra Jensen Keller Lambert Molina Norris Olsen Prior".split(),
    "cyrillic": "Авдеенко Бойко Волошко Гриценко Доценко Ермак Заяц Ильенко Кравец Левченко Мороз Назаренко Орлик Петренко Руденко Сидорук".split(),
}
#: Syllables of the family names that are built when the listed ones don't suffice, and the most of them in a name that the pattern still reads.
SYLLABLES = {"latin": [c + v for c in "bcdfghjklmnprstvwxyz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгджзклмнпрстфхцчшщ" for v in "аеиоу"]}
LISTED_ATTEMPTS, MOST_SYLLABLES = 3, 15
_TITLE = "|".join(t for some in TITLES.values() for t in some)
#: Words (fixed values) that are no family name where they follow a name with a capital.
NO_NAMES = "A After Also And As At Because Before But By For From Had Has He Her His How I If In Is It Its Not Of On Or She So That The Their Then There They This To Was We Were What When Where Which Who Why With You".split()
#: Words (fixed values) that name a secret in front of = or :, and the starts of tokens that need no such word.
SECRET_WORDS = "token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key"
TOKENS = r"gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_\w{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)?"
TOKEN_START = "gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ"
_VALUE = r"[0-9A-Za-z_+/~-]++(?:[.=]++[0-9A-Za-z_+/~-]++)*+=*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds and their patterns, the first that fits at a place wins. None can start inside a run of its own characters, so a scan takes linear time.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9])(?:{TOKENS})"
    rf"|(?<=[=:\"'] ?)(?<=(?:token|password|passwd|secret|api_key|apikey) ?[=:] ?[\"']?)(?=[0-9A-Za-z_+/~.=-]{{6}}){_VALUE}"
    rf"|(?<=[=:\"'] ?)(?<=(?i:{SECRET_WORDS})[A-Za-z0-9_-]{{0,24}}[\"']? ?[=:] ?[\"']?)(?=[0-9A-Za-z_+/~.=-]{{6}})(?=[A-Za-z.=-]{{0,200}}[0-9_+/~]){_VALUE}"
    r"|(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d|\.\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "name": rf"(?=\p{{Lu}})(?<= )(?<=(?<![\p{{L}}])(?:{_TITLE})\.? )(?!(?:{_TITLE})\.? )\p{{Lu}}[\p{{L}}'’-]{{1,40}}(?: (?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]{{1,40}})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: So many attempts in a row that settle no entity mean that a kind has more entities than its format has values.
FRUITLESS_ATTEMPTS = 60


def _hex_at(digest: Column, i: Column) -> Column:
    """The i-th number from 0 to 65535 of a hex digest, the digest being taken as a ring."""
    return F.conv(F.substr(F.concat(digest, digest), F.pmod(i * 4, F.length(digest)) + 1, F.lit(4)), 16, 10).cast("int")


def _choice(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(number, F.lit(len(words))) + 1)


def kind_of(mention: Column) -> Column:
    """The kind of a mention by its own text; what follows ``=`` is a secret, what has no digit a name."""
    fits = [(k, mention.rlike(rf"^(?:{p})$")) for k, p in KINDS.items() if k not in ("secret", "name")]
    secret = mention.rlike(rf"^AKIA[0-9A-Z]{{16}}$|^[0-9a-f]{{32,}}$|^(?:{TOKEN_START})")
    named = mention.rlike(r"^\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?$")
    out = F.when(secret, F.lit("secret"))
    for k, fit in fits:
        out = out.when(fit, F.lit(k))
    return out.when(named, F.lit("name")).otherwise(F.lit("secret"))


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: digits (the last ten of a phone number), or the lower-case text."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(kind == "phone", F.substr(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "name"), F.lower(mention))
        .otherwise(mention)
    )


def _per_letter(mention: Column, digest: Column, last: int | None = None, forward: bool = False) -> Column:
    """Digits and ASCII letters redrawn, all else kept. Counted from the end, so that a prefix moves nothing.

    With ``last``, only that many digits from the end are redrawn. With ``forward`` places are
    counted from the start, which takes linear time in a long mention.
    """

    def redraw(small: Callable[[Column], Column]) -> Column:
        def one(c: Column, i: Column) -> Column:
            after = i if forward else F.length(F.regexp_replace(F.substr(mention, i + 2, F.length(mention)), "[^0-9A-Za-z]", ""))
            n = _hex_at(digest, after)
            digit = F.pmod(n, F.lit(10)).cast("string")
            return (
                F.when(c.rlike("[0-9]"), digit if last is None else F.when(after < last, digit).otherwise(c))
                .when(c.rlike("[a-z]"), small(n))
                .when(c.rlike("[A-Z]"), F.char(F.lit(65) + F.pmod(n, F.lit(26))))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(mention, ""), one), "")

    hexadecimal = redraw(lambda n: F.substr(F.lit("abcdef"), F.pmod(n, F.lit(6)) + 1, F.lit(1)))
    return F.when(mention.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(redraw(lambda n: F.char(F.lit(97) + F.pmod(n, F.lit(26)))))


def _valid_card(number: Column) -> Column:
    """The last digit replaced by the check digit of those before it."""
    digits = F.reverse(F.regexp_replace(number, r"\D", ""))
    sums = F.aggregate(
        F.transform(F.split(F.substr(digits, F.lit(2), F.length(digits)), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.pmod(-sums, F.lit(10)).cast("string"))


def _family_of(name: Column) -> Column:
    """The last word of a name."""
    return F.substring_index(name, " ", -1)


def surrogates(key: str, mentions: Column) -> Column:
    """For an array of (mention, attempt, title, family): an array of (mention, kind, canonical, surrogate).

    Each step is a transform of the one before, so that nothing is worked out twice. ``title``
    (m, f or n) chooses given names of that gender, and ``family`` is the attempt of the family
    name behind a given one.
    """

    def then(array: Column, **more) -> Column:
        return F.transform(array, lambda x: F.struct(*[x[c].alias(c) for c in fields], *[f(x).alias(c) for c, f in more.items()]))

    fields = ["mention", "attempt", "title", "family"]
    array = then(mentions, kind=lambda x: kind_of(x["mention"]))
    fields.append("kind")
    array = then(array, canonical=lambda x: canonical(x["kind"], x["mention"]))
    fields.append("canonical")
    of = lambda kind, form, attempt, part: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"), F.lit(part)), 256)
    own = lambda x, part: of(x["kind"], x["canonical"], x["attempt"], part)
    given = lambda x: (x["kind"] == "name") & (F.instr(x["mention"], " ") > 0)
    array = then(array, digest=lambda x: F.concat(own(x, "1"), own(x, "2")), behind=lambda x: F.when(given(x), of(x["kind"], _family_of(x["canonical"]), x["family"], "1")))
    fields += ["digest", "behind"]
    return F.transform(array, lambda x: F.struct(*[x[c].alias(c) for c in ("mention", "kind", "canonical")], _surrogate(x).alias("surrogate")))


def _syllables(attempt: Column, script: Column, digest: Column) -> Column:
    """What a name has beside a listed one after ``LISTED_ATTEMPTS``: a hundred times as many forms with each attempt."""
    places = F.sequence(F.lit(2), 1 + F.least(F.greatest(attempt, F.lit(LISTED_ATTEMPTS)), F.lit(MOST_SYLLABLES)))
    built = lambda k: F.initcap(F.array_join(F.transform(places, lambda i: _choice(SYLLABLES[k], _hex_at(digest, i))), ""))
    return F.when(attempt >= LISTED_ATTEMPTS, F.concat(F.lit("-"), F.when(script == "cyrillic", built("cyrillic")).otherwise(built("latin")))).otherwise(F.lit(""))


def _surrogate(x: Column) -> Column:
    kind, mention, attempt, title, digest = (x[c] for c in ("kind", "mention", "attempt", "title", "digest"))
    at = F.instr(mention, "@")
    email = F.concat(_per_letter(F.regexp_replace(F.substr(mention, F.lit(1), at - 1), r"[^\x00-\x7f]", "x"), digest), F.lit("@"), F.right(digest, F.lit(6)), F.lit(".example.org"))
    ip = F.concat_ws(".", *[(F.pmod(_hex_at(digest, F.lit(i)), F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4)])
    card = _valid_card(F.concat(F.substr(mention, F.lit(1), F.lit(1)), _per_letter(F.substr(mention, F.lit(2), F.length(mention)), digest)))
    iban = F.concat(F.substr(mention, F.lit(1), F.lit(2)), _per_letter(F.substr(mention, F.lit(3), F.length(mention)), digest))
    aws = F.concat(F.lit("AKIA"), _per_letter(F.substr(mention, F.lit(5), F.length(mention)), digest))

    def behind(start: str, redraw: Callable[[Column], Column]) -> Column:
        """What a pattern finds at the start is kept, the rest is redrawn."""
        head = F.regexp_extract(mention, start, 0)
        return F.concat(head, redraw(F.substr(mention, F.length(head) + 1, F.length(mention))))

    token = behind(rf"^(?:{TOKEN_START})", lambda rest: _per_letter(rest, digest, forward=True))
    phone = behind(r"^\+(?:\d{1,3}(?=[ .(-])|\d{2})", lambda rest: _per_letter(rest, digest, 10))
    script_of = lambda name: F.when(name.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))

    def family(name: Column, drawn: Column, times: Column) -> Column:
        script, n = script_of(name), _hex_at(drawn, F.lit(1))
        listed = F.when(script == "cyrillic", _choice(FAMILY["cyrillic"], n)).otherwise(_choice(FAMILY["latin"], n))
        return F.concat(listed, _syllables(times, script, drawn))

    script = script_of(F.substring_index(mention, " ", 1))
    listed = reduce(lambda out, k: out.when(F.concat_ws(" ", title, script) == k, _choice(GIVEN[k], _hex_at(digest, F.lit(0)))), GIVEN, F.when(F.lit(False), F.lit("")))
    full = F.concat_ws(" ", F.concat(listed, _syllables(attempt, script, digest)), family(_family_of(mention), x["behind"], x["family"]))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
        .when((kind == "name") & (F.instr(mention, " ") > 0), full)
        .when(kind == "name", family(mention, F.substr(digest, F.lit(1), F.lit(64)), attempt))
        .when(mention.rlike("^AKIA[0-9A-Z]{16}$"), aws)
        .when((kind == "secret") & mention.rlike(rf"^(?:{TOKEN_START})"), token)
        .when(kind == "secret", _per_letter(mention, digest, forward=True))
        .otherwise(_per_letter(mention, digest))
    )


def _title_of(before: Column) -> Column:
    """The gender that the title at the end of a text tells, further titles behind it or not."""
    further = rf"(?:(?:{'|'.join(TITLES['n'])})\.? )*"
    ends = {g: F.regexp_like(before, F.lit(rf"(?:{'|'.join(t)})\.? {further}$")) for g, t in TITLES.items() if g != "n"}
    return F.when(ends["m"], F.lit("m")).when(ends["f"], F.lit("f")).otherwise(F.lit("n"))


def hinted(text: Column) -> Column:
    """False for most texts without an entity, and never for one with: a cheap test before the patterns."""
    return reduce(lambda out, t: out | F.contains(text, F.lit(t + " ")) | F.contains(text, F.lit(t + ". ")), sorted(t for some in TITLES.values() for t in some), text.rlike(rf"[0-9@=:]|AKIA|{TOKEN_START}|[a-f]{{32}}"))


def found(text: Column) -> Column:
    """All mentions of a text, in order."""
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities of a corpus: kind, canonical form, one mention (the least), title, and whether its mentions' titles differ.

    The title is m or f where only that one is said of the entity anywhere, and n otherwise. The
    family name behind a given name is an entity too.
    """
    texts = docs.select(F.col(text).alias("_text"), found(F.col(text)).alias("_found")).where(F.size("_found") > 0)
    titled = texts.select("_found", F.split("_text", PATTERN, -1).alias("_gaps"))
    titled = titled.select(F.explode(F.transform("_found", lambda m, i: F.struct(m.alias("mention"), _title_of(F.try_element_at("_gaps", i + 1)).alias("title")))).alias("e"))
    mention = titled.groupBy("e.mention", "e.title").agg(F.count(F.lit(1)).alias("n"))
    kinds = mention.withColumn("kind", kind_of(F.col("mention")))
    own, behind = F.struct("mention", "title"), F.struct(_family_of(F.col("mention")).alias("mention"), F.lit("n").alias("title"))
    both = F.explode(F.when((F.col("kind") == "name") & (F.instr("mention", " ") > 0), F.array(own, behind)).otherwise(F.array(own)))
    kinds = kinds.select("kind", both.alias("e")).select("kind", "e.*").withColumn("canonical", canonical(F.col("kind"), F.col("mention")))
    said = lambda g: F.bool_or(F.col("title") == g)
    own = F.when(said("m") & ~said("f"), F.lit("m")).when(said("f") & ~said("m"), F.lit("f")).otherwise(F.lit("n"))
    return kinds.groupBy("kind", "canonical").agg(F.min("mention").alias("mention"), own.alias("title"), (F.min("title") != F.max("title")).alias("mixed"))


MOVED = "kind string, canonical string, attempt int, title string, family int"


def _settled(scratch: Scratch, open_: DataFrame, taken: DataFrame, key: str) -> tuple[list[DataFrame], DataFrame]:
    """The entities ``open_`` (with family) with attempts so that no two surrogates are equal and none is ``taken`` (kind, drawn); and all that is taken then.

    Raises where a kind has more entities than its format has values.
    """
    open_, settled, attempt, fruitless, before = open_.withColumn("attempt", F.lit(0)), [], 0, 0, -1
    while True:
        one = surrogates(key, F.array(F.struct("mention", "attempt", "title", "family")))
        tried = open_.withColumn("drawn", canonical(F.col("kind"), one[0]["surrogate"]))
        tried = scratch.keep(tried, "pii-tried")
        first = tried.groupBy("kind", "drawn").agg(F.min("canonical").alias("canonical"))
        free = first.join(taken, ["kind", "drawn"], "left_anti").select("kind", "canonical", F.lit(True).alias("fits"))
        tried = scratch.keep(tried.join(free, ["kind", "canonical"], "left"), "pii-attempt")
        settled.append(tried.where("fits"))
        taken = taken.unionByName(settled[-1].select("kind", "drawn"))
        open_ = tried.where("fits is null").drop("fits", "drawn").withColumn("attempt", F.col("attempt") + 1)
        left = open_.count()
        if not left:
            return settled, taken
        fruitless = fruitless + 1 if left == before else 0
        if fruitless >= FRUITLESS_ATTEMPTS:
            raise ValueError("more entities of a kind than its format has values")
        attempt, before = attempt + 1, left


def collisions(known: DataFrame, key: str) -> DataFrame:
    """Entities (from `entities`, stored) that need an attempt above 0 or are told titles that differ: kind, canonical, attempt, title, family.

    Of entities with one surrogate the first by canonical form keeps it; one whose surrogate is
    the text of a real entity never does. Family names are settled first, then the names that
    have one behind a given name, which keep it in every attempt.
    """
    scratch = Scratch(known.sparkSession)
    full = (F.col("kind") == "name") & (F.instr("mention", " ") > 0)
    alone, taken = _settled(scratch, known.where(~full).withColumn("family", F.lit(0)), known.select("kind", F.col("canonical").alias("drawn")), key)
    families = reduce(DataFrame.unionByName, [f.where("kind = 'name'").select(F.col("canonical").alias("_family"), F.col("attempt").alias("family")) for f in alone])
    names = known.where(full).withColumn("_family", _family_of(F.col("canonical"))).join(families, "_family", "left").drop("_family").withColumn("family", F.coalesce("family", F.lit(0)))
    both, _ = _settled(scratch, scratch.keep(names, "pii-names"), taken, key)
    moved = [f.where("attempt > 0 or mixed or family > 0").select(*(c.split()[0] for c in MOVED.split(", "))) for f in (*alone, *both)]
    out = stored(reduce(DataFrame.unionByName, moved), "pii-moved")
    scratch.drop_all_but()
    return out


def _untitled(drawn: Column) -> Column:
    """(name, surrogate) of the names that a text mentions behind a title, and of their family names, the longer ones first."""
    named = F.filter(drawn, lambda x: x["kind"] == "name")
    both = F.flatten(F.transform(named, lambda x: F.array(F.struct(x["mention"].alias("name"), x["surrogate"].alias("surrogate")), F.struct(_family_of(x["mention"]).alias("name"), _family_of(x["surrogate"]).alias("surrogate")))))
    long = F.filter(F.array_distinct(both), lambda n: F.length(n["name"]) >= 3)
    return F.transform(F.array_sort(F.transform(long, lambda n: F.struct((-F.length(n["name"])).alias("less"), n["name"].alias("name"), n["surrogate"].alias("surrogate")))), lambda n: F.struct(n["name"].alias("name"), n["surrogate"].alias("surrogate")))


def _renamed(gap: Column, names: Column) -> Column:
    """A text between mentions with the names in it replaced where they stand as whole words."""
    word = lambda n: F.concat(F.lit(r"(?<![\p{L}'’-])\Q"), n["name"], F.lit(r"\E(?![\p{L}’-])"))
    return F.aggregate(names, gap, lambda g, n: F.when(F.contains(g, n["name"]), F.regexp_replace(g, word(n), n["surrogate"])).otherwise(g))


def replace(docs: DataFrame, key: str, moved: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and n_entities (long). Null texts stay null.

    A name that a text has behind a title, and its family name, are replaced in the whole text;
    n_entities counts the mentions with a title.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    with_mentions = docs.select(*names, found(F.col(text)).alias("_pii_found"))
    if moved.isEmpty():
        attempts = with_mentions.withColumn("_pii_own", F.lit(None).cast("map<string,struct<attempt:int,title:string,family:int>>"))
    else:  # only the texts that mention a moved entity get a map
        rows = docs.where(hinted(F.col(text))).select(F.sha2(text, 256).alias("_pii_d"), F.explode(F.array_distinct(found(F.col(text)))).alias("mention"))
        rows = rows.withColumn("kind", kind_of(F.col("mention"))).withColumn("canonical", canonical(F.col("kind"), F.col("mention"))).join(moved, ["kind", "canonical"])
        per = rows.select("_pii_d", F.struct("mention", F.struct("attempt", "title", "family").alias("own")).alias("e")).distinct().groupBy("_pii_d").agg(F.map_from_entries(F.collect_list("e")).alias("_pii_own"))
        attempts = with_mentions.withColumn("_pii_d", F.sha2(F.col(text), 256)).join(per, "_pii_d", "left").drop("_pii_d")
    gaps = F.split(F.col(text), PATTERN, -1)

    some = attempts.withColumn("_pii_gaps", F.when(F.size("_pii_found") > 0, gaps))
    # kind of a mention is found again from its own text, so a mention stands for its entity here; an entity that isn't moved has one title
    own = lambda m: F.try_element_at("_pii_own", m)
    mentions = F.transform(
        "_pii_found",
        lambda m, i: F.struct(
            m.alias("mention"),
            F.coalesce(own(m)["attempt"], F.lit(0)).alias("attempt"),
            F.coalesce(own(m)["title"], _title_of(F.try_element_at("_pii_gaps", i + 1))).alias("title"),
            F.coalesce(own(m)["family"], F.lit(0)).alias("family"),
        ),
    )
    some = some.withColumn("_pii_drawn", F.when(F.size("_pii_found") > 0, surrogates(key, mentions)))
    some = some.withColumn("_pii_names", _untitled(F.col("_pii_drawn")))
    bare = lambda gap: F.when(F.size("_pii_names") > 0, _renamed(gap, F.col("_pii_names"))).otherwise(gap)
    parts = F.zip_with("_pii_drawn", F.slice("_pii_gaps", 2, F.size("_pii_gaps")), lambda x, gap: F.concat(x["surrogate"], bare(F.coalesce(gap, F.lit("")))))
    new = F.when(F.size("_pii_found") > 0, F.concat(bare(F.element_at("_pii_gaps", 1)), F.array_join(parts, ""))).otherwise(F.col(text))
    return some.select(*[new.alias(text) if c == text else F.col(c) for c in names], F.coalesce(F.size("_pii_found"), F.lit(0)).cast("long").alias("n_entities"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Detect, check for collisions over the whole corpus, replace.

    Null texts stay null and have no entities; an empty table gives an empty one; repeated rows
    get equal surrogates; other columns stay as they are (n_entities is replaced).
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.keep(entities(docs, text), "pii-entities")
    moved = collisions(known, key)
    scratch.drop(known)
    return replace(docs, key, moved, text)
