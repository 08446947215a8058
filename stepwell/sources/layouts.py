"""Question rows in any of their usual JSON layouts, read as variants and made into one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import by_key, let, none_of
from .tables import cut

#: The names under which a field may stand, in their order.
IDS = ("qid", "_id", "id")
TITLES, ITEM_TITLES = ("title", "titles"), ("title", "doc_title", "name")
SENTENCES, ITEM_SENTENCES = ("sentences", "context"), ("sentences", "paragraph_text", "text")
SENT_IDS, ITEM_SENT_IDS = ("sent_id", "sent_ids", "sentence_id"), ("sent_id", "sentence_id", "sent_idx")
FACTS = ("supporting_facts", "supporting_facts_by_hop", "supporting_facts_list", "evidence", "evidences")
BLOCK, FACT = "struct<title:string,sentences:array<string>>", "struct<title:string,sent_id:int>"


def _fields(kinds: dict[tuple[str, ...], str]) -> str:
    """The type of an object with the named fields, those of a tuple being of one kind."""
    return f"struct<{','.join(f'`{n}`:{kind}' for names, kind in kinds.items() for n in names)}>"


def _read(value: Column, kind: str) -> Column:
    """A whole value of a kind, its fields and items read at once; null what is of another kind."""
    return F.try_variant_get(value, "$", kind)


def _first(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields that is there and of its kind."""
    return F.coalesce(*(record[n] for n in names))


def _sentences(listed: Column, text: Column) -> Column:
    """A list of texts as it is, else a text cut into sentences; blank ones dropped."""
    return F.coalesce(F.filter(listed, lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""), T.sentences(F.coalesce(text, F.lit(""))))


def context_of(value: Column) -> Column:
    """Blocks (title, sentences) of a context: columns under an object, or a list of objects and of (title, sentences) pairs.

    A block of a list without title or sentences is dropped, and so is an item of another form;
    columns of different lengths, and any other form, give null.
    """

    def columnar(record: Column) -> Column:
        titles, lists = _first(record, TITLES), _first(record, SENTENCES)
        # texts that are no lists are asked for only where there are any
        texts = lambda: _first(_read(value, _fields({SENTENCES: "array<string>"})), SENTENCES)
        cut = F.when(F.forall(lists, lambda s: s.isNotNull()), F.transform(lists, lambda s: _sentences(s, F.lit("")))).otherwise(F.zip_with(lists, texts(), _sentences))
        return F.when(F.size(titles) == F.size(lists), F.zip_with(titles, cut, lambda t, s: F.struct(t.alias("title"), s.alias("sentences"))))

    def block(item: Column, pair: Column) -> Column:
        title = F.when(pair.isNotNull(), _read(F.get(pair, F.lit(0)), "string")).otherwise(_first(item, ITEM_TITLES))
        text = F.when(pair.isNotNull(), F.get(pair, F.lit(1))).otherwise(_first(item, ITEM_SENTENCES))
        return F.struct(title.alias("title"), let(text, lambda x: _sentences(_read(x, "array<string>"), _read(x, "string"))).alias("sentences"))

    columns = let(_read(value, _fields({TITLES: "array<string>", SENTENCES: "array<array<string>>"})), columnar)
    items = _read(value, f"array<{_fields({ITEM_TITLES: 'string', ITEM_SENTENCES: 'variant'})}>")
    kept = F.filter(F.zip_with(items, _read(value, "array<array<variant>>"), block), lambda b: (F.coalesce(b["title"], F.lit("")) != "") & (F.size(b["sentences"]) > 0))
    return F.coalesce(columns, kept).cast(f"array<{BLOCK}>")


def facts_of(value: Column) -> Column:
    """Distinct facts (title, sent_id) in order: columns under an object, or a list of objects and of (title, number) pairs.

    Items whose second part is no number, and items of another form, are skipped; an object
    without a number has 0.
    """

    def columnar(record: Column) -> Column:
        titles, numbers = _first(record, TITLES), _first(record, SENT_IDS)
        return F.when(F.size(titles) == F.size(numbers), F.zip_with(titles, numbers, lambda t, n: F.struct(t.alias("title"), n.alias("sent_id"))))

    def fact(item: Column, pair: Column) -> Column:
        second = let(F.get(pair, F.lit(1)), lambda x: F.when(F.coalesce(x.rlike(r"^\d+$"), F.lit(False)), x.cast("int")))
        number = F.when(pair.isNotNull(), second).otherwise(F.coalesce(_first(item, ITEM_SENT_IDS), F.lit(0)))
        return F.struct(F.when(pair.isNotNull(), F.get(pair, F.lit(0))).otherwise(_first(item, ITEM_TITLES)).alias("title"), number.alias("sent_id"))

    columns = let(_read(value, _fields({TITLES: "array<string>", SENT_IDS: "array<int>"})), columnar)
    items = _read(value, f"array<{_fields({ITEM_TITLES: 'string', ITEM_SENT_IDS: 'int'})}>")
    some = F.coalesce(columns, F.zip_with(items, _read(value, "array<array<string>>"), fact)).cast(f"array<{FACT}>")
    return F.array_distinct(F.filter(some, lambda f: (F.coalesce(f["title"], F.lit("")) != "") & f["sent_id"].isNotNull()))


def projected(rows: DataFrame, column: str = "value") -> DataFrame:
    """(qid, question, answer, type, level, facts, context, problem) of JSON texts, one question each.

    ``problem`` names the first rule that a row breaks and is null for a usable one; a text that
    is no JSON is a row without anything. Other columns aren't kept.
    """
    # columns of their own, so that a text is parsed and its fields are read once and not for each field
    names = ["question", "answer", "type", "level"]
    parsed = rows.select(_read(F.try_parse_json(column), _fields({(*IDS, *names): "string", (*FACTS, "context"): "variant"})).alias("_r"))
    field = lambda *among: F.trim(F.coalesce(_first(F.col("_r"), among), F.lit("")))
    told = parsed.select(field(*IDS).alias("qid"), *(field(c).alias(c) for c in names), _first(F.col("_r"), FACTS).alias("_facts"), F.col("_r")["context"].alias("_context"))
    out = told.select("qid", *names, F.coalesce(facts_of(F.col("_facts")), none_of(FACT)).alias("facts"), F.coalesce(context_of(F.col("_context")), none_of(BLOCK)).alias("context"))
    # blank sentences are dropped already
    known = lambda f: F.exists("context", lambda b: (b["title"] == f["title"]) & (f["sent_id"] >= 0) & (f["sent_id"] < F.size(b["sentences"])))
    titles = F.col("context.title")
    n_units = F.when(F.size(F.array_distinct(titles)) == F.size(titles), F.size(F.flatten("context.sentences"))).otherwise(F.size(_unit_ids()))
    rules = [
        ((F.col("qid") == "") | (F.col("question") == "") | (F.col("answer") == ""), "missing_qid_question_or_answer"), (F.size("facts") == 0, "no_supporting_facts"),
        (F.exists("facts", lambda f: ~known(f)), "support_sentence_missing"), (n_units <= F.size("facts"), "no_distractor_sentences"),
    ]
    return out.withColumn("problem", F.coalesce(*(F.when(c, F.lit(n)) for c, n in rules)))


def _numbered() -> Column:
    """(unit_id, doc_id, sent_id, text) of all sentences of the context."""
    of = lambda b: F.transform(b["sentences"], lambda s, i: F.struct(F.concat_ws("::", "qid", b["title"], i.cast("string")).alias("unit_id"), b["title"].alias("doc_id"), i.alias("sent_id"), F.trim(s).alias("text")))
    return F.flatten(F.transform("context", of))


def _unit_ids() -> Column:
    """The distinct ids of the same sentences."""
    of = lambda b: let(F.concat_ws("::", "qid", b["title"], F.lit("")), lambda head: F.transform(b["sentences"], lambda s, i: F.concat(head, i.cast("string"))))
    return F.array_distinct(F.flatten(F.transform("context", of)))


def sentence_evaluation_set(rows: DataFrame, most: int = 0, seed: int = 0) -> dict[str, DataFrame]:
    """queries, raw_units, targets and samples of usable rows as by `projected`, in the schema of `adapters.evaluation_set`.

    A unit is a sentence, ``qid::title::number`` (the last text where a title repeats). A step's
    candidates are the units that no earlier step has as gold, ``most`` at most with the gold one
    among them (all, if 0), in an order by digests of seed, step and id.
    """
    good = cut(rows).where("problem is null")  # four tables are made of it; a filter below the cut would parse a text for each field it looks at
    gold = F.transform("facts", lambda f: F.concat_ws("::", F.col("qid"), f["title"], f["sent_id"].cast("string")))
    good = good.withColumn("_u", _numbered()).withColumn("_all", _unit_ids()).withColumn("_gold", gold)
    text = lambda i: F.element_at(F.filter("_u", lambda u: u["unit_id"] == i), -1)
    units = good.select("qid", F.explode(F.transform("_all", text)).alias("u")).select("qid", "u.*")
    steps = good.select("qid", F.posexplode("_gold").alias("t", "positive"), "_gold", "_all")
    before = F.slice("_gold", F.lit(1), F.col("t"))
    head = lambda n: F.concat_ws("::", (F.lit(seed) + F.col("t") + n).cast("string"), "qid", F.lit(""))
    ordered = lambda us, n: let(head(n), lambda h: by_key(us, lambda u: F.sha2(F.concat(h, u), 256)))
    others = F.array_remove(F.array_except("_all", before), F.col("positive"))
    few = ordered(F.array_prepend(F.slice(ordered(F.col("_others"), 0), 1, max(most - 1, 0)), F.col("positive")), 1)
    every = ordered(F.array_prepend("_others", F.col("positive")), 0)
    chosen = every if most <= 0 else F.when(F.size("_others") < most, every).otherwise(few)
    samples = steps.withColumn("_others", others).select("qid", "t", "positive", before.alias("context"), chosen.alias("candidates"))
    return {"queries": good.select("qid", "question", "answer", none_of("string").alias("aliases")), "raw_units": units, "targets": steps.select("qid", "t", F.col("positive").alias("unit_id")), "samples": samples}
