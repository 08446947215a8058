"""Text expressions: normalisers, tokens, anchors, question kinds. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First words of yes/no questions.
AUXILIARIES = "is are was were do does did can could should would has have had".split()
#: Words that never anchor a question.
STOPWORDS = (
    "a an and are as at be been between both by did do does for from had has have how in is it its of on or "
    "that the their these this to was were what when where which who whom whose with"
).split()
#: Words that are no anchors.
ANCHOR_STOPWORDS = (
    "a an and are as at be both by did do does for from get have how in is it its many of on or that the their "
    "this to what when where which who whom whose with was were"
).split()
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ordered rules from question to goal; the first that matches wins.
GOALS = [
    ("which magazine was started first", "publication founding time"),
    ("which .* was started first", "founding time comparison"),
    ("when was .* founded", "founding time"),
    ("what year was .* founded", "founding time"),
    ("which university did .* attend", "university attended"),
    ("who acquired .*", "acquirer"),
    ("who wrote .*", "author"),
    ("where was .* born", "birthplace"),
    ("when did .* die", "death time"),
]
DEFAULT_GOAL = "more evidence for the question"
#: Months.
MONTHS = "january february march april may june july august september october november december".split()


def normalize(text: Column) -> Column:
    """Lower case, quotes and sentence punctuation deleted, white space squeezed."""
    squeezed = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(squeezed, r"[\"'“”‘’`.,;:!?()\[\]{}]", ""), r"\s+", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation and the articles deleted, white space squeezed."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def clue_tokens(text: Column) -> Column:
    """Tokens that keep inner hyphens and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*)"), F.lit(1)), F.lower)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+"))


def sentence_count(text: Column) -> Column:
    """0 for an empty text, else the pieces between sentence ends, 1 at least."""
    pieces = F.filter(F.split(text, "[.!?]+"), lambda x: x.rlike(r"\S"))
    return F.when(~text.rlike(r"\S"), 0).otherwise(F.greatest(F.lit(1), F.size(pieces)))


def sentences(text: Column) -> Column:
    """Cut after ., ! or ? that white space follows; trimmed, empty ones dropped."""
    # F.trim itself would be given the place of a sentence as what to trim
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard of two token arrays as sets; ``empty`` where both have none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def title_overlap(a: Column, b: Column) -> Column:
    """Jaccard of lower-case words, ``_`` read as a space; 0 where both are empty."""
    words = [F.filter(F.split(F.lower(F.replace(x, F.lit("_"), F.lit(" "))), r"\s+"), lambda w: w != "") for x in (a, b)]
    return jaccard(*words, empty=0.0)


def capitalized_phrases(text: Column) -> Column:
    """Runs of capitalised words, each once, in order."""
    # possessive, which finds the same, since a greedy run is matched by a call for each word and a long one ends the executor
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9'&().-]++(?:\s++[A-Z][A-Za-z0-9'&().-]++)*+)"), F.lit(1)))


def anchors(text: Column) -> Column:
    """Normalised phrases with their tokens (3 letters on), then the text's tokens (4 on), stop words left out, each once."""
    stop = F.array(*map(F.lit, ANCHOR_STOPWORDS))
    short = lambda arr, n: F.filter(arr, lambda t: (F.length(t) >= n) & ~F.array_contains(stop, t))
    of_phrases = F.flatten(F.transform(capitalized_phrases(text), lambda p: F.concat(F.filter(F.array(normalize(p)), lambda x: x != ""), short(tokens(p), 3))))
    return F.array_distinct(F.concat(of_phrases, short(tokens(text), 4)))


def is_yes_no(question: Column) -> Column:
    return F.lower(F.trim(question)).rlike(f"^({'|'.join(AUXILIARIES)}) ")


def focus_kind(question: Column) -> Column:
    """What an answer must be, by ordered rules."""
    q = F.lower(F.trim(question))
    rules = [
        ("duration", q.rlike(r"\bhow\s+(many\s+)?(hours?|days?|weeks?|months?|years?)\b")),
        ("math_branch", q.rlike(r"\bwhich\s+branch\s+of\s+mathematics\b")),
        *((kind, q.rlike(rf"\b(what|which)\s+{kind}\b")) for kind in ("river", "university", "county", "city", "state")),
        ("year", q.rlike(r"\b(what|which)\s+year\b") | q.startswith("when ") | ((q.contains("originally") | q.contains("first")) & q.rlike(r"\b(performed|written|built|made|released|founded)\b"))),
        ("profession", q.rlike(r"\b(what|which)\s+(profession|job|occupation)\b")),
        ("plant", q.rlike(r"\b(types|kind) of plant\b")),
        ("person", q.startswith("who ")),
    ]
    out = F.when(is_yes_no(question), "yes_no")
    for kind, rule in rules:
        out = out.when(rule, kind)
    return out.otherwise("generic")


def answer_type(question: Column) -> Column:
    """The answer type that the question's first words ask for."""
    q = F.concat(F.array_join(clue_tokens(question), " "), F.lit(" "))
    starts = lambda *words: q.rlike(f"^({'|'.join(words)}) ") & (F.size(clue_tokens(question)) > F.size(F.split(F.lit(words[0]), " ")))
    return (
        F.when(starts("who", "whom", "whose"), "person")
        .when(starts("when"), "date or time")
        .when(starts("where"), "location")
        .when(starts("how many", "how much"), "number")
        .when(starts("what city", "what country", "what location", "what place"), "location")
        .when(starts("what year", "what date", "what time"), "date or time")
        .when(starts("which"), "named choice")
        .otherwise("answer entity or value")
    )


def number_like(text: Column) -> Column:
    return F.lower(text).rlike(rf"\d|{'|'.join(MONTHS)}")


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:[./:-]\d+)*)"), F.lit(1))


def goal(question: Column) -> Column:
    q = F.lower(F.rtrim(F.trim(question), F.lit("?")))
    out = F.when(F.lit(False), "")
    for pattern, name in GOALS:
        out = out.when(q.rlike(pattern), name)
    return out.otherwise(DEFAULT_GOAL)


def shorten(text: Column, n: int) -> Column:
    return F.rtrim(F.left(F.trim(text), F.lit(n)))


def shorten_dots(text: Column, n: int) -> Column:
    """As `shorten`, with ``...`` in place of the last three characters of a longer text."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(n - 3))), F.lit("...")))


def contains_answer(answer: Column, context: Column) -> Column:
    a = normalize(answer)
    return (a != "") & F.contains(normalize(context), a)


def answer_correct(gold: Column, probe: Column) -> Column:
    """Equal after normalising, or equal non-empty lists of numbers."""
    numbers = numeric_tokens(gold)
    return (normalize(gold) == normalize(probe)) | ((F.size(numbers) > 0) & (numbers == numeric_tokens(probe)))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def answer_compatible(gold: Column, probe: Column) -> Column:
    """The gold answer stands in the probe's: as whole words, or anywhere where either has numbers; equal lists of numbers do as well. False for a null or empty side."""
    a, b = normalize(gold), normalize(probe)
    found = F.when(number_like(gold) | number_like(probe), F.contains(b, a)).otherwise(F.contains(_padded(b), _padded(a)))
    return F.coalesce((a != "") & (b != "") & (answer_correct(gold, probe) | found), F.lit(False))


def answer_conflicts(gold: Column, probe: Column) -> Column:
    """Both answers are there and exclude each other: by their numbers if either has any, else by not being compatible."""
    a, b, m, n = normalize(gold), normalize(probe), numeric_tokens(gold), numeric_tokens(probe)
    apart = F.when((F.size(m) > 0) | (F.size(n) > 0), m != n).otherwise(~answer_compatible(gold, probe))
    return F.coalesce((a != "") & (b != "") & (a != b) & apart, F.lit(False))


#: A leading word that a note replaces by its document's name.
PRONOUNS = "she he they it".split()


def single_sentence(text: Column) -> Column:
    """The first sentence, closed by a full stop if it has no end of its own; '' for null or blank."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    first = F.split(bare, r"(?<=[.!?])\s+", 2)[0]
    return F.when(first == "", "").when(first.rlike(r"[.!?]$"), first).otherwise(F.concat(first, F.lit(".")))


def note_text(doc: Column, text: Column) -> Column:
    """A raw sentence as a note: its first sentence, which names the document in place of a leading pronoun."""
    sentence, name = single_sentence(text), F.trim(F.coalesce(doc, F.lit("")))
    led = F.regexp_extract(sentence, rf"(?i)^({'|'.join(PRONOUNS)})\b", 1)
    renamed = F.concat(name, F.substr(sentence, F.length(led) + 1))
    return F.when((led == "") | (name == ""), sentence).otherwise(single_sentence(renamed))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; all zero where the range is below 1e-12."""
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((x - low) / (high - low))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def stable_key(seed: int, id_: Column) -> Column:
    """A reproducible shuffle order: sha256 of ``seed::id``."""
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), id_.cast("string")), 256)


def stable_int(*parts: Column) -> Column:
    """The first eight bytes of a sha256 as decimal(20,0)."""
    return F.conv(F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16)), 16, 10).cast("decimal(20,0)")


def rank_bucket(rank: Column) -> Column:
    out = F.when(rank.isNull(), "missing").when(rank <= 1, "1")
    for n in (2, 3, 5, 10, 20, 30, 50):
        out = out.when(rank <= n, f"<={n}")
    return out.otherwise(">50")


def position_bucket(t: Column, terminal: Column) -> Column:
    return F.when(t == 0, "early").when(t == terminal, "last").otherwise("middle_late")


def role_of(question: Column, answer: Column, text: Column, doc: Column) -> Column:
    """support when the answer is in the text, bridge when the title or two tokens of the question are, else distinguish."""
    return role_by(normalize(question), tokens(question), normalize(answer), normalize(text), tokens(text), normalize(doc))


def role_by(question: Column, words: Column, answer: Column, text: Column, have: Column, doc: Column) -> Column:
    """`role_of` normalised sides and their tokens, for a caller that compares each side often."""
    return (
        F.when((answer != "") & F.contains(text, answer), "support")
        .when(((doc != "") & F.contains(question, doc)) | (overlap(words, have) >= 2), "bridge")
        .otherwise("distinguish")
    )


def strip_note_lines(notebook: Column) -> Column:
    return F.array_join(F.filter(F.split(notebook, "\n"), lambda x: ~F.trim(x).rlike(r"^(\[derived_note\]|Notes:|\[bridge\]|\[verification\])")), "\n")


def novel_tokens(note: Column, source: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_sort(F.filter(F.array_except(F.array_distinct(tokens(note)), tokens(source)), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


#: What a query is asked as beside itself, and with what has been read.
VARIANTS = ("Find evidence that answers: ", "Find the bridge entity and final answer evidence for: ")
KNOWN_EVIDENCE = "\nKnown evidence:\n"


def query_variants(question: Column, context: Column) -> Column:
    """A query as it is, in two templates, and with the context if there is any; each once regardless of case and white space."""
    read = F.trim(F.coalesce(context, F.lit("")))
    some = F.array(question, *(F.concat(F.lit(v), question) for v in VARIANTS), F.when(read != "", F.concat(question, F.lit(KNOWN_EVIDENCE), read)))
    keyed = F.transform(F.array_compact(some), lambda q: F.struct(F.trim(F.regexp_replace(F.lower(q), r"\s+", " ")).alias("k"), q.alias("q")))
    first = F.filter(keyed, lambda x: (x["k"] != "") & (x["q"] == F.filter(keyed, lambda y: y["k"] == x["k"])[0]["q"]))
    return F.array_distinct(F.transform(first, lambda x: x["q"]))


def json_answer(raw: Column) -> Column:
    """The answer field of a reply: of the whole without code fences, else of its first {...}, else the first line."""
    clean = F.trim(F.regexp_replace(raw, r"^\s*```(?:json)?|```\s*$", ""))
    return F.coalesce(F.get_json_object(clean, "$.answer"), F.get_json_object(F.regexp_extract(clean, r"(?s)\{.*?\}", 0), "$.answer"), F.split(clean, "\n")[0])


def json_indices(raw: Column, n: Column) -> Column:
    """Zero-based distinct indices within range from a reply's list of one-based ones."""
    listed = F.coalesce(*[F.from_json(F.get_json_object(raw, f"$.{k}"), "array<int>") for k in ("selected_indices", "ranked_indices", "indices")])
    return F.array_distinct(F.filter(F.transform(listed, lambda i: i - 1), lambda i: (i >= 0) & (i < n)))


def unit_chunk(unit_id: Column) -> Column:
    """What stands before the last ``::`` number; null if there is none."""
    return F.nullif(F.regexp_extract(unit_id, r"^(.*)::(\d+)$", 1), F.lit(""))


def is_note(unit_id: Column) -> Column:
    return F.contains(unit_id, F.lit("::derived::"))


def is_raw(unit_id: Column) -> Column:
    """An id of three parts or more whose last is a number, and no note's."""
    return ~is_note(unit_id) & (F.size(F.split(unit_id, "::")) >= 3) & F.substring_index(unit_id, "::", -1).rlike(r"^\d+$")
