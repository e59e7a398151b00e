"""Benchmark items in documents, also with other numbers, names or units. DataFrame code only.

Words are canonicalised to a template: numbers, capitalised words inside a sentence and units become
typed placeholders; the words they replace are kept as slots. Windows of eight template words of
all documents are hash-joined with those of the benchmark. (In a window with more placeholders than
words the words themselves count, so tables of numbers don't match each other.) The windows that a
document and an item share on one alignment must be slot-consistent: an item's value is replaced
by one and the same value throughout. A re-parameterised question passes that, a chance
template match doesn't. A document is contaminated by an item if consistent windows
make up half of the item's windows or cover 13 words.

The first word of an item is taken in every form it can have in a document ("Question: What is ..." makes a name
of "What", "... . What is" doesn't), and has to be the same word. (`every_form=False` leaves that out.)

Defined cases: null and empty texts match nothing; items shorter than a window match as a whole,
items under five words as exact word sequences; a single word is no evidence, so items of one word are not
searched; repeated benchmark rows with one id count once. Windows are counted by id and text, so rows that share
an id, or have none, are judged each by its own text, and repeated rows give equal results. Only ids and texts
are read, by `matches`, and `keep` returns all columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

#: Words of a window, of the shortest items that are searched, of those that may differ in their slots; words that must be covered.
WINDOW, LEAST_WORDS, LEAST_TEMPLATE, COVERED = 8, 2, 5, 13
#: Benchmark windows up to this number are broadcast (about 20 MB), others are shuffled.
BROADCAST_ROWS = 200_000
# Words that stand for units and for numbers.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram",
    "grams", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "kilometre", "kilometres", "mph", "kmh", "watt", "watts", "volt", "volts",
)
NUMBER_WORDS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty",
    "forty", "fifty", "sixty", "hundred", "thousand", "million",
)


#: Placeholders begin with a bracket that no punctuation rule touches.
NAME, NUM, UNIT = "⟨name⟩", "⟨num⟩", "⟨unit⟩"
_SPACES, _BLANK = "[\\x20\\t-\\r]+", " \t\n\x0b\x0c\r"
EDGES = ".,;:!?\"'()[]{}<>*_`$€£-–—"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is worked out once for each row, however often it is used or filtered on.

    Projections are merged and filters pushed through them, which repeats their expressions; rows that a
    generator makes are left alone.
    """
    return df.select(*[F.col(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def templates(df: DataFrame, id_col: str, text_col: str, name: str, forms: bool = False) -> DataFrame:
    """name, raw (lower-case words without punctuation at their ends), word (template words), by row.

    With `forms` also those placeholders that the first word may become behind other words.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias(name), text.alias("text")).where(F.col("text").isNotNull())
    rows = _once(rows, "words", F.split(F.btrim("text", F.lit(_BLANK)), _SPACES)).drop("text")
    rows = _once(rows, "raw", F.transform("words", lambda w: F.btrim(F.lower(w), F.lit(EDGES))))
    number = lambda w: ((w >= "0") & (w < ":")) | w.isin(*NUMBER_WORDS)

    def capital(word):
        # all capitals are no name
        first, rest = F.substring(word, 1, 1), F.substr(word, F.lit(2))
        return (first != F.lower(first)) & (rest == F.lower(rest))

    def placed(raw, i):
        word, before = F.get(F.col("words"), i), F.get(F.col("words"), i - 1)
        # nor is a capital behind the end of a sentence
        named = capital(word) & ~F.substring(before, -1, 1).isin(".", "!", "?")
        return (
            F.when(number(raw), F.lit(NUM)).when(raw.isin(*UNITS) & number(F.get(F.col("raw"), i - 1)), F.lit(UNIT))
            .when(named, F.lit(NAME)).otherwise(raw)
        )

    rows = _once(rows, "word", F.transform("raw", placed))
    if not forms:
        return rows.select(name, "raw", "word")
    word, raw = F.get("words", F.lit(0)), F.get("raw", F.lit(0))
    other = F.array(F.when(capital(word), F.lit(NAME)), F.when(raw.isin(*UNITS), F.lit(UNIT)))
    return rows.select(name, "raw", "word", F.filter(other, lambda x: x.isNotNull() & ~number(raw)).alias("forms"))


def with_grams(df: DataFrame, length: int) -> DataFrame:
    """`df`, whose column `word` has at least `length` words, with the hash of each window of so many as array `grams`.

    Windows of 2, 4, 8 ... words are hashed from the two halves, so a window costs a few steps and no copies.
    """

    def joined(df, apart, to):
        pairs = F.zip_with("grams", F.slice("grams", apart + 1, F.size("grams")), lambda a, b: F.xxhash64(a, b))
        # at the end there are no second halves
        return _once(df, "grams", F.slice(pairs, 1, F.greatest(F.size("word") - to + 1, F.lit(0))))

    df, size = _once(df, "grams", F.transform("word", lambda w: F.xxhash64(w))), 1
    while size * 2 <= length:
        df, size = joined(df, size, size * 2), size * 2
    return joined(df, length - size, length) if size < length else df


def windows(rows: DataFrame, name: str, length: int) -> DataFrame:
    """name, h, at, slots, strict: windows of `length` words.

    slots: the bare words under placeholders, "" elsewhere; null without placeholders. strict: the hash
    of all bare words, where there are more placeholders than words.
    """

    def window(h, i):
        words, raw = F.slice(F.col("word"), i + 1, length), F.slice(F.col("raw"), i + 1, length)
        filled = F.zip_with(words, raw, lambda t, w: F.when(t.startswith(NAME[0]), w).otherwise(F.lit("")))
        return F.struct(h.alias("h"), i.alias("at"), filled.alias("slots"), F.xxhash64(raw).alias("strict"))

    rows = with_grams(rows.where(F.size("word") >= length), length)
    rows = rows.select(name, F.explode(F.transform("grams", window)).alias("w")).select(name, "w.*")
    free = F.size(F.filter("slots", lambda x: x != ""))
    exact = (free * 2 > length) | F.lit(length < LEAST_TEMPLATE)
    return rows.select(
        name, "h", "at", F.when(free > 0, F.col("slots")).alias("slots"), F.when(exact, F.col("strict")).alias("strict")
    )


def _item_windows(items: DataFrame, length: int) -> DataFrame:
    """The benchmark's windows. What the first word of an item becomes in a document depends on the word before it
    there, so the first window comes in each form; `item_first` is the bare word that the document has to have then."""
    begin = items.select(
        "item_id", F.slice("raw", 1, length).alias("raw"), F.slice("word", 2, length - 1).alias("rest"), F.explode("forms").alias("form")
    )
    begin = begin.select("item_id", "raw", F.concat(F.array("form"), "rest").alias("word"))
    first = begin.select(F.col("item_id").alias("__item"), F.get("raw", F.lit(0)).alias("item_first")).distinct()
    moved = windows(begin, "item_id", length).join(first, F.expr("item_id <=> __item")).drop("__item")
    return windows(items, "item_id", length).withColumn("item_first", F.lit(None).cast("string")).unionByName(moved)


def _candidates(docs: DataFrame, grams: dict[int, DataFrame], id_col: str, text_col: str) -> DataFrame:
    """`name` of the documents that share a template window with the benchmark, in one pass over all windows."""
    words = templates(docs, id_col, text_col, "doc_id").select("doc_id", "word")
    found = None
    for n, gram in grams.items():
        own = with_grams(words.where(F.size("word") >= n), n).select("doc_id", F.explode("grams").alias("h"))
        hit = own.join(gram.select("h").distinct() if not _small(gram) else F.broadcast(gram.select("h").distinct()), "h", "left_semi")
        found = hit.select("doc_id") if found is None else found.unionByName(hit.select("doc_id"))
    return found.distinct()


def _small(grams: DataFrame) -> bool:
    return grams.count() <= BROADCAST_ROWS


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", every_form: bool = True) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, n_replaced (slots with another value), contaminated.

    One row for each id, text and item.
    """
    return _matches(docs, benchmark, id_col, text_col, item_col, item_text, every_form).drop("text_key")


def _matches(docs, benchmark, id_col, text_col, item_col, item_text, every_form) -> DataFrame:
    """As `matches`, with `text_key`."""
    items = templates(benchmark, item_col, item_text, "item_id", forms=True).dropDuplicates(["item_id"])
    items = common.materialize(items.where(F.size("word") >= LEAST_WORDS), "items")
    length = F.least(F.size("word"), F.lit(WINDOW))
    # at most WINDOW different lengths
    lengths = sorted(r[0] for r in items.select(length).distinct().collect()) or [WINDOW]
    grams = {}
    for n in lengths:
        own = items.where(length == n)
        gram = _item_windows(own, n) if every_form else windows(own, "item_id", n).withColumn("item_first", F.lit(None).cast("string"))
        gram = gram.select(
            "item_id", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("strict").alias("item_strict"), "item_first"
        )
        # with all forms it is long to work out, read three times, and small
        grams[n] = common.materialize(gram, "grams") if every_form else gram
    # only documents with a hit are looked at closely
    keyed = common.id_text(docs, id_col, text_col).withColumn("text_key", common.text_key())
    hits = common.materialize(_candidates(keyed, grams, "text_key", "text"), "hits")
    near = keyed.join(hits.withColumnRenamed("doc_id", "__hit"), F.expr("text_key = __hit"), "left_semi")
    # from here on a row is known by its id and text together; equal rows are one
    near = common.materialize(near.dropDuplicates(["doc_id", "text_key"]).withColumn("row", F.xxhash64("doc_id", "text_key")), "hits")
    texts = common.materialize(templates(near, "row", "text", "doc_id"), "hits")
    pairs = None
    for n, gram in grams.items():
        found = windows(texts, "doc_id", n).join(F.broadcast(gram) if _small(gram) else gram, "h").withColumn("words", F.lit(n))
        pairs = found if pairs is None else pairs.unionByName(found)
    # windows of placeholders for the most part have to be equal word by word
    pairs = pairs.where(F.coalesce(F.col("strict") == F.col("item_strict"), F.lit(True)))
    pairs = pairs.where(F.coalesce(F.get("slots", F.lit(0)) == F.col("item_first"), F.lit(True)))
    pairs = pairs.withColumn("shift", F.col("at") - F.col("item_at"))
    by = ["doc_id", "item_id", "shift"]
    # a place of the item and a value there, with the value that the document has instead
    slot = F.explode_outer(
        F.filter(
            F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("was"), b.alias("now"))),
            lambda s: (s["was"] != "") | (s["now"] != ""),
        )
    )
    slots = pairs.where(F.col("item_slots").isNotNull()).select(*by, slot.alias("s")).where(F.col("s").isNotNull())
    values = slots.groupBy(*by, "s.was").agg(F.min("s.now").alias("lo"), F.max("s.now").alias("hi"))
    judged = values.groupBy(*by).agg(
        F.max(F.col("lo") != F.col("hi")).alias("broken"), F.sum((F.col("lo") != F.col("was")).cast("long")).alias("replaced")
    )
    aligned = pairs.groupBy(*by).agg(F.collect_set("item_at").alias("ats"), F.max("words").alias("words"))
    same = F.expr(" AND ".join(f"{c} <=> __{c}" for c in by))
    right = judged.select(*[F.col(c).alias(f"__{c}") for c in by], "broken", "replaced")
    good = aligned.join(right, same, "left").where(~F.coalesce("broken", F.lit(False)))
    total = items.select(F.col("item_id").alias("__item"), (F.size("word") - length + 1).alias("n_windows"))
    found = good.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n_matched"),
        F.max("words").alias("words"), F.min(F.coalesce("replaced", F.lit(0))).alias("n_replaced"),
    )
    found = found.withColumnRenamed("doc_id", "row").join(near.select("doc_id", "text_key", "row"), "row")
    out = found.join(total, F.expr("item_id <=> __item"))
    covered = F.col("n_matched") + F.col("words") - 1
    return out.select(
        "doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"),
        "n_replaced", ((2 * F.col("n_matched") >= F.col("n_windows")) | (covered >= COVERED)).alias("contaminated"), "text_key",
    )


def keep(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no item contaminates; rows that share an id, or have none, are judged each by its text."""
    bad = _matches(docs, benchmark, id_col, text_col, "item_id", "text", True).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("__bad"), F.col("text_key").alias("__bad_text")).distinct()
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__bad")) & (own == F.col("__bad_text"))
    return docs.join(bad, same, "left_anti")
