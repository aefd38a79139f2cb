r"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

Four patterns find the protected entities. A term that shares documents with an entity, at any
distance, discloses it in so far as its pointwise mutual information with the entity reaches the entity's own information content:
``PMI(e, t) / IC(e)`` is 1 if the term occurs in no document without the entity, and 0 if it
tells nothing. Terms at or above one threshold are removed, those at or above a lower one are
generalised. Everything is made of DataFrame functions.

Spans count code points. Matches come from ``regexp_extract_all`` and the text between them from
``split`` with the same pattern, so a running sum of lengths gives their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_spread, stored

#: Fixed order and patterns. Possessive loops and the look-behind keep them linear in long runs;
#: \G lets a match start where the one before it ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this holds no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
ADDED = ("removed", "generalised")
WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Words of what ``_outside`` leaves: none that a span covers or cuts.
FREE_WORD = r"(?<![\p{L}\p{N}\x00])[\p{L}\p{N}]++(?!\x00)"
#: Code points on each side of an entity in which terms count: no text is as long, so all of it does.
REACH = 1 << 31
#: Different texts that must hold a term and an entity before it can disclose it.
SUPPORT = 3
REMOVE_AT, GENERALISE_AT = 0.9, 0.7


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, value) of all matches, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        last = first + F.length(x["value"])
        return F.struct(last.alias("at"), F.array_append(acc["out"], F.struct(first.alias("start"), last.alias("end"), x["value"].alias("value"))).alias("out"))

    zipped = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check: from the right, every second one doubled, nines cast out."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """Spelling under which an entity is counted."""
    bare = _digits(value) if kind in ("card", "phone") else F.lower(value)
    return F.concat(F.lit(f"{kind}:"), bare)


_SPAN = "array<struct<start:long,rank:int,end:long,entity:string>>"


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end, entity), by start, then kind."""
    return F.sort_array(F.concat(*[_spans_of(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def _spans_of(text: Column, rank: int, kind: str) -> Column:
    may = text.rlike("[0-9]") if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), _entity(kind, m["value"]).alias("entity")))
    return F.when(may, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _outside(text: Column, base: Column) -> Column:
    """The text with NUL for the inside of every span; the ends of spans stay, to show words they cut."""
    text = F.translate(text, "\x00", " ")

    def cut(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] < acc["at"], F.lit("")).otherwise(cut(acc["at"], s["start"] + 1))
        added = F.when(s["end"] <= acc["at"], F.lit("")).otherwise(F.concat(before, F.lit("\x00"), cut(s["end"] - 1, s["end"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["parts"], added).alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(base, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), cut(acc["at"], F.length(text).cast("long"))))


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT) -> tuple[DataFrame, DataFrame]:
    """The texts in which a term and an entity stand together, and the pairs that disclose.

    Texts: ``text_key``, ``copies``, ``pair``. Pairs: ``pair``, ``n_both``, ``n_term``,
    ``n_entity``, ``disclosure``, ``action`` (0 removed, 1 generalised). Counts are over all
    documents; copies of a text count as documents but not as further support.

    As ``n_both`` is at most ``n_entity``, a pair reaches ``generalise_at`` only if ``n_term`` is at
    most ``total * (n_entity / total) ** generalise_at``. Pairs beyond that are not written.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    found = stored(found.groupBy("text", "base").agg(F.count("*").alias("copies")).withColumn("text_key", F.sha2("text", 256)), "protected")
    total = docs.count()

    named = found.select("text_key", "copies", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity"))
    entities = named.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"))
    entities = stored(entities.where((F.col("texts") >= support) & (F.col("n_entity") < total)), "entities")
    held = stored(join_spread(named, entities, "entity", "n_entity", ["n_entity"], F.col("text_key")).where("n_entity is not null").drop("copies"), "held")

    def most(n_entity: Column) -> Column:
        # a little more than the bound, as powers are rounded
        return F.lit(float(total or 1)) * F.pow(n_entity / F.lit(float(total or 1)), F.lit(generalise_at)) * 1.000001

    largest = F.lit(entities.agg(F.max("n_entity")).first()[0] or 0)
    # vocabulary counts of the whole corpus, partly summed before they are exchanged
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), NOT_WORD))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    words = stored(words.where((F.col("n_term") >= support) & (F.col("n_term") <= most(largest))), "terms")
    shared = found.join(held.select("text_key").distinct(), "text_key", "left_semi")
    free = F.regexp_extract_all(_outside(F.col("text"), F.col("base")), F.lit(FREE_WORD), F.lit(0))
    shared = shared.select("text_key", "copies", F.explode(F.array_distinct(F.transform(free, F.lower))).alias("term"))
    shared = join_spread(shared, words, "term", "n_term", ["n_term"], F.col("text_key")).where("n_term is not null")
    together = shared.join(held, "text_key").where(F.col("n_term") <= most(F.col("n_entity")))
    together = stored(together.select("text_key", "copies", F.concat("entity", F.lit("\n"), "term").alias("pair"), "n_term", "n_entity"), "together")

    both = together.groupBy("pair").agg(F.sum("copies").alias("n_both"), F.count("*").alias("support"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    information = -F.log(F.col("n_entity") / F.lit(float(total or 1)))
    mutual = F.log(F.col("n_both") * F.lit(float(total or 1)) / (F.col("n_term") * F.col("n_entity")))
    judged = both.where(F.col("support") >= support).withColumn("disclosure", mutual / information).where(F.col("disclosure") >= generalise_at)
    judged = judged.select("pair", "n_both", "n_term", "n_entity", "disclosure", F.when(F.col("disclosure") >= remove_at, 0).otherwise(1).alias("action"))
    return together.select("text_key", "copies", "pair"), judged


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Array of (start, rank, end) of every whole word of ``terms`` that no base span touches."""
    known = F.transform(terms, lambda t: t["term"])
    removed = F.transform(F.filter(terms, lambda t: t["action"] == 0), lambda t: t["term"])
    # only the spellings that occur are searched, so that as many matches are built as there are spans
    spellings = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.array_contains(known, F.lower(w)))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(spellings, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    free = F.filter(matches(text, pattern), lambda w: ~F.exists(base, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))

    def span(w: Column) -> Column:
        action = F.when(F.array_contains(removed, F.lower(w["value"])), 0).otherwise(1)
        return F.struct(w["start"].alias("start"), (F.lit(len(KINDS)) + action).cast("int").alias("rank"), w["end"].alias("end"))

    return F.transform(free, span)


def find_personal_data(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """``row`` (a struct of all input columns), ``text``, ``base`` and ``spans`` for every row.

    ``base`` and ``spans`` are arrays of (start, rank, end), sorted; ranks 0 to 3 are the kinds of
    ``KINDS``, 4 and 5 the terms to remove and to generalise. A base match counts if it passes its
    kind's check; kinds may overlap one another. Added spans are all words of a text that disclose
    an entity in it, never inside a base span. Null texts count as empty, which have no spans. Rows may repeat
    and ids are not looked at; copies get the same spans. An empty table gives an empty result.
    Input columns may have any names, as they travel inside ``row``.
    """
    together, pairs = disclosing_terms(docs, text_col, support, remove_at, generalise_at)
    pairs = stored(pairs.select("pair", "action", "n_both"), "disclosing")
    marked = join_spread(together, pairs, "pair", "n_both", ["action"], F.col("text_key")).where(F.col("action").isNotNull())
    marked = marked.groupBy("text_key", F.split("pair", "\n")[1].alias("term")).agg(F.min("action").alias("action"), F.max("copies").alias("copies"))
    terms = stored(marked.groupBy("text_key").agg(F.collect_list(F.struct("term", "action")).alias("terms"), F.max("copies").alias("copies")), "text-terms")

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = join_spread(rows.withColumn("text_key", F.sha2("text", 256)), terms, "text_key", "copies", ["terms"], F.xxhash64("row"))
    base = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    rows = rows.withColumn("base", base)
    extra = F.when(F.col("terms").isNotNull(), _term_spans(F.col("text"), F.col("terms"), F.col("base")))
    both = F.sort_array(F.concat("base", F.coalesce(extra, F.array().cast("array<struct<start:long,rank:int,end:long>>"))))
    return rows.select("row", "text", "base", both.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(found: DataFrame) -> DataFrame:
    """``row`` and ``clean_text``: base spans become their kind in brackets, disclosing terms are
    removed, less telling ones become [number], [name] or [word]. Of overlapping spans the one
    that starts first is replaced, and the rest of a later one with it."""

    def name(s: Column, value: Column) -> Column:
        shape = F.when(value.rlike("^[0-9]+$"), "[number]").when(value.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
        kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS], F.lit(""))
        return F.when(s["rank"] == len(KINDS) + 1, shape).otherwise(F.element_at(kinds, F.least(s["rank"], F.lit(len(KINDS))) + 1))

    text = F.col("text")

    def cut(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        added = F.when(inside, F.lit("")).otherwise(F.concat(cut(acc["at"], s["start"]), name(s, cut(s["start"], s["end"]))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["parts"], added).alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), cut(acc["at"], F.length(text).cast("long"))))
    return found.select("row", F.when(F.size("spans") > 0, clean).otherwise(text).alias("clean_text"))
