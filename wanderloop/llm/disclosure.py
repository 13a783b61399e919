"""Personal data and the words that give it away, in DataFrame functions only.

Four kinds of personal data are found by pattern, with code-point positions. Each found value is
a protected entity. Whole documents are the contexts; co-occurrence, counted over all of them,
tells how much a word discloses: with N documents, n_e that hold the entity, n_t that hold the
word and n_te that hold both,

    information of e      IC  = ln(N / n_e)
    disclosed by the word PMI = ln(n_te * N / (n_t * n_e))

A word whose PMI reaches ``alpha`` of the IC, seen with the entity in ``min_contexts`` different
texts, is sanitised wherever it stands, also in documents without the entity: removed where it
names the entity for certain (PMI = IC), otherwise generalised. Copies of one text count as one
context, so that a much-copied document discloses nothing by being copied. Words are runs of
characters between white space; those that a found value touches are none.

Null text is an empty text; empty texts and tables give no spans. Texts are read whole, of any
length. Repeated rows are kept, each with the same spans. Extra columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wanderloop.llm.shared import LOWER, SPACE_CLASS, UPPER, WORD_CLASS, settle, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Possessive forms: equal matches, no backtracking and no recursion on long runs. An
# email starts where no local-part character precedes or where the last match ended.
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"
# Stands for each code point of a found value, so that positions stay; a word that holds it is none.
VEIL = "\uffff"
COPIES = 16


@dataclass(frozen=True)
class Disclosure:
    """Thresholds of the sanitiser; up to ``near_keys`` keys of texts go to all tasks, more are joined."""

    min_contexts: int = 3
    alpha: float = 0.9
    near_keys: int = 1_000_000


def located(text: Column, pattern: str) -> Column:
    """All matches as structs of start, stop (code points) and the matched string."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,stop:int,hit:string>>").alias("hits"))
    return F.aggregate(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            (acc["i"] + 1).alias("i"),
            F.concat(
                acc["hits"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"),
                        x["hit"].alias("hit"),
                    )
                ),
            ).alias("hits"),
        ),
        lambda acc: acc["hits"],
    )


def n_digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def passes_luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


# What a match must satisfy, and a cheap test that a text can hold one at all.
CHECKS = {
    "email": (lambda h: F.lit(True), lambda t: t.contains("@")),
    "ip": (
        lambda h: F.forall(F.split(h, r"\."), lambda p: p.cast("double") <= 255),
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ),
    "card": (
        lambda h: n_digits(h).between(12, 19) & passes_luhn(h),
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    ),
    "phone": (lambda h: n_digits(h).between(9, 15), lambda t: t.contains("+")),
}


def personal_spans(text: Column) -> Column:
    """Sorted spans of the four kinds in one text column."""
    def of_kind(rank: int, kind: str) -> Column:
        good, possible = CHECKS[kind]
        spans = F.transform(
            F.filter(located(text, PATTERNS[kind]), lambda m: good(m["hit"])),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["stop"].alias("stop")
            ),
        )
        return F.when(possible(text), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)

    return F.array_sort(F.concat(*[of_kind(rank, kind) for rank, kind in enumerate(KINDS)]))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def entities_of(text: Column, spans: Column) -> Column:
    """Different values found in a text, as kind and lower-cased value."""
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], F.translate(F.substring(text, s["start"] + 1, s["stop"] - s["start"]), UPPER, LOWER)
    )))


def veiled(text: Column, spans: Column) -> Column:
    """The text with every code point of a found value replaced."""
    marks = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), F.repeat(F.lit(VEIL), s["stop"] - s["start"]).alias("label")
    ))
    return F.when(F.size(spans) > 0, masked(text, marks, same_length=True)).otherwise(text)


def clear_words(text: Column) -> Column:
    """Different words of a veiled text, lower-cased, without those that a found value touches."""
    words = F.array_distinct(F.split(F.translate(text, UPPER, LOWER), SPACE_CLASS + "+"))
    return F.filter(words, lambda w: (w != "") & ~w.contains(VEIL))


def found_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: id, key of the text, spans, entities and the veiled text."""
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")).withColumn("spans", personal_spans(F.col("_text")))
    return base.select(
        "doc_id", F.md5(F.col("_text").cast("binary")).alias("text_key"), "spans",
        entities_of(F.col("_text"), F.col("spans")).alias("entities"), veiled(F.col("_text"), F.col("spans")).alias("veiled"),
    )


def disclosing_terms(found: DataFrame, n_docs: int, cfg: Disclosure) -> DataFrame:
    """term and action (remove or generalise) of every word beyond the threshold."""
    words = F.explode(clear_words(F.col("veiled"))).alias("term")
    held = found.filter(F.size("entities") > 0)
    by_text = held.select("text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key").agg(F.count(F.lit(1)).alias("n"))
    # An entity of fewer texts has no word in enough of them: it need not meet any word.
    n_e = by_text.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= cfg.min_contexts)
    met = by_text.join(n_e.select("entity"), "entity")
    together = (
        held.select("text_key", words).distinct().join(met, "text_key")
        .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n_te"))
        .filter(F.col("contexts") >= cfg.min_contexts)
    )
    n_t = found.select(words).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    known = together.join(n_t, "term").join(n_e, "entity")
    information = F.log(F.lit(float(n_docs)) / F.col("n_e"))
    disclosed = information + F.log(F.col("n_te") / F.col("n_t"))
    return known.filter((information > 0) & (disclosed >= cfg.alpha * information)).groupBy("term").agg(
        F.max(F.when(F.col("n_te") == F.col("n_t"), "remove").otherwise("generalise")).alias("action")
    )


def term_spans(found: DataFrame, terms: DataFrame, cfg: Disclosure) -> DataFrame:
    """Per key of a text: the spans of disclosing words, wherever they stand.

    Only texts that hold one are cut into pieces, and only these move while the list of their
    keys is short enough to go to all tasks; places are a running sum over the pieces, so that
    the time grows with the text.
    """
    holders = found.select("text_key", F.explode(clear_words(F.col("veiled"))).alias("term")).join(terms.select("term"), "term").select("text_key").distinct()
    holders = settle(holders, "pii-holders")
    if holders.count() <= cfg.near_keys:
        holders = F.broadcast(holders)
    texts = found.select("text_key", "veiled").join(holders, "text_key").groupBy("text_key").agg(F.first("veiled").alias("veiled"))
    pieces = texts.select("text_key", F.posexplode(F.regexp_extract_all("veiled", F.lit(f"{WORD_CLASS}++|{SPACE_CLASS}++"), F.lit(0))).alias("i", "piece"))
    to_here = Window.partitionBy("text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("stop", F.sum(F.length("piece")).over(to_here).cast("int")).select(
        "text_key", "stop", (F.col("stop") - F.length("piece")).alias("start"), F.translate("piece", UPPER, LOWER).alias("term")
    )
    return placed.join(terms, "term").groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "action"))).alias("terms"))


def with_term_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on the key of the text; copies of one text are spread over ``COPIES`` tasks."""
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(COPIES)).cast("int")
    ).join(salted, ["text_key", "_salt"], "left").drop("_salt")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, the pattern ``spans``, all spans of each document, disclosing words included, and these words' ``terms`` with their actions."""
    found = settle(found_spans(docs, doc_id, text), "pii-spans")
    terms = settle(disclosing_terms(found, found.count(), cfg), "pii-terms")
    placed = settle(term_spans(found, terms, cfg), "pii-places")
    none = F.array().cast("array<struct<start:int,stop:int,action:string>>")
    extra = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(TERM).alias("kind"), t["stop"].alias("stop")))
    joined = with_term_spans(found.select("doc_id", "text_key", "spans"), placed).withColumn("terms", F.coalesce("terms", none))
    return joined.select("doc_id", "spans", F.array_sort(F.concat("spans", extra)).alias("all_spans"), "terms")


def terms_text(terms: Column) -> Column:
    """action:start:end of every disclosing word, joined by commas."""
    return F.array_join(F.transform(terms, lambda t: F.concat_ws(":", t["action"], t["start"], t["stop"])), ",")


def masked(text: Column, marks: Column, same_length: bool = False) -> Column:
    """The text with sorted marks (start, stop, label) put in place; overlaps keep the first label.

    With ``same_length`` a later mark fills what the earlier ones leave of it.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def put(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        rest = F.substring(m["label"], 1, F.greatest(m["stop"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], m["stop"]).alias("at"),
            F.when(~fresh & F.lit(same_length), F.concat(acc["parts"], F.array(rest))).when(fresh, F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), m["label"])))
            .otherwise(acc["parts"]).alias("parts"),
        )

    return F.aggregate(
        marks, start, put,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )


def words_of(text: Column) -> Column:
    """Different whole words of a labelled text, lower-cased, without those that hold a label."""
    words = F.array_distinct(F.split(F.translate(text, UPPER, LOWER), SPACE_CLASS + "+"))
    return F.filter(words, lambda w: (w != "") & ~w.rlike(r"\[(?:" + "|".join(KINDS) + r")\]"))


def terms_by_document(marked: DataFrame, text: str, cfg: Disclosure) -> DataFrame:
    """term and action of every word beyond the threshold, where whole documents are the contexts.

    Copies of one text count as one context. A word that is removed stands in no document without its entity.
    """
    words = F.explode(words_of(text_of(f"_row.{text}"))).alias("term")
    held = marked.filter(F.size("entities") > 0)
    by_text = held.select("text_key", F.explode("entities").alias("entity")).groupBy("entity", "text_key").agg(F.count(F.lit(1)).alias("n"))
    n_e = by_text.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= cfg.min_contexts)
    texts = by_text.join(n_e.select("entity"), "entity")
    together = (
        held.select("text_key", words).distinct().join(texts, "text_key")
        .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n_te"))
        .filter(F.col("contexts") >= cfg.min_contexts)
    )
    n_t = marked.select(words).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    known = together.join(n_t, "term").join(n_e, "entity")
    information = F.log(F.lit(float(marked.count())) / F.col("n_e"))
    disclosed = information + F.log(F.col("n_te") / F.col("n_t"))
    return known.filter((information > 0) & (disclosed >= cfg.alpha * information)).groupBy("term").agg(
        F.max(F.when(F.col("n_te") == F.col("n_t"), "remove").otherwise("generalise")).alias("action")
    )


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: Disclosure = Disclosure()) -> DataFrame:
    """The documents with personal data labelled, and disclosing words generalised or removed.

    Disclosing words are counted over whole documents and sanitised wherever they stand, also
    in documents that do not hold the entity.
    """
    inner = docs.select(
        F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")
    ).withColumn("_spans", personal_spans(F.col("_text")))
    labels = F.transform("_spans", lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")
    ))
    entities = F.array_distinct(F.transform("_spans", lambda s: F.concat_ws(
        ":", s["kind"], F.translate(F.substring(F.col("_text"), s["start"] + 1, s["stop"] - s["start"]), UPPER, LOWER)
    )))
    labelled = F.when(F.size("_spans") > 0, masked(F.col("_text"), labels)).otherwise(F.col("_row")[text])
    marked = settle(inner.select(
        F.col("_row").withField(f"`{text}`", labelled).alias("_row"), "doc_id",
        F.md5(F.col("_text").cast("binary")).alias("text_key"), entities.alias("entities"),
    ), "pii-marked")
    terms = settle(terms_by_document(marked, text, cfg), "pii-terms")
    found = settle(
        marked.select("text_key", F.explode(words_of(text_of(f"_row.{text}"))).alias("term")).join(terms, "term")
        .groupBy("text_key").agg(F.collect_set(F.struct("term", "action")).alias("terms")), "pii-found",
    )
    parts = F.regexp_extract_all(F.col("_row")[text], F.lit(f"{WORD_CLASS}++|{SPACE_CLASS}++"), F.lit(0))
    actions = F.map_from_entries("terms")
    action = lambda part: F.element_at(actions, F.translate(part, UPPER, LOWER))
    clean = F.array_join(F.transform(parts, lambda part: F.when(action(part) == "remove", "").when(action(part) == "generalise", "[TERM]").otherwise(part)), "")
    return with_term_spans(marked.drop("entities"), found).select(*[
        (F.when(F.col("terms").isNotNull(), clean).otherwise(F.col("_row")[c]) if c == text else F.col("_row")[c]).alias(c) for c in docs.columns
    ])
