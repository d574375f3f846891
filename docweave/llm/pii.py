"""PII: base patterns, and terms near an entity that disclose it (DataFrame functions only).

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Java
regular expressions find them; possessive quantifiers keep long texts linear
and find what the plain patterns find.

Information-theoretic sanitisation: words in the context of an entity may tell
which entity was there.  Over all different texts of the corpus,

    IC(e) = log(N / df(e)),  PMI(t, e) = log(N co(t, e) / (df(t) df(e))),

and t discloses the share PMI / IC of what there is to know about e.  N is the
number of different texts, df(e) and df(t) count the texts with the entity and
with the word, co(t, e) those with the word in the entity's context.  A pair
needs ``MIN_TEXTS`` texts to be believed: copies of one text are one text.
Most entities stand in one text only, but what they belong to recurs: their
kind, and the mail domain, network, card or phone prefix (``classes``).  These
are entities of their own, with one more smoothed count for a word,

    PMI(t, c) = log((co(t, c) + PRIOR df(c) / N) / (df(t) + PRIOR) / (df(c) / N)),

so that chance company of a rare word with a frequent class discloses nothing.
Shares from ``GENERALISE`` on make the word a span of its own there, to be
generalised; from ``REMOVE`` on it is to be removed.

All counts are grouped sums with partial aggregation.  A word that is near
entities in too many texts to reach ``GENERALISE`` is ruled out first; the rest
is counted over all texts.  The table of these words is broadcast up to ``MAX_BROADCAST_TERMS`` rows and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_within, materialise, pick

#: Kinds in the order of the results, with their patterns.
PATTERNS = {
    # a run of address characters begins where the one before ended, or where the last match did
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # whole chains of digits with single separators, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to be searched for a kind.
HINTS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}+"),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
#: Code points on either side of an entity that are its context.
CONTEXT = 80
WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
MIN_TEXTS = 2
GENERALISE = 0.9
REMOVE = 0.97
#: Texts that a word's share of a class is smoothed with.
PRIOR = 1.0
#: The part of an entity's name that several entities share (the rest follows the kind and a colon).
CLASS_PARTS = {"email": r"@(.+)$", "ip": r":([0-9]+\.[0-9]+)\.", "card": r":([0-9]{6})", "phone": r":([0-9]{4})"}
MAX_BROADCAST_TERMS = 500_000

_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the pattern's matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.arrays_zip(between.alias("gap"), found.alias("value"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, begin, step, lambda acc: acc["spans"])
                  ).otherwise(F.array().cast(_SPANS))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    weighed = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
    ).otherwise(d.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def _part_within(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


CHECKS = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["value"], r"\."), _part_within),
    "card": lambda s: luhn(digits(s["value"])),
    "phone": lambda s: F.length(digits(s["value"])).between(8, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of (start, end, value) that pass its check."""
    return {kind: F.when(HINTS[kind](text), F.filter(matches(text, pattern), CHECKS[kind]))
            .otherwise(F.array().cast(_SPANS)) for kind, pattern in PATTERNS.items()}


def _entity(kind: str, value: Column) -> Column:
    """The same entity however it is written: addresses in lower case, numbers by their digits."""
    bare = digits(value) if kind in ("card", "phone") else F.lower(value)
    return F.concat(F.lit(f"{kind}:"), bare)


def classes(entity: Column) -> Column:
    """An entity and the classes it belongs to: ``email:a@b.c``, ``email``, ``email/b.c``."""
    kind = F.substring_index(entity, ":", 1)
    part = F.coalesce(*[F.when(kind == k, F.regexp_extract(entity, p, 1)) for k, p in CLASS_PARTS.items()])
    return F.array(entity, kind, F.concat(kind, F.lit("/"), part))


def _is_class(entity: Column) -> Column:
    return ~F.contains(entity, F.lit(":"))


def context_words(text: Column, span: Column, entity: Column) -> Column:
    """Array of (term, start, end, entity) of the whole words in the context of ``span``."""
    start, end = span["start"], span["end"]
    first = F.greatest(start - CONTEXT, F.lit(0))
    left = F.substring(text, first + 1, start - first)
    left = F.when(first > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.substring(text, end + 1, F.lit(CONTEXT))
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)

    def placed(part: Column, offset: Column) -> Column:
        return F.transform(matches(part, WORD), lambda w: F.struct(
            F.lower(w["value"]).alias("term"), (w["start"] + offset).alias("start"),
            (w["end"] + offset).alias("end"), entity.alias("entity")))

    return F.concat(placed(left, start - F.length(left)), placed(right, end))


def _around(text: Column, kind: str):
    return lambda span: context_words(text, span, _entity(kind, span["value"]))


def _named(kind: str):
    return lambda span: _entity(kind, span["value"])


def find_entities(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as a stored table without texts.

    ``h1, h2`` name the text; ``email .. phone`` are its base spans; ``around``
    lists (term, start, end, entity) of the words near them, base spans left out.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
                        text.alias("text")).withColumns(base_spans(F.col("text")))
    near = [F.flatten(F.transform(kind, _around(F.col("text"), kind))) for kind in PATTERNS]
    spans = F.concat(*PATTERNS)
    around = F.filter(F.concat(*near), lambda w: ~F.exists(
        spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    found = found.withColumn("around", F.when(F.size(spans) > 0, around))
    return materialise(found.drop("text"), "pii-found")


def disclosing_terms(docs: DataFrame, found: DataFrame, min_texts: int = MIN_TEXTS,
                     threshold: float = GENERALISE) -> DataFrame:
    """(term, entity, share): words that disclose an entity whose context they are in."""
    n_texts = found.select("h1", "h2").distinct().count()
    near = found.filter("size(around) > 0").select("h1", "h2", F.explode("around").alias("w"))
    seen = near.select("h1", "h2", "w.term", F.explode(classes(F.col("w.entity"))).alias("entity")).distinct()
    pairs = seen.groupBy("term", "entity").agg(F.count("*").alias("co")).filter(F.col("co") >= min_texts)
    entities = [F.transform(kind, _named(kind)) for kind in PATTERNS]
    every = F.array_distinct(F.flatten(F.transform(F.concat(*entities), classes)))
    df_entity = (found.select("h1", "h2", F.explode(every).alias("entity"))
                 .distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
                 .filter(F.col("df_entity") >= min_texts))  # all that a pair can have
    # a class has the pairs of many words, which a join by a shuffle would bring together
    df_entity = broadcast_within(materialise(df_entity, "pii-entities"), MAX_BROADCAST_TERMS)
    # a word is in at least the texts that have it near some entity: that alone rules out
    # every word that is too common to disclose anything, before the corpus is counted
    at_least = (seen.select("h1", "h2", "term").distinct().groupBy("term").agg(F.count("*").alias("at_least")))
    at_most = F.col("co") * F.pow(F.lit(float(n_texts)) / F.col("df_entity"), F.lit(1 - threshold)) * (1 + 1e-9)
    pairs = materialise(pairs.join(df_entity, "entity").join(at_least, "term")
                        .filter(F.col("at_least") <= at_most).drop("at_least"), "pii-pairs")
    terms = broadcast_within(materialise(pairs.select("term").distinct(), "pii-terms"), MAX_BROADCAST_TERMS)
    text = F.coalesce("text", F.lit(""))
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    df_term = (docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
                           F.explode(words).alias("term"))
               .join(terms, "term").distinct().groupBy("term").agg(F.count("*").alias("df_term")))
    usual = F.col("df_entity") / F.lit(float(n_texts))
    prior = F.when(_is_class(F.col("entity")), PRIOR).otherwise(0.0)
    pmi = F.log((F.col("co") + prior * usual) / (F.col("df_term") + prior) / usual)
    share = F.try_divide(pmi, F.log(F.lit(float(n_texts)) / F.col("df_entity")))
    return materialise(pairs.join(df_term, "term").withColumn("share", share)
                       .filter(F.col("share") >= threshold).select("term", "entity", "share"), "pii-disclosing")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its spans.

    Columns ``doc_id, email, ip, card, phone`` (arrays of start, end, value) and
    ``terms`` (start, end, share; ordered).  A null text counts as empty and
    has no spans; repeated rows get equal spans; an empty table gives an empty
    table.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    found = find_entities(base)
    telling = disclosing_terms(base, found)
    places = (found.filter("size(around) > 0").select("h1", "h2", F.explode("around").alias("w"))
              .select("h1", "h2", "w.term", "w.start", "w.end", F.explode(classes(F.col("w.entity"))).alias("entity"))
              .join(telling, ["term", "entity"])
              .groupBy("h1", "h2", "start", "end").agg(F.max("share").alias("share"))
              .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms")))
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    places = materialise(places, "pii-places")  # two plain sides: a hot text's copies are split
    return (found.join(places, ["h1", "h2"], "left")
            .select("doc_id", *PATTERNS, F.coalesce("terms", none).alias("terms"), "h1", "h2"))


def span_list(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced.

    Entities become their kind in angle brackets, disclosing words ``<word>``
    or, from ``REMOVE`` on, nothing.  Spans that overlap are replaced by the
    first of them, up to the end of the last.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    spans = find_pii(base).drop("doc_id").dropDuplicates(["h1", "h2"])
    rows = (base.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"),
                        F.xxhash64(F.lit(1), text).alias("h2")).join(spans, ["h1", "h2"]))

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                    F.lit(f"<{kind}>").alias("by")))

    terms = F.transform("terms", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["share"] >= REMOVE, "").otherwise("<word>").alias("by")))
    every = F.sort_array(F.concat(*[marked(k) for k in PATTERNS], terms))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["out"], kept, s["by"]).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    out = F.aggregate(every, begin, step)
    return rows.withColumn("done", out).select(
        "doc_id", F.concat(F.col("done.out"), F.substring(F.col("text"), F.col("done.at") + 1,
                                                          F.length("text"))).alias("text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*[span_list(F.col(k), k) for k in PATTERNS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, span_list(F.col("terms"), "term")), ",").alias("spans"))
