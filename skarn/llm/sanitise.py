"""Removal of personal data, with DataFrame functions only: patterns, and terms that reveal what the patterns found.

Base spans are e-mail and IP addresses, card and phone numbers, by pattern and check. Each distinct value is a protected
entity. All words outside base spans of the texts that hold it are terms that may reveal it: over all documents, with df
counting documents and n(e, t) the different texts that hold both (copies of a text are one), a term t discloses

    PMI(e; t) / IC(e) * n(e, t)^2 / (n(e, t)^2 + 1),    PMI(e; t) / IC(e) = log(N df(e, t) / (df(e) df(t))) / log(N / df(e)).

The quotient is 1 at most, for a term that occurs with the entity alone: then the term gives away all the information
content of the entity, as who looks for the term finds the entity. It is near 0 for a term that occurs anywhere. The
factor is smoothing by evidence: 0.5 for one text, 0.8 for two, 0.9 for three. A term whose disclosure reaches
``generalise_at`` is generalised at every place in all texts that hold the entity, that is replaced by its kind of word,
and removed from ``remove_at`` on. So at the defaults (0.5, 0.8) a word that stands in no text but the one with the entity
is generalised, and one that goes with the entity from text to text is removed. The sanitised text has a label in place
of each base span.

Entities that stand in the same texts have the same figures and are counted as one class, so a text full of values costs
as much as one with a single value.

The patterns are written so that they take time in proportion to a text and no stack: a match begins at the start of a
run of its characters (or where the last match ended), and repeats don't backtrack. They match what plain greedy ones do.

Defined cases: a null text counts as empty and comes back as null from ``sanitise``; null and repeated ids are carried;
U+E000 in a text with base spans becomes a space in the sanitised text;
equal texts get equal spans; an empty table gives an empty result; other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, free_name, named

#: Kinds in the order that decides between equal starts.
KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that any match holds; texts without it are not searched.
HOLDS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'_-]*+"
GENERALISE_AT, REMOVE_AT = 0.5, 0.8
#: How far a disclosure may stay below a threshold that it equals but for rounding.
ROUNDING = 1e-9

#: A character for private use that stands for those of base spans, and words that may hold it.
MASK = "\ue000"
MASKED_WORD = rf"[\p{{L}}\p{{N}}{MASK}][\p{{L}}\p{{N}}\p{{M}}'_{MASK}-]*+"
#: The same words where a base span is its label between two MASK.
LABEL = f"{MASK}[^{MASK}]*{MASK}"
LABELLED_WORD = rf"(?:[\p{{L}}\p{{N}}]|{LABEL})(?:[\p{{L}}\p{{N}}\p{{M}}'_-]|{LABEL})*+"

SPAN = "struct<start:int,order:int,end:int,value:string>"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array of (start, end, value), in code points. The text between matches has their
    distance: its pieces and the matches are walked side by side."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.arrays_zip(values.alias("value"), sizes.alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    walked = F.aggregate(F.filter(steps, lambda x: x["value"].isNotNull()), empty, step, lambda acc: acc["out"])
    return F.when(F.size(values) > 0, walked).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, 1).cast("int")
        return total + F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    size = F.length(_digits(value))
    if kind == "card":
        return F.when(size.between(12, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text as array of (start, order, end, value), sorted; order is the kind's place in KINDS."""
    out = F.array().cast(f"array<{SPAN}>")
    for kind in PATTERNS:
        out = F.concat(out, _spans_of(kind, text))
    return F.sort_array(out)


def _spans_of(kind: str, text: Column) -> Column:
    hits = F.filter(matches(text, PATTERNS[kind]), lambda m: _accepted(kind, m["value"]))
    order = F.lit(KINDS.index(kind))
    spans = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), order.alias("order"), m["end"].alias("end"), m["value"].alias("value")))
    if kind not in HOLDS:
        return spans
    return F.when(F.contains(text, F.lit(HOLDS[kind])), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["order"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def _filled(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with ``fill(end so far, span)`` in place of each span."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    plain = F.translate(text, MASK, " ")

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array(F.substring(plain, acc["at"] + 1, s["start"] - acc["at"]), fill(acc["at"], s))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], fresh).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(plain, acc["at"] + 1, F.length(plain))))


def _masked(text: Column, spans: Column) -> Column:
    """The text with MASK for each character of a span, all others at their places."""
    return _filled(text, spans, lambda at, s: F.repeat(F.lit(MASK), s["end"] - F.greatest(at, s["start"])))


def _labelled(text: Column, spans: Column) -> Column:
    """The text with a label between two MASK for each span; spans that overlap count as one, with the first one's label."""
    labels = F.array(*[F.lit(f"{MASK}[{k.upper()}]{MASK}") for k in PATTERNS])
    return _filled(text, spans, lambda at, s: F.when(s["start"] >= at, F.element_at(labels, s["order"] + 1)).otherwise(F.lit("")))


def _terms(text: Column, pattern: str = WORD) -> Column:
    """The different words of a text, in lower case; those that touch a masked span are left out."""
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    free = F.filter(words, lambda w: ~F.contains(w, F.lit(MASK))) if pattern == MASKED_WORD else words
    return F.array_distinct(F.transform(free, F.lower))


def find(docs: DataFrame, text_column: str = "text", **keep: Column) -> DataFrame:
    """A row for each of docs: the columns of ``keep``, text_key (equal for equal texts), its base spans as array
    ``base``, and where it has some the text itself as ``body``; to be stored before it is used more than once."""
    text = F.coalesce(named(text_column).cast("string"), F.lit(""))
    read = docs.select(*[c.alias(n) for n, c in keep.items()], text.alias("body"))
    spanned = read.withColumn("base", base_spans(F.col("body")))
    return spanned.select(*keep, F.md5(F.col("body").cast("binary")).alias("text_key"), "base", F.when(F.size("base") > 0, F.col("body")).alias("body"))


def _classes(seen: DataFrame) -> DataFrame:
    """Rows (text_id, class, entity_df): for each text the classes of its entities; those of a class stand in the same
    texts. seen: rows (text_id, copies, entity), each once."""
    low, high = F.xxhash64("text_id"), F.xxhash64("text_id", F.lit(1))
    same = F.concat_ws(":", F.count("*"), F.bit_xor(low), F.bit_xor(high), F.min("text_id"), F.max("text_id"))
    of = seen.groupBy("entity").agg(F.unhex(F.md5(same.cast("binary"))).alias("class"), F.sum("copies").alias("entity_df"))
    return seen.join(of, "entity").select("text_id", "class", "entity_df").distinct()


def telling(docs: DataFrame, found: DataFrame, text_column: str = "text", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> Stored:
    """The different texts with base spans and the terms that are marked in each: rows (text_key, base, body, masked, marks),
    marks as ``_sought`` makes them, null where there are none. found: a stored ``find`` of docs."""
    once = found.where(F.size("base") > 0).groupBy("text_key").agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("body").alias("body"))
    texts = Stored(once.withColumn("masked", _masked(F.col("body"), F.col("base"))).withColumn("text_id", F.monotonically_increasing_id()), "sanitise-texts")
    entity = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["order"], F.lower(s["value"]))))
    classes = Stored(_classes(texts.df.select("text_id", "copies", F.explode(entity).alias("entity"))), "sanitise-classes")
    terms = Stored(texts.df.select("text_id", "copies", F.explode(_terms(F.col("masked"), MASKED_WORD)).alias("term")), "sanitise-terms")
    evidence = F.count("*").cast("double")
    pair = classes.df.join(terms.df, "text_id").groupBy("class", "term").agg(F.sum("copies").alias("pair_df"), F.first("entity_df").alias("entity_df"), (evidence * evidence / (evidence * evidence + 1)).alias("smoothing"))
    # The quotient is 1 at most, so that a pair whose smoothing is below the threshold can't reach it.
    pairs = pair.where(F.col("smoothing") >= generalise_at - ROUNDING)
    # Words outside base spans: those of all texts, less those of texts with spans, and these with their spans masked.
    every = docs.select(F.explode(_terms(F.coalesce(named(text_column).cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    less = texts.df.select(F.explode(_terms(F.col("body"))).alias("term"), (-F.col("copies")).alias("n"))
    words = every.union(less).union(terms.df.select("term", F.col("copies").alias("n")))
    term_df = words.groupBy("term").agg(F.sum("n").alias("term_df"))
    n = F.lit(float(max(1, found.count())))
    information = F.log(n / F.col("entity_df"))
    shared = F.log(n * F.col("pair_df") / (F.col("entity_df") * F.col("term_df")))
    scored = pairs.join(term_df, "term").withColumn("disclosure", F.when(information > 0, F.col("smoothing") * shared / information).otherwise(F.lit(0.0)))
    order = F.when(F.col("disclosure") >= remove_at - ROUNDING, F.lit(KINDS.index("remove"))).otherwise(F.lit(KINDS.index("generalise")))
    found_terms = scored.where(F.col("disclosure") >= generalise_at - ROUNDING).select("class", "term", order.alias("order"))
    marked = classes.df.join(found_terms, "class").groupBy("text_id", "term").agg(F.max("order").alias("order"))
    own = marked.join(terms.df.select("text_id", "term"), ["text_id", "term"]).groupBy("text_id").agg(F.collect_list(F.struct("term", "order")).alias("marks"))
    # Stored, so that the table of a text's marks is made once and not for each of its words.
    marks = Stored(own.select("text_id", _sought(F.col("marks")).alias("marks")), "sanitise-marks")
    out = Stored(texts.df.join(marks.df, "text_id", "left").drop("text_id", "copies"), "sanitise-marked")
    for old in (texts, classes, terms, marks):
        old.drop()
    return out


def _sought(marks: Column) -> Column:
    """Marks (term, order) in as many buckets as the root of their number, by the term's hash."""
    many = F.ceil(F.sqrt(F.size(marks))).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.filter(marks, lambda m: F.pmod(F.xxhash64(m["term"]), many) == b))


def _order(marks: Column, term: Column) -> Column:
    """The order of a term's mark, or null."""
    bucket = F.get(marks, F.pmod(F.xxhash64(term), F.size(marks)).cast("int"))
    return F.get(F.filter(bucket, lambda m: m["term"] == term), F.lit(0))["order"]


def _words(text: Column, pattern: str) -> Column:
    """Array of (gap, word): the words of a text with the text before each; at last the rest, without a word."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"))


def term_spans(texts: DataFrame) -> DataFrame:
    """Rows (text_key, added): spans of marked terms by text, array of (start, order, end, value), in order. A text's words
    are walked once; spans are gathered in blocks, so that arrays that grow stay short."""
    block, spans = f"array<{SPAN}>", f"array<array<{SPAN}>>"
    sized = F.transform(
        _words(F.col("masked"), MASKED_WORD),
        lambda w: F.struct(F.length(w["gap"]).alias("gap"), F.coalesce(F.length(w["word"]), F.lit(0)).alias("size"), F.lower(w["word"]).alias("term"), _order(F.col("marks"), F.lower(w["word"])).alias("order")),
    )

    def step(acc: Column, w: Column) -> Column:
        start = acc["at"] + w["gap"]
        one = F.array(F.struct(start.alias("start"), w["order"].alias("order"), (start + w["size"]).alias("end"), w["term"].alias("value")))
        full = F.size(acc["block"]) >= 128
        return F.struct(
            (start + w["size"]).alias("at"),
            F.when(w["order"].isNull(), acc["block"]).when(full, one).otherwise(F.concat(acc["block"], one)).alias("block"),
            F.when(w["order"].isNotNull() & full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(block).alias("block"), F.array().cast(spans).alias("done"))
    walked = F.aggregate(sized, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))
    return texts.where("marks IS NOT NULL").select("text_key", walked.alias("added"))


def rewritten(texts: DataFrame) -> DataFrame:
    """Rows (text_key, clean): the texts with base spans as they come out, put together from their words."""
    general = lambda w: F.when(w.rlike(r"\p{N}"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))

    def shown(w: Column) -> Column:
        order = F.when(F.col("marks").isNull() | w["word"].isNull(), F.lit(None)).otherwise(_order(F.col("marks"), F.lower(w["word"])))
        plain = F.translate(F.coalesce(w["word"], F.lit("")), MASK, "")
        return F.concat(w["gap"], F.when(order.isNull(), plain).when(order == KINDS.index("remove"), F.lit("")).otherwise(general(w["word"])))

    return texts.select("text_key", F.array_join(F.transform(_words(_labelled(F.col("body"), F.col("base")), LABELLED_WORD), shown), "").alias("clean"))


def _span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["end"])), ",")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **thresholds: float) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each of docs."""
    found = Stored(find(docs, text_column, doc_id=named(id_column)), "sanitise-found").df
    texts = telling(docs, found, text_column, **thresholds)
    added = Stored(term_spans(texts.df), "sanitise-added").df
    texts.drop()
    both = found.drop("body").join(added, "text_key", "left")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return both.select("doc_id", *[_count(kind) for kind in PATTERNS], F.sha2(_span_text(F.col("base")), 256).alias("base_sha256"), _span_text(every).alias("spans"))


def sanitise(docs: DataFrame, text_column: str = "text", **thresholds: float) -> DataFrame:
    """docs with the text column sanitised; rows without spans are unchanged."""
    found = Stored(find(docs, text_column), "sanitise-found")
    texts = telling(docs, found.df, text_column, **thresholds)
    clean = Stored(rewritten(texts.df), "sanitise-clean").df
    found.drop()
    texts.drop()
    key, new = free_name(docs, "text_key"), free_name(docs, "clean_text")
    keyed = docs.withColumn(key, F.md5(F.coalesce(named(text_column).cast("string"), F.lit("")).cast("binary")))
    joined = keyed.join(clean.select(F.col("text_key").alias(key), F.col("clean").alias(new)), key, "left")
    text = F.coalesce(F.col(new), named(text_column).cast("string"))
    return joined.select(*[text.alias(c) if c == text_column else named(c) for c in docs.columns])
