"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Identifiers (e-mail and IP addresses, card and phone numbers) are found by
pattern and check rules; they are the protected entities. Other words of a text
that holds an entity may reveal it as well: over all distinct texts, the pointwise
mutual information of term and entity is compared with the entity's information
content. A term that gives away at least ``disclosure`` of it, and is seen with the
entity in at least ``support`` distinct texts, is generalised at every place in the
texts that hold that entity.

    PMI(t; e) = ln(N * n(t, e) / (n(t) * n(e)))     IC(e) = ln(N / n(e))

n counts distinct texts of the whole corpus (N), wherever in a text the term stands,
and words of any length. Texts are shuffled once by their hash, so that copies count
once; words are counted by partial aggregates. Pairs are counted for entities in
``support`` texts or more, as no other one can have such a term.

Cases: null text counts as empty; a text without identifiers has no spans and
stays as it is; copies of a text count once in the statistics and get the same
spans; spans of different kinds may overlap, and are united before rewriting;
null ids and repeated rows are kept; an empty table gives an empty one; other
columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import materialise, whole_text

#: Patterns in their order, and what a text must hold for one to match. They match
#: what the contract's patterns match; possessive repeats and the checks in front
#: only spare searches that cannot succeed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = "term"
WORD = r"[\p{L}\p{N}]+"
#: Cuts nothing any more; the plain version in tests/llm/test_privacy.py still reads it.
REACH = 64
SUPPORT, DISCLOSURE = 3, 0.9


# Identifiers -------------------------------------------------------------------

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
                       lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _part(part: Column) -> Column:
    """A number of an address is at most 255; leading zeros do not count."""
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 4) & (F.lpad(short, 3, "0").cast("int") <= 255)


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", F.forall(F.split(value, r"\."), _part))
            .when(kind == "card", F.length(digits).between(12, 19) & _luhn(digits))
            .otherwise(F.length(digits).between(9, 15)))


def _hits(kind: str) -> Column:
    """Matches of a kind in order, each with the length of the text since the one before, in characters and bytes."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found))
    hits = F.transform(F.arrays_zip(found.alias("value"), gaps.alias("gap")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("number"), x["value"].alias("value"), F.length(x["gap"]).alias("gap"),
        F.octet_length(x["gap"]).alias("wide")))
    none = F.array().cast("array<struct<kind:string,number:int,value:string,gap:int,wide:int>>")
    # a search without success is cheaper than taking the text apart
    return F.when(text.contains(MARK[kind]) & text.rlike(PATTERNS[kind]), hits).otherwise(none)


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, all matches of each document, and its text if one is valid; written once."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", F.md5("text").alias("text_hash"), F.concat(*(_hits(k) for k in KINDS)).alias("hits"), "text")
    held = F.exists("hits", lambda x: _valid(x["kind"], x["value"]))
    return materialise(rows.select("doc_id", "text_hash", "hits", F.when(held, F.col("text")).alias("text")), "identifiers")


def _occurrences(found: DataFrame) -> DataFrame:
    """The valid identifiers of each distinct text, with their places."""
    texts = found.where(F.size("hits") > 0).dropDuplicates(["text_hash"])
    rows = texts.select("text_hash", F.explode("hits").alias("hit")).select("text_hash", "hit.*")
    order = Window.partitionBy("text_hash", "kind").orderBy("number")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum(F.col("gap") + F.length("value")).over(before)
    bytes_passed = F.sum(F.col("wide") + F.octet_length("value")).over(before)
    placed = rows.withColumn("end", passed.cast("int")).withColumn("start", F.col("end") - F.length("value"))
    placed = placed.withColumn("last", bytes_passed.cast("int")).withColumn("first", F.col("last") - F.octet_length("value"))
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("value")).when(
        F.col("kind") == "ip", F.col("value")).otherwise(_digits(F.col("value"))))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select(
        "text_hash", "kind", "start", "end", "first", "last", entity.alias("entity"))


# Terms -------------------------------------------------------------------------

def _words(text: Column) -> Column:
    """The distinct words of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _holders(occurrences: DataFrame, support: int) -> DataFrame:
    """(text_hash, entity) of the entities that are in at least ``support`` distinct texts."""
    each = occurrences.select("text_hash", "entity").distinct()
    often = each.groupBy("entity").agg(F.count("*").alias("entities")).where(F.col("entities") >= support)
    return each.join(often.select("entity"), "entity").select("text_hash", "entity")


def _held(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_hash, text), once, of the texts that hold a valid identifier and are in ``texts``."""
    whole = found.where(F.col("text").isNotNull()).select("text_hash", "text").dropDuplicates(["text_hash"])
    return whole.join(texts.select("text_hash").distinct(), "text_hash", "left_semi")


def _terms(found: DataFrame, holders: DataFrame) -> DataFrame:
    """(text_hash, term): each word of each text of ``holders``."""
    return _held(found, holders).select("text_hash", F.explode(_words(F.col("text"))).alias("term"))


def _places(found: DataFrame, marked: DataFrame) -> DataFrame:
    """(text_hash, start, end, first, last) of every place of the terms in ``marked`` (text_hash, term)."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    each = _held(found, marked).select("text_hash", F.posexplode(F.transform(
        F.arrays_zip(words.alias("word"), F.slice(F.split("text", WORD, -1), 1, F.size(words)).alias("gap")),
        lambda x: F.struct(F.lower(x["word"]).alias("term"), F.length(x["word"]).alias("size"), F.length(x["gap"]).alias("gap"),
                           F.octet_length(x["word"]).alias("bytes"), F.octet_length(x["gap"]).alias("wide")))
    ).alias("number", "word")).select("text_hash", "number", "word.*")
    order = Window.partitionBy("text_hash").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("int")).withColumn(
        "last", F.sum(F.col("wide") + F.col("bytes")).over(order).cast("int"))
    return placed.join(marked, ["text_hash", "term"], "left_semi").select(
        "text_hash", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("last") - F.col("bytes")).alias("first"), "last")


def _corpus_counts(docs: DataFrame) -> DataFrame:
    """(term, texts): distinct texts of the corpus that hold each word.

    A semi-join with the candidates would be pushed below the counting, and each
    word of each text shuffled.
    """
    texts = docs.select(F.md5(whole_text()).alias("text_hash"), whole_text().alias("text")).dropDuplicates(["text_hash"])
    return texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))


def revealing_terms(docs: DataFrame, found: DataFrame, holders: DataFrame, terms: DataFrame,
                    support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, pmi, information) of the terms that reveal too much."""
    total = found.select("text_hash").distinct().agg(F.count("*").cast("double")).scalar()
    together = terms.join(holders, "text_hash").groupBy("entity", "term").agg(
        F.count("*").alias("both")).where(F.col("both") >= support)
    alone = holders.groupBy("entity").agg(F.count("*").alias("entities"))
    # a term is in at least the texts where it stands with some entity; by that alone
    # most common words cannot reach the threshold
    seen = terms.groupBy("term").agg(F.count("*").alias("seen"))
    most = F.col("both") * F.pow(total / F.col("entities"), F.lit(1 - disclosure)) * (1 + 1e-9)
    candidates = materialise(together.join(alone, "entity").join(seen, "term").where(F.col("seen") <= most), "candidates")
    scored = candidates.join(_corpus_counts(docs), "term").select(
        "entity", "term",
        F.log(total * F.col("both") / (F.col("texts") * F.col("entities"))).alias("pmi"),
        F.log(total / F.col("entities")).alias("information"))
    return scored.where((F.col("information") > 0) & (F.col("pmi") >= disclosure * F.col("information")))


def find_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(found, spans): all documents with their text's hash, and a row for each span of a distinct text.

    spans: text_hash, start, rank of the kind, kind, end, and first, last: the same in bytes.
    """
    found = identifiers(docs)
    occurrences = materialise(_occurrences(found), "occurrences")
    holders = materialise(_holders(occurrences, support), "holders")
    terms = materialise(_terms(found, holders), "terms")
    revealed = materialise(revealing_terms(docs, found, holders, terms, support, disclosure).select("entity", "term"), "revealed")
    # through the few terms that reveal anything, then the pairs of a text
    likely = terms.join(revealed.select("term").distinct(), "term", "left_semi")
    marked = materialise(likely.join(holders, "text_hash").join(revealed, ["entity", "term"], "left_semi").select(
        "text_hash", "term").distinct(), "marked")
    ranks = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    columns = ["text_hash", "start", F.array_position(ranks, F.col("kind")).cast("int").alias("rank"), "kind", "end", "first", "last"]
    base = occurrences.select(*columns)
    added = _places(found, marked).withColumn("kind", F.lit(TERM)).select(*columns)
    return found, _apart(base.union(added))


def _apart(spans: DataFrame) -> DataFrame:
    """The spans without the terms that an identifier overlaps.

    In order of their places, an earlier identifier must not end behind a term's start, nor the
    next one start before its end; two passes over a text's spans tell.
    """
    forth = Window.partitionBy("text_hash").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("text_hash").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    term = F.col("kind") == TERM
    marked = spans.withColumn("ended", F.max(F.when(~term, F.col("end"))).over(forth)).withColumn(
        "begins", F.min(F.when(~term, F.col("start"))).over(back))
    clear = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end")))
    return marked.where(~term | clear).drop("ended", "begins")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def privacy_report(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Per document the counts and digest of the identifiers, and all spans."""
    found, spans = find_spans(docs, support, disclosure)
    listed = spans.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    rows = found.select("doc_id", "text_hash").join(listed, "text_hash", "left")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    every = F.coalesce("spans", empty)
    base = F.filter(every, lambda s: s["kind"] != TERM)

    def of(kind: str) -> Column:
        return F.filter(every, lambda s: s["kind"] == kind)

    return rows.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with each span of their text replaced by its kind in brackets.

    A text is cut by bytes, where a place is found without reading what is before it, and its
    pieces are joined once, so the work grows with the text and its spans.
    """
    _, spans = find_spans(docs, support, disclosure)
    # a span that begins inside an earlier one goes with it
    order = Window.partitionBy("text_hash").orderBy("first", "rank", "last").rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("since", F.coalesce(F.max("last").over(order), F.lit(0)))
    texts = opened.groupBy(F.col("text_hash").alias("_p_hash")).agg(
        F.sort_array(F.collect_list(F.when(F.col("first") >= F.col("since"), F.struct("first", "since", "kind")))).alias("_p_cuts"),
        F.max("last").alias("_p_last"))
    joined = docs.join(texts, F.md5(whole_text()) == F.col("_p_hash"), "left")

    def part(raw: Column, begin: Column, end: Column) -> Column:
        return F.substring(raw, begin + 1, end - begin).cast("string")

    def rewritten(raw: Column) -> Column:
        pieces = F.transform("_p_cuts", lambda c: F.concat(part(raw, c["since"], c["first"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(raw, F.col("_p_last"), F.length(raw)))

    # as an element of an array the bytes are made once, not for every piece
    clean = F.when(F.col("_p_last").isNull(), F.col("text")).otherwise(F.transform(F.array(F.col("text").cast("binary")), rewritten)[0])
    return joined.select(*(clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
