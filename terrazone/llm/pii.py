"""Operator 10: PII by information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by regular expressions. Their values
are the protected entities. The method then asks of the words around them how much they reveal: over the corpus, a word t
discloses an entity c when PMI(c; t) >= alpha * IC(c), where IC(c) = -ln p(c), p by documents. With document counts
n_c, n_t, n_ct of N this is n_ct / n_t >= (n_c / N) ** (1 - alpha); all of them count whole texts. The word must also stand in half of the entity's documents
and, outside base spans, in documents that hold the entity in at least `support` different contexts (what is within REACH
characters of it; so copies of one text don't count twice). Such words are spans of kind `term` in documents that hold the entity, unless they
overlap a base span; redaction removes them and generalises base spans to their kind.

All of it is DataFrame functions: a text is split at the matches of a pattern, and the lengths of pieces and matches give the
positions. Patterns use possessive quantifiers, so that Java needs neither recursion nor backtracking on long runs; what they match is
what the plain patterns match. Documents without a base span are only counted in N and n_t. Counts by entity and by word are
sums that are made before rows are shuffled; no group is collected.

Matches are walked in chunks, so a long text with many of them costs no array that grows by one at each. Every span of a text
that is replaced costs a pass over that text.

Defined cases: null text is empty, and stays null when redacted; no spans give empty strings and the hash of the empty string;
repeated rows are documents each; null ids are carried; other columns, whatever their names, are ignored by the report and carried when
redacting; of spans with one start the kind listed first comes first; texts may be of any length that a row can have; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import packed, unpacked
from terrazone.session import cut

ALPHA, SUPPORT, SHARE, REACH = 0.9, 3, 0.5, 120
#: Terms that are broadcast at most.
SMALL = 100_000

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in order of listing: pattern, what a text must hold, and the check of a match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = "term"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.regexp_replace(p, "^0+", "").try_cast("int").isNull() | (F.regexp_replace(p, "^0+", "").try_cast("int") <= 255)))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
#: Elements of an array that one fold walks.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value), value computed once: a lambda's outer expressions are computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK)))


def _spans(text: Column, pattern: Column, rank: int, kind: str) -> Column:
    """Array of (start, rank, end, kind, value) of all matches; code points, end exclusive."""
    # what comes before each match, and the match; the last piece has none
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit")))
    width = lambda piece: piece["gap"] + F.coalesce(F.length(piece["hit"]), F.lit(0))

    def walk(chunk: Column, begin: Column) -> Column:
        def step(a: Column, piece: Column) -> Column:
            start = a["at"] + piece["gap"]
            end = start + F.length(piece["hit"])
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), piece["hit"].alias("value"))
            kept = F.when(piece["hit"].isNotNull() & _valid(kind, piece["hit"]), F.concat(a["found"], F.array(span))).otherwise(a["found"])
            return F.struct(F.coalesce(end, start).alias("at"), kept.alias("found"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("found")), step)["found"]

    def whole(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, piece: a + width(piece)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(begins, 1, F.size(chunks)), walk))

    return _let(_chunks(pieces), whole)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind as listed."""
    empty = F.array().cast(_SPANS)
    found = [F.when(text.rlike(NEEDS[k]), _spans(text, F.lit(PATTERNS[k]), i, k)).otherwise(empty) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_entities(df: DataFrame, text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """row (the other columns), text, base (base spans) and number (of the row), written to the shared folder; text only where there are base spans unless it is carried."""
    rows = df.select(packed(df, [c for c in df.columns if c != text_col]), df[text_col].alias("text")).withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    if not carry_text:
        rows = rows.withColumn("text", F.when(F.size("base") > 0, F.col("text")))
    return cut(rows.withColumn("number", F.monotonically_increasing_id()), "entities")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}+"), F.lit(0)))


def _replaced(spans: str, mark) -> Column:
    """text with its spans replaced by mark(span); of overlapping spans the first one's."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,at:int>>")

    def kept(chunk: Column, begin: Column) -> Column:
        """Spans that begin no earlier than those before them end, each with that end."""

        def step(a: Column, s: Column) -> Column:
            one = F.struct(*[s[k].alias(k) for k in ("start", "rank", "end", "kind", "value")], a["at"].alias("at"))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), empty.alias("found")), step)["found"]

    def whole(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda c: F.coalesce(F.array_max(F.transform(c, lambda s: s["end"])), F.lit(0)))
        begins = F.aggregate(ends, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.greatest(F.element_at(a, -1), n))))
        return F.flatten(F.zip_with(chunks, F.slice(begins, 1, F.size(chunks)), kept))

    def joined(found: Column) -> Column:
        before = F.transform(found, lambda s: F.concat(F.substring(F.col("text"), s["at"] + 1, s["start"] - s["at"]), mark(s)))
        last = F.coalesce(F.array_max(F.transform(F.col(spans), lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(before, ""), F.substring(F.col("text"), last + 1, F.length("text")))

    return _let(_let(_chunks(F.col(spans)), whole), joined)


def disclosing_terms(found: DataFrame, texts: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(value, term): the terms that disclose an entity. texts: the column text of all documents."""
    held = found.where(F.size("base") > 0)
    at = held.select("number", "text", F.explode("base").alias("s")).select(
        "number", F.lower("s.value").alias("value"),
        # what is within reach on either side, without a word that reaches over the window's edge: the character beyond it tells
        F.when(F.col("s.start") > REACH, F.regexp_replace(F.substring(F.col("text"), F.col("s.start") - REACH, F.lit(REACH + 1)), r"(?s)^(?:\p{L}+|.)", "")).otherwise(F.substring(F.col("text"), F.lit(1), F.col("s.start"))).alias("before"),
        F.when(F.length("text") - F.col("s.end") > REACH, F.regexp_replace(F.substring(F.col("text"), F.col("s.end") + 1, F.lit(REACH + 1)), r"(?s)(?:\p{L}+|.)\z", "")).otherwise(F.substring(F.col("text"), F.col("s.end") + 1, F.lit(REACH))).alias("after"),
    )
    around = cut(at.select("number", "value", F.md5(F.concat_ws("|", "before", "after")).alias("context")).distinct(), "contexts")
    entity = around.select("value", "number").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_c"))
    often = around.select("value", "context").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support).select("value")
    # `support` contexts of an entity in one document tell as much as all of them
    judged = around.join(often, "value").groupBy("number", "value").agg(F.slice(F.array_sort(F.collect_set("context")), 1, support).alias("contexts"))
    # all words of these documents, as n_t counts them; apart: those that stand outside base spans
    own = held.join(judged.select("number").distinct(), "number", "left_semi").select("number", _words(F.col("text")).alias("words"), _words(_replaced("base", lambda s: F.lit(" "))).alias("apart"))
    own = own.select("number", F.concat(F.transform("apart", lambda w: F.struct(w.alias("term"), F.lit(True).alias("apart"))), F.transform(F.array_except("words", "apart"), lambda w: F.struct(w.alias("term"), F.lit(False).alias("apart")))).alias("terms"))
    pairs = cut(judged.join(own, "number"), "judged").select("value", "contexts", F.explode("terms").alias("t")).select("value", "contexts", "t.term", "t.apart")
    joint = pairs.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_ct")).join(entity, "value").where(F.col("n_ct") >= share * F.col("n_c"))
    joint = cut(joint, "joint")
    spread = pairs.where("apart").join(joint.select("value", "term"), ["value", "term"], "left_semi").select("value", "term", F.explode("contexts").alias("context"))
    spread = spread.distinct().groupBy("value", "term").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support).select("value", "term")
    asked = cut(joint.join(spread, ["value", "term"]), "asked")
    terms = asked.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return asked.select("value", "term")
    words = texts.select(F.explode(_words(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    # an inner join, as a semi join would be pushed below the count and meet every word of every text
    counted = words.join(F.broadcast(terms) if n_terms <= SMALL else terms, "term")
    total = texts.count()
    known = asked.join(counted, "term")
    return known.where(F.col("n_ct") / F.col("n_t") >= F.pow(F.col("n_c") / F.lit(float(total)), F.lit(1 - alpha))).select("value", "term")


def with_spans(df: DataFrame, text_col: str = "text", carry_text: bool = True, **limits) -> DataFrame:
    """row, text, base and number of find_entities, and spans (base spans and disclosing terms, by start, then kind)."""
    found = find_entities(df, text_col, carry_text)
    told = cut(disclosing_terms(found, df.select(F.col(text_col).alias("text")), **limits), "told")
    held = found.where(F.size("base") > 0)
    by_row = held.select("number", F.explode("base").alias("s")).select("number", F.lower("s.value").alias("value")).distinct()
    by_row = by_row.join(told, "value").groupBy("number").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # terms of one text, from its own contexts
    held = held.join(by_row, "number", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.when(F.size("terms") > 0, F.filter(_spans(F.col("text"), pattern, len(KINDS), TERM), free)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>"))
    held = held.withColumn("spans", F.array_sort(F.concat("base", more))).drop("terms")
    clean = found.where(F.size("base") == 0).withColumn("spans", F.col("base"))
    return held.unionByName(clean)


def pii_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = with_spans(df.select(df[id_col].alias("id"), df[text_col].alias("text")), "text", carry_text=False, **limits)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("row.id").alias(id_col), *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """df with the spans of its texts replaced by their kinds in brackets, terms removed; overlapping spans by the first one's."""
    found = with_spans(df, text_col, **limits)
    mark = lambda s: F.when(s["kind"] == TERM, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    text = F.when(F.size("spans") > 0, _replaced("spans", mark)).otherwise(F.col("text"))
    return found.select(*unpacked(found, df.columns, **{text_col: text}))
