"""Personal data: patterns, then information-theoretic sanitisation. DataFrame functions alone.

Patterns find the protected entities (addresses, card and phone numbers). Corpus co-occurrence then estimates how strongly
a term of the documents that mention an entity reveals it: with probabilities over distinct texts, a term t discloses an
entity c if PMI(c; t) >= threshold * IC(c), that is, if knowing t removes that share of the uncertainty about c. Any word of
the whole text is a term, without the marks around it. Disclosing terms are generalised to a placeholder wherever they
occur. The texts of the evidence have to mention the entity in several distinct contexts (the words next to it), so that
copies and near copies of one document prove nothing.

Numbers count as one entity however they are spaced, addresses whatever their case. Context words are whole, and reach at most to
the next match of the kind.

Positions are code points, end exclusive. Null texts count as empty. Every row gives one row; term spans are those of the
row's own text, so repeated rows and null ids are safe. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, saved, small

KINDS = ("email", "ip", "card", "phone", "term")
#: Each pattern starts where a run of its first class starts, or where the match before it ended, so that no text is
#: scanned again from the middle of a run; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: A word without the marks around it: from its first letter or digit to its last.
TERM = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}\p{M}])?"

_SPANS = "array<struct<start:int,end:int,kind:string,match:string,near:string>>"
#: Matches whose places are added up together.
_RUN = 256


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as disclosing: with an entity that is mentioned in how many distinct contexts (`near` words on each side tell them apart), what share of IC."""

    near: int = 3
    contexts: int = 3
    threshold: float = 0.9


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 is 0."""

    def weigh(c: Column, i: Column) -> Column:
        v = c.cast("int") * (F.lit(1) + i % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), weigh)
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _around(before: Column, after: Column, near: int) -> Column:
    """Up to `near` words before and behind a match, whole; the pieces reach to the neighbouring matches of the kind."""
    if not near:
        return F.lit("")
    first = rf"^{SPACE}*((?:{WORD}{SPACE}*){{0,{near}}})"
    squeezed = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, first, 1)), SPACE + "+", " ")
    return F.concat(F.reverse(squeezed(F.reverse(before))), F.lit("|"), squeezed(after))


def _spans(text: Column, kind: str, pattern: str, valid, near: int = 0) -> Column:
    """start, end, kind, match and the words around of the pattern's valid matches. Linear in the text and (in runs of _RUN) in its matches."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["match"])
        words = _around(x["piece"], x["next"], near)
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), words.alias("near"))
        return F.struct(end.alias("at"), F.when(valid(x["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("out"))
        done = F.array(F.aggregate(part, zero, step))  # a list of one, to name what is used twice
        return F.element_at(F.transform(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 1)

    three = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match"), F.slice(pieces, 2, F.size(found)).alias("next"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _RUN).cast("int")), lambda i: F.slice(three, i * _RUN + 1, _RUN))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(runs, zero, run, lambda acc: acc["out"]))).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column, near: int = 0) -> Column:
    """All valid spans of the four patterns, by start, then kind as listed; near: of how many words on each side."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    ip_ok = lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    n = lambda m: F.length(_digits(m))
    none = F.array().cast(_SPANS)
    gated = [
        (F.contains(text, F.lit("@")), _spans(text, "email", EMAIL, lambda m: F.lit(True), near)),
        (text.rlike(r"[0-9]\.[0-9]"), _spans(text, "ip", IP, ip_ok, near)),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _spans(text, "card", CARD, lambda m: n(m).between(14, 19) & _luhn(_digits(m)), near)),
        (text.rlike(r"\+[0-9]"), _spans(text, "phone", PHONE, lambda m: n(m).between(10, 15), near)),
    ]
    return _ordered(F.concat(*(F.when(gate, spans).otherwise(none) for gate, spans in gated)))


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), s["near"].alias("near")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), s["near"].alias("near")))


def _entity(kind: Column, match: Column) -> Column:
    """An entity whatever its spelling: cards and phones by their digits, addresses in lower case."""
    return F.when(kind.isin("card", "phone"), _digits(match)).otherwise(F.lower(match))


def _terms(text: Column) -> Column:
    """The distinct words of a text, without the marks around them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def disclosing_terms(texts: DataFrame, rule: Disclosure) -> DataFrame:
    """term: the words that disclose an entity. texts: distinct texts (saved), as __key, __text and contexts (kind, entity, words near a mention).

    p(c), p(t), p(c, t): shares of the distinct texts.
    """
    mention = F.struct(F.xxhash64("m.kind", "m.entity").alias("c"), F.xxhash64("m.words").alias("context"), F.col("m.entity").alias("entity"))
    places = texts.where(F.size("contexts") > 0).select("__key", F.explode("contexts").alias("m")).select("__key", mention.alias("m")).select("__key", "m.*").distinct()
    # an entity of fewer contexts has no term
    entities = places.groupBy("c").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("__key").alias("mentions")).where(F.col("contexts") >= rule.contexts)
    entities = saved(entities.select("c", "mentions"), "entities")
    if not entities.limit(1).count():
        return texts.select(F.col("__text").alias("term")).limit(0)
    own = F.transform("contexts", lambda m: F.struct(F.xxhash64(m["kind"], m["entity"]).alias("c"), F.xxhash64(m["words"]).alias("context"), m["entity"].alias("entity")))
    inside = texts.where(F.size("contexts") > 0).select("__text", F.explode(F.array_distinct(own)).alias("m")).select("__text", "m.*")
    inside = inside.join(small(entities.select("c")), "c").groupBy("c", "entity", "__text").agg(F.collect_set("context").alias("at"))
    each = inside.select("c", "entity", "at", F.explode(_terms(F.col("__text"))).alias("term"))
    # parts of the entity itself are no evidence
    each = each.where(~F.contains("entity", F.lower("term")) & ~F.contains(F.lower("term"), F.col("entity")))
    # a text counts with the first of its contexts; sums by context come first, so that frequent entities are spread
    by_context = each.select("c", "term", F.posexplode("at").alias("k", "context")).groupBy("c", "term", "context").agg(F.count_if(F.col("k") == 0).alias("texts"))
    pairs = by_context.groupBy("c", "term").agg(F.count("*").alias("contexts"), F.sum("texts").alias("together")).where(F.col("contexts") >= rule.contexts)
    pairs = saved(pairs.join(small(entities), "c"), "pairs")
    if not pairs.limit(1).count():
        return pairs.select("term")
    # counted before the join: a candidate may be one of the most frequent words
    held = texts.select(F.explode(_terms(F.col("__text"))).alias("term")).groupBy("term").agg(F.count("*").alias("held"))
    share = lambda n: n / F.lit(float(texts.count()))
    pmi = F.log(share(F.col("together")) / (share(F.col("mentions")) * share(F.col("held"))))
    return pairs.join(held, "term").where(pmi >= rule.threshold * -F.log(share(F.col("mentions")))).select("term").distinct()


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """__key, added: the spans of the terms, without the marks around them, in each distinct text (__key, __text) that has some."""
    hit = texts.select("__key", F.explode(_terms(F.col("__text"))).alias("term")).join(small(terms), "term")
    hit = saved(hit.groupBy("__key").agg(F.collect_set("term").alias("terms")), "hit")
    spans = _spans(F.col("__text"), "term", TERM, lambda m: F.array_contains("terms", m))
    return texts.join(small(hit), "__key").select("__key", spans.alias("added"))


def find_personal_data(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: Disclosure = Disclosure()) -> DataFrame:
    """The columns of `keep`, base (spans of the patterns) and spans (with disclosing terms) for each row of df.

    A span is start, end, kind, match, near (words around it, of base spans). Terms that overlap a base span are left out.
    """
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    texts = rows.select(_key().alias("__key"), "__text").dropDuplicates(["__key"]).withColumn("base", base_spans(F.col("__text"), rule.near))
    near = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), _entity(s["kind"], s["match"]).alias("entity"), s["near"].alias("words")))
    texts = saved(texts.withColumn("contexts", near), "base")
    terms = saved(disclosing_terms(texts, rule), "terms")
    rows = rows.select(*keep, _key().alias("__key"))
    base = texts.select("__key", "base")
    if not terms.limit(1).count():
        return rows.join(base, "__key").select(*keep, "base", F.col("base").alias("spans"))
    out = base.join(small(saved(term_spans(texts, terms), "added")), "__key", "left")
    apart = F.filter("added", lambda t: F.forall("base", lambda s: (t["end"] <= s["start"]) | (s["end"] <= t["start"])))
    out = out.select("__key", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", apart))).alias("spans"))
    return rows.join(out, "__key").select(*keep, "base", "spans")


def _key() -> Column:
    """Tells texts apart."""
    return F.struct(F.xxhash64("__text").alias("a"), F.xxhash64(F.lit(1), "__text").alias("b"))


def sanitise(text: Column, spans: Column) -> Column:
    """text with each span generalised to its kind, as in [EMAIL]."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
