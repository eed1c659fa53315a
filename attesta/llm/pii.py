"""Personal data by pattern, and terms that reveal it by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern over the whole text.
The values of the base spans are the protected entities. For each entity e and each term t (word, folded to lower case)
the corpus is asked in how many documents t stands anywhere beside e, in how many t and e
occur at all, and how strongly t reveals e: PMI(e; t) over the information IC(e) of e, 1 if t occurs only where e does.
A term seen with e in at least ``SUPPORT`` different texts whose strength reaches ``STRENGTH`` discloses e; all its occurrences, in
documents with e or without, become spans of kind ``term`` (removed by ``sanitise`` as base spans are, generalised to the name of their kind).

Nulls: a null text is empty and has no spans. Repeated rows each get their spans. Empty tables give no rows. Other columns of any
name pass through. Patterns are written without backtracking over long runs, and places are running sums over rows, so
very long texts and texts of many spans cost time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, STRENGTH = 3, 0.9

# A match starts where no longer one could have started: not inside a run of the first class, unless the last match ended there.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Two code points that are no characters, set around matches.
MARKS = "\ufdd0\ufdd1"
BLANK = r"[\x20\x09-\x0D]+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(at, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _tests(text: Column) -> dict[str, tuple[str, Column]]:
    """Pattern of each kind and a cheap test that holds wherever the pattern can match."""
    return {"email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), "phone": (PHONE, F.contains(text, F.lit("+")))}


def pieces(text: Column) -> Column:
    """Array of (k, parts): for each kind with a valid match the text cut at all matches, so that every second part is one. Matches
    are set between two marks that the text cannot hold, and the text is split at the marks."""
    safe = F.translate(text, MARKS, "\ufffd\ufffd")
    made = []
    for i, (kind, (pattern, may)) in enumerate(_tests(text).items()):
        parts = F.split(F.regexp_replace(safe, f"({pattern})", f"{MARKS[0]}$1{MARKS[1]}"), f"[{MARKS}]")
        made.append(F.when(may, F.struct(F.lit(i).alias("k"), parts.alias("parts"))))
    held = F.filter(F.array(*made), lambda x: x.isNotNull())
    return F.filter(held, lambda x: F.exists(F.transform(x["parts"], lambda p, j: (j % 2 == 1) & _is(x["k"], p)), lambda hit: hit))


def _is(k: Column, part: Column) -> Column:
    """Whether a match of the kind with number ``k`` is valid."""
    out = F.lit(True)
    for i, kind in enumerate(KINDS[:4]):
        out = F.when(k == i, _valid(kind, part)).otherwise(out)
    return out


def base_spans(cut_up: DataFrame) -> DataFrame:
    """row_key, start, k, end, kind, value of every valid match; offsets in code points. ``cut_up`` has row_key and ``pieces``. Parts become rows
    and their places running sums of lengths, so the spans of a text cost in proportion to it, however many they are."""
    part = cut_up.select("row_key", F.explode("pieces").alias("x")).select("row_key", "x.k", F.posexplode("x.parts").alias("i", "value"))
    before = Window.partitionBy("row_key", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("start", F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)).cast("int")).where("i % 2 = 1")
    part = part.where(_is(F.col("k"), F.col("value")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("k") + 1)
    return part.select("row_key", "start", "k", (F.col("start") + F.length("value")).alias("end"), kind.alias("kind"), "value")


def words_at(texts: DataFrame) -> DataFrame:
    """row_key, start, end, term of every word; the places are sums of lengths, so a long text costs in proportion."""
    parts = texts.select("row_key", F.posexplode(F.split("text", r"[\x20\x09-\x0D]")).alias("i", "part"))
    before = Window.partitionBy("row_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("start", F.coalesce(F.sum(F.length("part") + 1).over(before), F.lit(0)).cast("int")).where("part != ''")
    return at.select("row_key", "start", (F.col("start") + F.length("part")).alias("end"), F.lower("part").alias("term"))


def free(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The words that touch no base span; others are not terms. One pass in order of place: a word touches a span if the furthest
    end of those that begin before the word ends lies behind the word's start."""
    both = words.select("row_key", "start", "end", "term", (F.col("end") - 1).alias("at"), F.lit(None).cast("int").alias("reach"))
    both = both.unionByName(spans.select("row_key", "start", "end", F.lit(None).cast("string").alias("term"), F.col("start").alias("at"), F.col("end").alias("reach")))
    far = F.max("reach").over(Window.partitionBy("row_key").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("far", far).where("term is not null and (far is null or far <= start)").select("row_key", "start", "end", "term")


def disclosing(plain: DataFrame, found: DataFrame, spans: DataFrame, support: int, strength: float) -> DataFrame:
    """The terms that disclose an entity, each once. Counts are of documents: copies of a text count as often as they come."""
    entity = spans.select("row_key", F.concat_ws(":", "kind", "value").alias("entity")).distinct().join(found.select("row_key", "copies"), "row_key")
    often = entity.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_entity")).where(F.col("texts") >= support)
    held = cut(entity.join(often.select("entity", "n_entity"), "entity"))
    some = held.select("row_key").distinct()
    texts = found.join(some, "row_key", "left_semi")
    # First all words of each text, once each and without places: what does not pass with those that touch a span does not without them.
    term = cut(texts.select("row_key", F.explode(F.array_distinct(F.split(F.lower("text"), BLANK))).alias("term")).where("term <> ''"))
    candidates = term.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("term")
    # In how many documents a term occurs: counts over the whole corpus, of the candidate terms alone.
    seen = plain.select(F.explode(F.array_distinct(F.split(F.lower("text"), BLANK))).alias("term"))
    seen = cut(semi(seen, cut(candidates), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    n = F.lit(plain.count())
    # no pair beyond this passes, as both <= n_entity; so common words meet no entity
    most = F.col("n_entity") * F.pow(n / F.col("n_entity").cast("double"), F.lit(1 - strength)) * (1 + 1e-9)

    def passing(term: DataFrame) -> DataFrame:
        pair = term.join(seen, "term").join(held, "row_key").where(F.col("n_term") <= most)
        pair = pair.groupBy("entity", "term", "n_term", "n_entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both")).where(F.col("texts") >= support)
        pmi = F.log(F.col("both") * n / (F.col("n_term") * F.col("n_entity")).cast("double"))
        info = F.log(n / F.col("n_entity").cast("double"))
        return pair.where((info > 0) & (pmi >= strength * info)).select("term").distinct()

    # Then only the texts with a term that may pass, word by word.
    may = cut(passing(term))
    near = cut(semi(term, may, "term").select("row_key").distinct())
    words = semi(words_at(semi(texts, near, "row_key")), may, "term")
    return passing(free(words, semi(spans, near, "row_key")).select("row_key", "term").distinct())


def detect(docs: DataFrame, support: int = SUPPORT, strength: float = STRENGTH) -> tuple[DataFrame, DataFrame]:
    """(row_key (md5 of the text), start, k, end, kind of every span of every different text; row_key, text of the texts with spans)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(text.alias("text"), F.unhex(F.md5(text)).alias("row_key"))
    hit = plain.where(_may_hold(F.col("text"))).withColumn("pieces", pieces(F.col("text"))).where(F.size("pieces") > 0)
    # The texts with base spans, each once: a small part of the corpus.
    found = cut(hit.groupBy("row_key").agg(F.first("text").alias("text"), F.first("pieces").alias("pieces"), F.count(F.lit(1)).alias("copies")))
    base = cut(base_spans(found))
    told = cut(disclosing(plain, found.select("row_key", "text", "copies"), base, support, strength))
    # The texts that hold a disclosing term, with an entity or without; only their words get places.
    told_in = semi(plain.select("row_key", F.explode(F.array_distinct(F.split(F.lower("text"), BLANK))).alias("term")), told, "term")
    told_in = cut(told_in.select("row_key").distinct())
    texts = cut(semi(plain, told_in, "row_key").groupBy("row_key").agg(F.first("text").alias("text")))
    terms = free(semi(words_at(texts), told, "term"), base.join(told_in, "row_key", "left_semi"))
    spans = base.select("row_key", "start", "k", "end", "kind").unionByName(terms.select("row_key", "start", F.lit(4).alias("k"), "end", F.lit("term").alias("kind")))
    every = found.select("row_key", "text").unionByName(texts.join(found, "row_key", "left_anti").select("row_key", "text"))
    return cut(spans), every


#: Bytes of keys (terms, or md5 of texts) up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def semi(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows with one of ``keys`` (a table that is written), whose size is asked first."""
    size = keys.agg(F.coalesce(F.sum(F.octet_length(on) + 32), F.lit(0))).first()[0]
    return rows.join(F.broadcast(keys) if size <= BROADCAST_BYTES else keys, on, "left_semi")


def _may_hold(text: Column) -> Column:
    return F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")) | text.rlike(r"[0-9](?:[\x20.-]?[0-9]){3}")


_SPANS = "array<struct<start:int,k:int,end:int,kind:string>>"


def with_spans(docs: DataFrame, **how) -> DataFrame:
    """row (struct of the document) and spans (ordered by start, then kind), empty without; every row of ``docs`` is kept."""
    spans, _ = detect(docs, **how)
    by = spans.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("spans"))
    return _keyed(docs).join(by, "row_key", "left").select("row", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("row_key"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of a block in which spans are replaced.
BLOCK = 1024


def replaced(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """row_key, clean: the texts with every span replaced by the name of its kind in brackets; overlapping spans become one, named by the
    first. A text is cut into blocks and a span into its parts in each, so that nothing is sought from the start of a long text."""
    order = Window.partitionBy("row_key").orderBy("start", "k", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    span = spans.withColumn("far", F.coalesce(far, F.lit(0)))
    # what an earlier span covers is gone already; only a span that begins outside shows its name
    span = span.where("end > far").withColumn("name", F.when(F.col("start") >= F.col("far"), F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).otherwise(""))
    span = span.withColumn("start", F.greatest("start", "far"))
    part = span.select("row_key", "start", "end", "name", F.explode(F.expr(f"sequence(cast(start div {BLOCK} as int), cast((end - 1) div {BLOCK} as int))")).alias("block"))
    first = F.col("start") >= F.col("block") * BLOCK
    part = part.select("row_key", "block", F.struct(
        F.when(first, F.col("start") - F.col("block") * BLOCK).otherwise(0).cast("int").alias("a"), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int").alias("b"), F.when(first, F.col("name")).otherwise("").alias("name")
    ).alias("s"))
    part = part.groupBy("row_key", "block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    block = texts.select("row_key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "raw"))
    got = block.join(part, ["row_key", "block"], "left")
    put = F.aggregate(
        F.coalesce("s", F.array().cast("array<struct<a:int,b:int,name:string>>")),
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["b"].alias("pos"), F.concat(a["out"], F.substring("raw", a["pos"] + 1, s["a"] - a["pos"]), s["name"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring("raw", a["pos"] + 1, F.lit(BLOCK))),
    )
    got = got.select("row_key", F.struct("block", put.alias("clean")).alias("x"))
    return got.groupBy("row_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["clean"]), "").alias("clean"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """The documents with every span replaced by the name of its kind in brackets; the columns of documents, ``n_chars`` counted again."""
    spans, texts = detect(docs, **how)
    by = cut(replaced(texts, spans))
    text = F.coalesce("clean", F.col("row.text"))
    got = _keyed(docs).join(by, "row_key", "left")
    cols = [text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return got.select(*cols)


def op10_disclosure(spark, sf_dir):
    got = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [count(kind) for kind in KINDS[:4]]
    return got.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), count("term"))
