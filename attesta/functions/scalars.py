"""Scalar functions: Column expressions where Spark has the parts, Arrow functions for NFKC, case folding and transpositions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_CUES, EVIDENCE_CUES = ("correct", "withdraw", "dispute", "allege"), ("assert", "change", "correct")
SINGLE_FORMS, MULTI_FORMS = ("value", "not_value", "belief_of"), ("member", "not_member", "enumeration", "belief_of")
DECLARED = {"employer": "single_changeable", "birthplace": "single_stable", "tags": "multi_set", "hq_city": "single_changeable", "work_city": "derived"}


def problems() -> Column:
    """Names of the well-formedness rules a report breaks, joined by commas."""
    cue, target = F.col("cue"), F.col("target")
    return F.concat_ws(
        ",",
        F.when(cue.isin(*TARGET_CUES) & target.isNull(), "target_required"),
        F.when(cue.isin("assert", "change") & target.isNotNull(), "target_forbidden"),
        F.when(target == F.col("lsn"), "self_target"),
        F.when(cue.isin(*EVIDENCE_CUES) & F.col("value").isNull(), "proposition_required"),
        F.when(F.col("change_from").isNotNull() & (cue != "change"), "change_from"),
    )


def form_fits(form: Column, attr: Column) -> Column:
    return F.when(attr == "tags", form.isin(*MULTI_FORMS)).otherwise(form.isin(*SINGLE_FORMS))


def refused(attr: Column) -> Column:
    """Why evidence on an attribute is refused, or null."""
    derived = [a for a, c in DECLARED.items() if c == "derived"]
    return F.when(attr.isin(*derived), "derived").when(~attr.isin(*DECLARED), "undeclared")


@F.pandas_udf(T.StringType())
def normalise(s: pd.Series) -> pd.Series:
    """NFKC, blanks collapsed, case folded."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which a swap of neighbours counts once."""

    def one(x: str, y: str) -> int:
        older, row = None, list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            new = [i]
            for j, cy in enumerate(y, 1):
                best = min(row[j] + 1, new[-1] + 1, row[j - 1] + (cx != cy))
                if older is not None and j > 1 and cx == y[j - 2] and x[i - 2] == cy:
                    best = min(best, older[j - 2] + 1)
                new.append(best)
            older, row = row, new
        return row[-1]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def json_text(col: Column) -> Column:
    """A string as JSON: quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def canonical_proposition() -> Column:
    v = json_text(F.col("value"))
    inner = F.concat(F.lit('{"form":"value","v":'), v, F.lit("}"))
    belief = F.concat(F.lit('{"form":"belief_of","holder":'), json_text(F.col("holder")), F.lit(',"proposition":'), inner, F.lit("}"))
    return F.when(F.col("form") == "belief_of", belief).otherwise(F.concat(F.lit('{"form":'), json_text(F.col("form")), F.lit(',"v":'), v, F.lit("}")))


def candidate_id() -> Column:
    """SHA-256 of the canonical JSON of key and form."""
    form = F.concat(F.lit('{"form":"value","value":'), json_text(F.col("value")), F.lit("}"))
    key = F.concat(F.lit('{"attr":'), json_text(F.col("attr")), F.lit(',"entity":'), json_text(F.col("entity")), F.lit("}"))
    return F.sha2(F.concat(F.lit('{"form":'), form, F.lit(',"key":'), key, F.lit("}")), 256)


def derived_id(*parts) -> Column:
    """A stable id of 26 characters from its parts; recomputing gives the same."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 26)


def stated_date(raw: Column) -> tuple[Column, Column]:
    """(first day, precision) of YYYY, YYYY-MM or YYYY-MM-DD, null for anything else."""
    day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).when(raw.rlike(r"^\d{4}-\d{2}$"), F.concat(raw, F.lit("-01"))).when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01")))
    precision = F.when(F.length(raw) == 10, "day").when(F.length(raw) == 7, "month").otherwise("year")
    return day, F.when(day.isNotNull(), precision)


def principal(actor: Column) -> tuple[Column, Column]:
    """(kind, name) of a typed principal, empty if it is not one."""
    pattern = "^(agent|user|connector|system):(.+)$"
    return F.regexp_extract(actor, pattern, 1), F.regexp_extract(actor, pattern, 2)


def strict_json(text: Column, required: tuple[str, ...], optional: tuple[str, ...]) -> tuple[Column, Column]:
    """(all required fields are there, unknown fields joined by commas)."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    need = F.array(*[F.lit(k) for k in required])
    known = F.array(*[F.lit(k) for k in (*required, *optional)])
    return F.size(F.array_except(need, keys)) == 0, F.array_join(F.array_sort(F.array_except(keys, known)), ",")


def ngrams(s: Column, n: int = 3) -> Column:
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    last = F.length(padded) - n + 1
    return F.when(last < 1, F.array(padded)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))))


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def span_supported(text: Column, span: Column) -> Column:
    """Whether a quote occurs in a text, whatever its blanks and case."""

    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"[ \t\n\r]+", " "))

    return F.contains(plain(text), plain(span))


def recovered_json(raw: Column) -> Column:
    """The one JSON object inside a fence or prose."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


CLAIM_FIELDS = ("cue", "entity", "attr", "proposition", "valid_from", "valid_to", "target_hint", "span")


def claim_fixture(events: DataFrame) -> DataFrame:
    """event_id, text, raw: a claim in JSON per event, some of them malformed on purpose."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    span = F.when(k % 11 == 0, "nowhere").otherwise(F.col("event_type"))
    raw = F.concat(
        F.lit('{"cue":"assert","entity":"u'), F.col("user_id").cast("string"), F.lit('","attr":"employer","proposition":{"form":"value","value":"x"}'),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(',"span":"'), span, F.lit('"'))), F.when(k % 5 == 0, ',"source":"s0"').otherwise(""), F.lit("}"),
    )
    return events.select("event_id", F.concat(F.lit("they said "), "event_type").alias("text"), raw.alias("raw"))


def decode_claims(claims: DataFrame) -> DataFrame:
    """event_id, cue, entity, attr, rejected: the first reason against a claim, or null."""
    keys = F.json_object_keys("raw")
    known = F.array(*[F.lit(k) for k in CLAIM_FIELDS])
    span = F.get_json_object("raw", "$.span")
    unexpected = F.size(F.array_except(keys, known)) > 0
    needed = F.size(F.array_except(F.array(F.lit("cue"), F.lit("entity"), F.lit("attr")), keys)) > 0
    why = (
        F.when(keys.isNull(), "invalid_json").when(unexpected, "unexpected_field").when(needed, "invalid_claim").when(span.isNull() | (F.trim(span) == ""), "missing_span")
        .when(~span_supported(F.col("text"), span), "unsupported_span")
    )
    return claims.select("event_id", *[F.get_json_object("raw", f"$.{c}").alias(c) for c in ("cue", "entity", "attr")], why.alias("rejected"))
