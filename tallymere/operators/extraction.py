"""Document extraction as specified for prospectuses: classification, location, evidence, rules, ladder, canonical merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Precedence of document types, phrases that tell them in order of priority, headings of sections, words that a section must hold.
PRECEDENCE = {"ADDENDUM": 4, "PROSPECTUS": 3, "RHP": 2, "DRHP": 1}
HEADINGS = {
    "capital_structure": ["CAPITAL STRUCTURE"],
    "offer_structure": ["OFFER STRUCTURE", "ISSUE STRUCTURE", "TERMS OF THE OFFER", "TERMS OF THE ISSUE"],
    "basis_for_price": ["BASIS FOR OFFER PRICE", "BASIS FOR ISSUE PRICE"],
    "objects": ["OBJECTS OF THE OFFER", "OBJECTS OF THE ISSUE"],
    "promoters": ["OUR PROMOTERS", "PROMOTERS AND PROMOTER GROUP"],
    "financials": ["RESTATED FINANCIAL STATEMENTS", "RESTATED FINANCIAL INFORMATION", "FINANCIAL STATEMENTS"],
}
TYPE_PHRASES = [("DRAFT RED HERRING", "DRHP"), ("RED HERRING PROSPECTUS", "RHP"), ("PROSPECTUS", "PROSPECTUS"), ("ADDENDUM", "ADDENDUM"), ("CORRIGENDUM", "ADDENDUM")]
ANCHORS = {"capital_structure": ["PROMOTER", "EQUITY SHARES"]}
NOT_EXPECTED = {
    "DRHP": ["price_band", "lot_size", "open_date", "close_date", "listing_date", "anchor"],
    "RHP": ["final_price", "total_subscription"],
    "PROSPECTUS": [],
}


def document_type(first_pages: Column) -> Column:
    """Type by the first phrase of the priority list that the first pages hold."""
    t = F.upper(first_pages)
    return F.coalesce(*[F.when(t.contains(phrase), F.lit(kind)) for phrase, kind in TYPE_PHRASES])


def expected(field: Column, doc_type: Column) -> Column:
    """Whether a field can be in a document of a type."""
    out = F.lit(True)
    for kind, absent in NOT_EXPECTED.items():
        out = F.when(doc_type == kind, ~field.isin(absent) if absent else F.lit(True)).otherwise(out)
    return out


def token_sort(c: Column) -> Column:
    words = F.array_remove(F.split(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "), " "), "")
    return F.array_join(F.array_sort(words), " ")


def heading_section(title: Column, least: float = 0.82) -> tuple[Column, Column]:
    """Section whose heading is most similar to a title, and the similarity (edit distance of sorted words); null below ``least``."""
    t = token_sort(title)
    options = [(section, token_sort(F.lit(alias))) for section, aliases in HEADINGS.items() for alias in aliases]
    scored = F.array(*[F.struct((1 - F.levenshtein(t, a) / F.greatest(F.length(t), F.length(a), F.lit(1))).alias("score"), F.lit(s).alias("section")) for s, a in options])
    best = F.array_max(scored)
    return F.when(best["score"] >= least, best["section"]), F.when(best["score"] >= least, best["score"])


# Fixed value: a title, dots, and a page number.
CONTENTS_LINE = r"^(.{4,80}?)\.{3,}\s*(\d{1,3})$"


def contents_lines(page: Column) -> Column:
    """Array of (title, page) from a printed table of contents."""
    lines = F.filter(F.split(page, "\n"), lambda x: x.rlike(CONTENTS_LINE))
    title, number = (lambda x: F.trim(F.regexp_extract(x, CONTENTS_LINE, 1))), (lambda x: F.regexp_extract(x, CONTENTS_LINE, 2).cast("int"))
    return F.transform(lines, lambda x: F.struct(title(x).alias("title"), number(x).alias("page")))


def page_offset(lines: DataFrame, pages: DataFrame, key: str, head: int = 300) -> DataFrame:
    """Difference of page index and printed number for each document, from its earliest title in print that opens a page.

    ``lines``: key, title, page (as printed); ``pages``: key, index, text. Documents without such a page are absent.
    """
    met = lines.join(pages, key).where(F.contains(F.upper(F.substring("text", 1, head)), F.upper("title")))
    return met.groupBy(key).agg(F.min(F.struct("page", "index")).alias("m")).select(key, (F.col("m.index") - F.col("m.page")).cast("long").alias("offset"))


def section_verified(section: str, text: Column) -> Column:
    out = F.lit(True)
    for word in ANCHORS.get(section, []):
        out = out & F.upper(text).contains(word)
    return out


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))


def evidence_found(text: Column, quote: Column, least: int = 8) -> Column:
    """The quote, of at least ``least`` characters, stands in the text, white space and case aside."""
    return F.coalesce((F.length(plain(quote)) >= least) & F.contains(plain(text), plain(quote)), F.lit(False))


def band_rule(low: str, high: str) -> Column:
    return (F.col(low) < F.col(high)) & (F.col(high) <= F.col(low) * 1.25)


def application_rule(lot: str, high: str) -> Column:
    return (F.col(lot) * F.col(high)).between(13000, 16000)


def shareholding_rule(shares: str) -> Column:
    return F.abs(F.aggregate(F.col(shares), F.lit(0.0), lambda total, x: total + x) - 100) <= 0.5


def dates_rule(opened: str, closed: str, listed: str) -> Column:
    return (F.col(opened) < F.col(closed)) & (F.col(closed) < F.col(listed)) & (F.datediff(F.col(listed), F.col(opened)) <= 15)


def issue_rule(fresh: str, sale: str, total: str) -> Column:
    return F.abs(F.col(fresh) + F.col(sale) - F.col(total)) <= F.abs(F.col(total)) * 0.01


def face_value_rule(value: str) -> Column:
    return F.col(value).isin(1, 2, 5, 10)


def first_failure(value: Column, evidence: Column, schema_ok: Column, rules_ok: Column) -> Column:
    """What rejects a field first: null value, evidence, schema, rules; null if nothing does."""
    return F.when(value.isNull(), "null").when(~evidence, "evidence").when(~schema_ok, "schema").when(~rules_ok, "rules")


def first_layer(rows: DataFrame, field: str, compared: int = 2) -> DataFrame:
    """Of validated values (field, layer, value), the one of the first layer, and whether the first ``compared`` layers disagree."""
    return rows.groupBy(field).agg(F.min_by("value", "layer").alias("value"), (F.count_distinct(F.when(F.col("layer") <= compared, F.col("value"))) > 1).alias("disputed"))


def canonical_value(rows: DataFrame, key: str) -> DataFrame:
    """Of values (key, doc_type, processed_at, value), that of the highest type, then of the latest document."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in PRECEDENCE.items() for x in pair]), F.col("doc_type"))
    return rows.where("value is not null").groupBy(key).agg(F.max_by("value", F.struct(rank.alias("rank"), "processed_at")).alias("value"))


def distinct_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each content, by its SHA-256: the first key."""
    coded = rows.select(key, F.sha2(F.col(content), 256).alias("code"))
    return coded.groupBy("code").agg(F.min(key).alias(key)).select(key, "code")


def layer_stats(rows: DataFrame) -> DataFrame:
    won = F.count_if("validated")
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("tried"), won.alias("won"), F.round(won / F.count(F.lit(1)), 6).alias("win_rate"))


# Share of each stage in a document's progress, in percent.
STAGE_WEIGHTS = [("fetch", 5), ("classify", 5), ("locate", 15), ("extract", 65), ("persist", 10)]


def progress(stage: Column, fields_done: Column, fields_total: Column) -> Column:
    """Percent of a document that is in a stage (``done`` after the last): all stages before it, and of extraction the share of fields that are settled."""
    before, out = 0, F.when(stage == "done", F.lit(100.0))
    for name, weight in STAGE_WEIGHTS:
        share = F.when(fields_total > 0, fields_done / fields_total).otherwise(0.0) * weight if name == "extract" else F.lit(0.0)
        out = out.when(stage == name, F.lit(float(before)) + share)
        before += weight
    return out


def resolve_reviews(reviews: DataFrame, answers: DataFrame, evidence: Column, schema_ok: Column, rules_ok: Column) -> DataFrame:
    """Open reviews (doc_hash, field, status, ...) with the answers given (doc_hash, field, value): resolved if the answer passes
    the checks that extracted values pass, else open with what rejects it. The checks are expressions over both tables' columns."""
    met = review_queue(reviews).join(answers, ["doc_hash", "field"], "left")
    answered = F.col("value").isNotNull()
    rejected = F.when(answered, first_failure(F.col("value"), evidence, schema_ok, rules_ok))
    return met.withColumns({"rejected_by": rejected, "status": F.when(answered & rejected.isNull(), "resolved").otherwise(F.col("status"))})


def completeness(rows: DataFrame, key: str) -> DataFrame:
    """Share of expected fields that are settled."""
    return rows.where("expected").groupBy(key).agg((F.count_if("settled") / F.count(F.lit(1))).alias("completeness"))


def janitor(files: DataFrame, documents: DataFrame, now: str, max_age_days: int = 30) -> DataFrame:
    """Files to delete: without a document, of a document in a final state, or too old."""
    met = files.join(documents.select("doc_hash", F.col("state").alias("_state")), "doc_hash", "left")
    old = F.datediff(F.lit(now).cast("date"), F.col("stored_at").cast("date")) > max_age_days
    reason = F.when(F.col("_state").isNull(), "orphan").when(F.col("_state").isin("done", "failed"), "final").when(old, "age")
    return met.withColumn("reason", reason).where("reason is not null").drop("_state")


def review_queue(reviews: DataFrame, status: str = "open") -> DataFrame:
    w = Window.partitionBy("doc_hash", "field").orderBy(F.col("at").desc())
    return reviews.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").where(F.col("status") == status)
