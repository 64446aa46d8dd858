"""Assembly of a dataset from its relations: cards of cases, attempts and decisions, and the counts over them.

The relations are tagged, put one under another and dealt once by document; everything that a card needs of its document
is then a window over that document's rows, so eleven joins are one exchange and one sort, and no relation has to be
small. What a window gathers into arrays (spans, reviews, approvals, findings) belongs to one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .extraction import card_status

SPAN = "struct<field:string,start:int,stop:int,quote:string>"
#: The columns of each relation beside doc_id.
RELATIONS = {
    "documents": "source_platform string, source_type string, source_name string, source_url string, canonical_url string, author_key string, development boolean, holdout boolean",
    "audits": "audit string",
    "links": "canonical_doc_id string, review_state string",
    "labels": "human_scope string, human_reason string",
    "relevance": f"scope_class string, reason_code string, technical_state string, validation_state string, evidence array<{SPAN}>",
    "reviews": "case_id string, state string",
    "inputs": "technical_state string, scope_class string",
    "failures": "diagnostic string",
    "candidates": f"case_id string, problem_summary string, evidence array<{SPAN}>",
    "cases": "case_id string, validation_state string, scope_class string, problem_summary string",
    "spans": "case_id string, field string, start int, stop int, quote string, state string",
    "corrections": "case_id string, field string",
    "findings": "case_id string, code string",
}
AROUND, EXCERPT_CAP, VALID, OUT_OF_SCOPE = 160, 480, "valid", "out_of_scope"
CONFIRMED = ("auto_confirmed", "human_confirmed")
WINDOWED, CAPPED = "validated_span_window", "capped_audit_not_a_validated_window"


def tagged(relations: dict[str, DataFrame]) -> DataFrame:
    """All rows of all relations: doc_id, the relation's name, and its own columns as a struct. Rows without a document are left out."""
    unknown = set(relations) - set(RELATIONS)
    if unknown or "documents" not in relations:
        raise ValueError(f"documents are needed, {sorted(unknown)} are not known")
    parts = []
    for name, columns in RELATIONS.items():
        if name in relations:
            own = F.struct(*[F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]).alias(c.split(" ")[0]) for c in _split(columns)])
            parts.append(relations[name].where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(name).alias("relation"), own.alias(name)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    absent = [n for n in RELATIONS if n not in relations]
    return rows.withColumns({n: F.lit(None).cast(f"struct<{RELATIONS[n].replace(' ', ':').replace(',:', ',')}>") for n in absent}) if absent else rows


def _split(columns: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(columns[last:i].strip())
            last = i + 1
    return [*out, columns[last:].strip()]


def assembled(relations: dict[str, DataFrame], policy: str = "development_only") -> DataFrame:
    """``tagged`` rows with their document's record in ``of``; of rows that repeat a document, an audit or a label the largest counts.

    ``of.used`` says whether the policy lets the document in: ``development_only``, ``outside_frozen_split`` or ``all``; held
    out documents never are.
    """
    by = Window.partitionBy("doc_id")
    here = lambda name: F.col("relation") == name

    def top(column: str) -> Column:
        return F.max(column).over(by)

    def gathered(when: Column, what: Column) -> Column:
        return F.collect_set(F.when(when, what)).over(by)

    doc = F.max("documents").over(by)
    record = F.struct(
        doc.alias("document"),
        top("audits.audit").alias("audit"),
        top("labels").alias("label"),
        top("failures.diagnostic").alias("diagnostic"),
        top("candidates").alias("candidate"),
        F.max(here("inputs")).over(by).alias("tried"),
        F.max(here("cases")).over(by).alias("has_case"),
        F.coalesce(F.max(here("failures") | (here("inputs") & ~F.coalesce(F.col("inputs.technical_state"), F.lit("")).isin("ok", ""))).over(by), F.lit(False)).alias("failed"),
        F.min(F.nullif("relevance.scope_class", F.lit(""))).over(by).alias("scope"),
        F.max(F.when(F.col("links.review_state").isin(*CONFIRMED), F.col("links.canonical_doc_id"))).over(by).alias("canonical"),
        gathered(here("spans") & (F.col("spans.state") == VALID), F.col("spans")).alias("spans"),
        gathered(here("corrections") & (F.col("corrections.field") == "semantic_approval"), F.col("corrections.case_id")).alias("approved"),
        gathered(here("reviews") & (F.col("reviews.state") == "open"), F.coalesce("reviews.case_id", F.lit(""))).alias("open"),
        gathered(here("findings"), F.col("findings")).alias("findings"),
    )
    rows = tagged(relations).select("*", record.alias("of"))
    dev, held = F.coalesce("of.document.development", F.lit(False)), F.coalesce("of.document.holdout", F.lit(False))
    fits = {"development_only": dev, "outside_frozen_split": ~dev, "all": F.lit(True)}[policy]
    return rows.withColumn("used", F.col("of.document").isNotNull() & ~held & fits)


def _located(audit: Column, spans: Column) -> Column:
    """The spans whose quote stands at their place, in order."""
    return F.array_sort(F.filter(spans, lambda s: (s["quote"] != "") & (F.substring(audit, s["start"] + 1, s["stop"] - s["start"]) == s["quote"])))


def cards(rows: DataFrame, dataset: str, run: str) -> DataFrame:
    """A row per card of ``assembled`` rows, by ``card``.

    ``case``: a valid case with a span that stands in its document's masked text. ``attempt``: what else was tried, of kind
    ``failed``, ``empty_response`` or ``stored_case_without_matching_span``. ``relevance``: a relevance decision. Spans are
    rebased to the excerpt; without one the excerpt is the head of the text. Claimed quotes that don't stand there are in
    ``rejected``. Only an approved case without a finding enters conclusions.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    is_case, is_input, is_relevance = (F.col("relation") == n for n in ("cases", "inputs", "relevance"))
    own_case = F.when(is_case, F.col("cases.case_id")).when(is_input, F.col("of.candidate.case_id"))
    of_case = F.transform(F.filter("of.spans", lambda s: s["case_id"] == F.col("cases.case_id")), lambda s: F.struct(s["field"].alias("field"), s["start"].alias("start"), s["stop"].alias("stop"), s["quote"].alias("quote")))
    claimed = F.coalesce(F.when(is_case, of_case).when(is_relevance, F.col("relevance.evidence")).otherwise(F.col("of.candidate.evidence")), none)
    state = F.coalesce("inputs.technical_state", F.lit(""))
    wanted = is_relevance | is_case | (is_input & ~(F.col("of.has_case") & (state == "ok")))
    got = rows.where(F.col("used") & wanted).select("*", own_case.alias("own_case"), F.coalesce("of.audit", F.lit("")).alias("text"), claimed.alias("claimed"), state.alias("state"))
    got = got.withColumn("good", _located(F.col("text"), F.col("claimed")))
    got = got.withColumn("window", text.window(F.col("text"), F.transform("good", lambda s: s["start"]), F.transform("good", lambda s: s["stop"]), AROUND))
    some = F.size("good") > 0
    public = is_case & (F.coalesce("cases.validation_state", F.lit("")) == VALID) & some
    card = F.when(is_relevance, "relevance").when(public, "case").otherwise("attempt")
    kind = F.when(card == "attempt", F.when(is_case, "stored_case_without_matching_span").when(state == "ok", "empty_response").otherwise("failed"))
    concerns = lambda case: F.coalesce((case == F.col("own_case")), F.lit(False))
    n_findings = F.size(F.filter("of.findings", lambda f: f["case_id"].isNull() | concerns(f["case_id"])))
    n_open = F.size(F.filter("of.open", lambda c: (c == "") | concerns(c)))
    noted = F.coalesce(F.array_contains("of.approved", F.col("own_case")), F.lit(False)) & ~is_relevance
    approved = noted & F.when(card == "case", n_findings == 0).otherwise(F.lit(True))
    valid = F.when(is_relevance, F.coalesce(F.col("relevance.validation_state") == VALID, F.lit(False))).otherwise(card == "case")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rebased = F.transform("good", lambda s: F.struct(s["field"].alias("field"), (s["start"] - F.col("window.offset")).alias("start"), (s["stop"] - F.col("window.offset")).alias("stop"), s["quote"].alias("quote")))
    return got.select(
        F.lit(dataset).alias("dataset_id"),
        F.lit(run).alias("run_id"),
        card.alias("card"),
        kind.alias("kind"),
        "doc_id",
        F.col("own_case").alias("case_id"),
        F.coalesce("of.canonical", "doc_id").alias("canonical_doc_id"),
        F.coalesce("relevance.technical_state", "inputs.technical_state", F.lit("")).alias("technical_state"),
        *[F.coalesce(f"of.document.{c}", F.lit("")).alias(c) for c in ("source_platform", "source_type", "source_name", "source_url")],
        F.coalesce(F.nullif("of.document.canonical_url", F.lit("")), "of.document.source_url", F.lit("")).alias("canonical_url"),
        F.nullif("of.document.author_key", F.lit("")).alias("author_key"),
        F.when(some, F.col("window.text")).otherwise(F.substring("text", 1, EXCERPT_CAP)).alias("excerpt"),
        F.when(some, F.col("window.offset")).otherwise(0).alias("excerpt_start"),
        F.when(some, WINDOWED).otherwise(CAPPED).alias("excerpt_kind"),
        rebased.alias("spans"),
        F.when(card == "attempt", F.array_sort(F.array_distinct(F.transform(F.array_except("claimed", "good"), lambda s: s["quote"])))).otherwise(F.array().cast("array<string>")).alias("rejected"),
        empty("of.label.human_scope").alias("human_relevance_label"),
        empty("of.label.human_reason").alias("human_reason_code"),
        F.coalesce("cases.scope_class", "relevance.scope_class", "inputs.scope_class", F.lit("")).alias("model_scope_class"),
        F.when(is_relevance, "").otherwise(empty("of.scope")).alias("model_relevance_scope"),
        F.when(is_case, empty("cases.problem_summary")).when(is_input, empty("of.candidate.problem_summary")).otherwise("").alias("problem_summary"),
        F.when(is_input, empty("of.diagnostic")).otherwise("").alias("diagnostic"),
        n_findings.alias("n_findings"),
        valid.alias("automatically_valid"),
        approved.alias("semantically_approved"),
        (approved & (card == "case")).alias("enters_conclusions"),
        F.when(is_relevance, "relevance decision only").otherwise(card_status(card == "case", approved, n_findings, n_open)).alias("review_status"),
    )


def dataset_counts(rows: DataFrame) -> DataFrame:
    """One row of counts over ``assembled`` rows, all from one pass."""
    at = lambda name: F.col("used") & (F.col("relation") == name)
    # A document's facts stand at each of its rows; they are counted at its own one.
    doc, held = at("documents"), (F.col("relation") == "documents") & F.coalesce("of.document.holdout", F.lit(False))
    human, model = F.coalesce("of.label.human_scope", F.lit("")), F.coalesce("of.scope", F.lit(""))
    good = _located(F.coalesce("of.audit", F.lit("")), F.transform(F.filter("of.spans", lambda s: s["case_id"] == F.col("cases.case_id")), lambda s: F.struct(s["field"].alias("field"), s["start"].alias("start"), s["stop"].alias("stop"), s["quote"].alias("quote"))))
    exported = at("cases") & (F.col("cases.validation_state") == VALID) & (F.size(good) > 0)
    state = F.coalesce("inputs.technical_state", F.lit(""))
    counts = {
        "documents": doc,
        "withheld_documents": held,
        "outside_policy_documents": (F.col("relation") == "documents") & ~F.col("used") & ~F.coalesce("of.document.holdout", F.lit(False)),
        "human_labeled_documents": doc & F.col("of.label").isNotNull(),
        "human_labeled_out_of_scope": doc & (human == OUT_OF_SCOPE),
        "excluded_documents": doc & (F.when(human != "", human).otherwise(model) == OUT_OF_SCOPE),
        "undecided_documents": doc & (human == "") & (model == ""),
        "failed_documents": doc & F.col("of.failed"),
        "documents_with_case": doc & F.col("of.has_case"),
        "confirmed_duplicate_links": at("links") & F.col("links.review_state").isin(*CONFIRMED),
        "pending_duplicate_links": at("links") & (F.col("links.review_state") == "pending_review"),
        "model_relevance_attempts": at("relevance"),
        "model_relevance_out_of_scope": at("relevance") & (F.col("relevance.technical_state") == "ok") & (F.col("relevance.scope_class") == OUT_OF_SCOPE),
        "extraction_attempts": at("inputs"),
        "successful_attempts": at("inputs") & (state == "ok"),
        "failed_attempts": at("inputs") & (state != "ok"),
        "empty_responses": at("inputs") & (state == "ok") & ~F.col("of.has_case"),
        "extraction_failures": at("failures"),
        "stored_cases": at("cases"),
        "automatically_valid_cases": exported,
        "cases_without_matching_span": at("cases") & ~F.coalesce(exported, F.lit(False)),
        "semantically_approved_cases": exported & F.array_contains("of.approved", F.col("cases.case_id")) & ~F.exists("of.findings", lambda f: f["case_id"].isNull() | (f["case_id"] == F.col("cases.case_id"))),
        "unresolved_review_items": at("reviews") & (F.col("reviews.state") == "open"),
        "recorded_findings": at("findings"),
        "corrections": at("corrections"),
    }
    distinct = F.count_distinct(F.when(doc, F.coalesce("of.canonical", "doc_id")))
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()], distinct.alias("analysis_documents"))


def state_counts(rows: DataFrame) -> DataFrame:
    """(name, value, n): extraction attempts by technical state and relevance decisions that came through by scope."""
    known = F.col("used") & ((F.col("relation") == "inputs") | ((F.col("relation") == "relevance") & (F.col("relevance.technical_state") == "ok")))
    value = F.when(F.col("relation") == "inputs", F.col("inputs.technical_state")).otherwise(F.col("relevance.scope_class"))
    name = F.when(F.col("relation") == "inputs", "extraction_by_state").otherwise("model_relevance_by_scope")
    return rows.where(known).groupBy(name.alias("name"), F.coalesce(F.nullif(value, F.lit("")), F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))
