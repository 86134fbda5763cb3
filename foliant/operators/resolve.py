"""How the chunks of a page resolve: from what was observed on the page, in the text layer and in crops, to status, content, evidence and
warnings (Q7, Q8, J5, N3, N20, N22).

``settled`` decides all chunks that need no crop, and says what the others ask of one; ``crop_results`` reads the attempts at those. Both are
joins on the page and plain expressions. Relations:

* ``chunks``: ``order, type, text, markdown, box`` (as the model gave it), ``reconciled, draft_fallback, specialist``
* ``pages``: ``mode`` (economy, balanced, audit), ``presegmented, reconciled_page, reconciliation_failed, scan_like, words`` (array of ``text``, ``box``)
* ``drafts``: ``seq, type, text, markdown, box`` of the first pass
* ``attempts``: ``order, attempt, text, markdown, box`` (within the crop), ``verdict, crop_box``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crop_to_page, overlap_over_smaller, parse_model_box
from ..functions.text import best_content, content_or_fallback, is_semantic_visual, needs_precision, normalize_text, trimmed, visual_placeholder
from .align import aligned_box
from .reconcile import FIGURES, agreeing

TEXT = "array<string>"


def _warnings(*given: str | Column) -> Column:
    """Array of names; those under a condition are null where it doesn't hold."""
    items = [F.lit(x) if isinstance(x, str) else x for x in given]
    return F.array_compact(F.array(*items)).cast(TEXT) if items else F.array().cast(TEXT)


def _say(status, method, text, markdown, warnings, source_pass, box) -> Column:
    lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.struct(
        lit(status).cast("string").alias("status"), lit(method).cast("string").alias("method"), lit(text).alias("text"), lit(markdown).alias("markdown"),
        warnings.alias("warnings"), lit(source_pass).alias("source_pass"), box.alias("box"),
    )


def _unless_audit(mode: Column) -> Column:
    return F.when(mode == "audit", "unresolved").otherwise("candidate")


def best_drafts(chunks: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """The draft that overlaps each chunk most, the first of equals; one without a usable box counts as lying under the chunk."""
    d = drafts.select(*keys, F.struct("seq", "type", "text", "markdown", parse_model_box(F.col("box")).alias("box")).alias("draft"))
    met = chunks.select(*keys, "order", "valid").join(d, keys)
    share = F.coalesce(overlap_over_smaller(F.col("valid"), F.col("draft.box")), F.lit(1.0))
    return met.groupBy(*keys, "order").agg(F.max_by("draft", F.struct(share, -F.col("draft.seq"))).alias("draft"))


def settled(chunks: DataFrame, pages: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks`` (keys, ``order``, ``type``) with ``said``, a struct ``status, method, text, markdown, warnings, source_pass, box``, or null and ``crop``, what a crop has
    to decide: ``type, text, markdown, box, source_pass, verified_pass`` (Q7). ``mode`` and ``scan_like`` are kept.

    In this order: text that the text layer has word for word; no usable box; regions that came ready; pages read a second time; modes
    without verification; else a crop."""
    c = chunks.join(pages, keys).withColumns({"text": F.coalesce("text", F.lit("")), "markdown": F.coalesce("markdown", F.lit("")), "valid": parse_model_box(F.col("box"))})
    c = c.withColumn("exact", aligned_box(F.col("text"), F.col("words"))).drop("words")
    may = c.where("reconciled_page and not reconciliation_failed and not draft_fallback and not specialist and valid is not null")
    parsed = drafts.withColumn("box", parse_model_box(F.col("box")))
    agreed = agreeing(may.select(*keys, F.col("order").alias("seq"), "type", "text", "markdown", F.col("valid").alias("box")), parsed, keys)
    c = c.join(agreed.select(*keys, F.col("seq").alias("order"), F.lit(True).alias("agreed")), [*keys, "order"], "left")
    c = c.join(best_drafts(c.where("reconciled_page and not specialist and valid is not null"), drafts, keys), [*keys, "order"], "left")

    mode, text, markdown, valid, draft = (F.col(x) for x in ("mode", "text", "markdown", "valid", "draft"))
    precise = (mode == "audit") & needs_precision(F.col("type"), text)
    stays = F.col("scan_like") & ((trimmed(text) != "") | (trimmed(markdown) != ""))
    fallback = content_or_fallback(text, markdown)
    clean = (normalize_text(text), normalize_text(markdown))
    single = _say("candidate", "vision_refined", text, markdown, _warnings("single_model_candidate"), "page_draft", valid)
    confirmed = (F.coalesce("agreed", F.lit(False)) | F.col("specialist") | ((mode == "audit") & F.col("reconciled"))) & ~precise
    said = (
        F.when(F.col("exact").isNotNull(), _say("verified", "text_layer_exact", text, markdown, _warnings(), "page_draft", F.col("exact")))
        .when(valid.isNull() & stays, _say(_unless_audit(mode), None, fallback["text"], fallback["markdown"], _warnings("invalid_draft_box", "scan_fallback_used"), "page_draft", valid))
        .when(valid.isNull(), _say("unresolved", None, "", "", _warnings("invalid_draft_box"), "page_draft", valid))
        .when(F.col("presegmented"), single)
        .when(F.col("reconciled_page") & confirmed, _say("verified", "vision_refined", *clean, _warnings(), "page_reconciliation", valid))
        .when(F.col("reconciled_page") & F.col("reconciliation_failed"), _say(_unless_audit(mode), "vision_refined", *clean, _warnings("page_reconciliation_failed"), "page_draft", valid))
        .when(~F.col("reconciled_page") & (mode == "economy"), single)
    )

    own_pass = F.when(~F.col("reconciled_page"), "page_draft").when(F.col("specialist"), "figure_reconciliation").otherwise("page_reconciliation")
    take = F.col("reconciled_page") & draft.isNotNull() & (~precise | (trimmed(F.coalesce(draft["text"], F.lit(""))) != "") | (trimmed(F.coalesce(draft["markdown"], F.lit(""))) != ""))
    pick = lambda name, other: F.when(take, draft[name]).otherwise(other)
    ask = F.struct(
        pick("type", F.col("type")).alias("type"), F.coalesce(pick("text", text), F.lit("")).alias("text"), F.coalesce(pick("markdown", markdown), F.lit("")).alias("markdown"),
        F.when(take & ~precise, F.coalesce(draft["box"], valid)).otherwise(valid).alias("box"), F.when(take, "page_draft").otherwise(own_pass).alias("source_pass"),
        F.when(F.col("reconciled_page") & precise, "precision_crop").otherwise("crop_verification").alias("verified_pass"),
    )
    return c.withColumn("said", said).select(*keys, "order", "type", "mode", "scan_like", "said", F.when(F.col("said").isNull(), ask).alias("crop"))


def crop_results(wanted: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (with ``crop`` of ``settled``) with ``said`` from the attempts at it, and ``calls``, their number (Q8).

    The first attempt that concludes decides: one without a usable box, or one that verifies readable content, whose centre may yet lie
    outside the chunk. If none does, they disagree; without any, the budget was spent."""
    w = wanted.select(*keys, "order", "mode", "scan_like", "crop")
    met = w.join(attempts, [*keys, "order"]).withColumn("inner", parse_model_box(F.col("box")))
    box, refined = F.col("crop.box"), F.col("refined")
    met = met.withColumn("refined", F.when(F.col("inner").isNotNull(), crop_to_page(F.col("crop_box"), F.col("inner"))))
    x, y = (refined["left"] + refined["right"]) / 2, (refined["top"] + refined["bottom"]) / 2
    inside = (x >= box["left"]) & (x <= box["right"]) & (y >= box["top"]) & (y <= box["bottom"])
    seen = F.coalesce("markdown", F.lit(""))
    readable = (F.col("verdict") == "verified") & (trimmed(seen) != "") & (~F.col("crop.type").isin(*FIGURES) | is_semantic_visual(seen))
    kind = F.when(F.col("inner").isNull(), "invalid_box").when(readable & inside, "verified").when(readable, "scope_drift")
    value = F.struct(F.coalesce("text", F.lit("")).alias("text"), seen.alias("markdown"), "refined", kind.alias("kind"))
    told = met.groupBy(*keys, "order").agg(F.min_by(value, F.when(kind.isNotNull(), F.col("attempt"))).alias("first"), F.max_by(value, "attempt").alias("last"), F.count(F.lit(1)).alias("calls"))
    c = w.join(told, [*keys, "order"], "left").withColumn("v", F.coalesce("first", "last"))

    mode, crop, v = F.col("mode"), F.col("crop"), F.col("v")
    best = best_content(crop["text"], crop["markdown"], v["text"], v["markdown"], crop["source_pass"])
    keep = (mode == "balanced") | (F.col("scan_like") & ((best["text"] != "") | (best["markdown"] != "")))
    scanned = F.when(F.col("scan_like"), "scan_fallback_used")
    kept = lambda warning, status: _say(status, "vision_refined", best["text"], best["markdown"], _warnings(warning, scanned), best["source_pass"], crop["box"])
    lost = lambda warning, at: _say("unresolved", "vision_refined", "", "", _warnings(warning), "page_draft", at)
    outcome = F.when(F.col("calls").isNull(), "budget_exhausted").otherwise(F.coalesce(v["kind"], F.lit("disagreement")))
    said = (
        F.when(outcome == "budget_exhausted", _say(_unless_audit(mode), "vision_refined", normalize_text(crop["text"]), normalize_text(crop["markdown"]), _warnings("verification_budget_exhausted"), crop["source_pass"], crop["box"]))
        .when(outcome == "verified", _say("verified", "vision_refined", v["text"], v["markdown"], _warnings(), crop["verified_pass"], v["refined"]))
        .when((outcome == "scope_drift") & keep, kept("verification_scope_drift", F.when(mode == "balanced", "candidate").otherwise("unresolved")))
        .when(outcome == "scope_drift", _say("unresolved", "vision_refined", "", "", _warnings("verification_scope_drift"), best["source_pass"], crop["box"]))
        .when((outcome == "invalid_box") & keep, kept("invalid_verification_box", _unless_audit(mode))).when(outcome == "invalid_box", lost("invalid_verification_box", crop["box"]))
        .when(keep, kept("visual_disagreement", _unless_audit(mode))).otherwise(lost("visual_disagreement", F.coalesce(v["refined"], crop["box"])))
    )
    return c.select(*keys, "order", "crop.type", outcome.alias("outcome"), F.coalesce("calls", F.lit(0)).alias("calls"), said.alias("said"))


def with_visuals_checked(resolved: DataFrame) -> DataFrame:
    """``resolved`` (``type``, ``said``) where a figure or chart without a description is unresolved and has a placeholder."""
    said = F.col("said")
    bad = F.col("type").isin(*FIGURES) & ~is_semantic_visual(said["markdown"])
    plain = F.array_union(said["warnings"], F.array(F.lit("figure_description_unavailable")))
    return resolved.withColumn("said", F.when(bad, _say("unresolved", said["method"], "", visual_placeholder(F.col("type")), plain, said["source_pass"], said["box"])).otherwise(said))


def resolved_chunks(chunks: DataFrame, pages: DataFrame, drafts: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """All chunks of all pages as they resolve: keys, ``order, type, status, method, text, markdown, warnings, source_pass, box``."""
    first = settled(chunks, pages, drafts, keys)
    cropped = crop_results(first.where("crop is not null"), attempts, keys).select(*keys, "order", F.col("said").alias("cropped"))
    both = first.join(cropped, [*keys, "order"], "left").withColumn("said", F.coalesce("said", "cropped"))
    return with_visuals_checked(both).select(*keys, "order", "type", "said.*")
